"""Hard negatives against all pairs, and the bounds against the scores they bound."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, v int, rank int"


def brute(rows, every, k=5, m=10):
    seen = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in w) < 1 << 53:
            seen[i] = min(seen.get(i, (y, w)), (y, w))
    out = []
    for a, (y, v) in seen.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, (z, w) in seen.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:k]:
            hard = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(hard)]
    return sorted(out)


def found(spark, rows, every=3, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(df, anchor=F.col("id") % every == 0, label=F.col("label"), **more).collect()))


@pytest.mark.parametrize("dim, block", [(64, 64), (50, 10_000), (7, 40)])
def test_against_all_pairs(spark, dim, block):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(3, dim)) + 1
    rows = [(int(i), (centres[i % 3] + rng.normal(size=dim) * 0.7).tolist(), int(rng.integers(4) % 3)) for i in range(300)]
    got = found(spark, rows, 10, block_rows=block)
    assert len(got) > 300
    assert got == brute(rows, 10)


def test_ties_nulls_repeats_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 2), 0.0], i % 2) for i in range(40)] + [(3, [1.0, 1.0, 0.0], 1)] * 3 + [(6, [0.0, 2.0, 1.0], 0)]
    rows += [(None, [1.0, 0.0, 0.0], 1), (60, None, 1), (61, [1.0, None, 0.0], 0), (63, [float("nan"), 0.0, 0.0], 0), (66, [float("inf"), 0.0, 0.0], 1),
             (69, [1e300, 0.0, 0.0], 0), (72, [0.0, 0.0, 0.0], 0), (75, [-1.0, 0.0, 0.0], 1), (78, [1.0, 2.0], 1), (81, [3.0, 2.0], 1), (80, [1.0, 1.0], 0),
             (84, [], 0), (87, [], 0), (88, [], 1), (90, [1.0, 0.0, 0.0], None)]
    got = found(spark, rows, block_rows=64)
    assert got == brute(rows, 3) and got


def test_hot_label(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=24) + 0.5).tolist(), 0 if i % 3 else i % 5) for i in range(400)]
    assert found(spark, rows, 50, block_rows=64) == brute(rows, 50)


def test_empty(spark):
    assert found(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.integers(-300, 300, size=(60, 64)) + rng.integers(-200, 200, size=(60, 1))
    b = hn.Block(pa.table({"id": range(60), "label": [0] * 60, "v": pa.array(x.tolist(), pa.list_(pa.int32()))}))
    exact, widths = b.x @ b.x.T, []
    for mean, off in b.levels:
        middle, spread = mean @ mean.T, off @ off.T
        assert (np.abs(exact - middle) <= spread + 1e-6).all()
        widths.append(spread.sum())
    assert len(widths) == 3 and widths == sorted(widths, reverse=True)
