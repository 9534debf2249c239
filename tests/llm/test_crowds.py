"""Crowded leaves of the forest: many vectors over a small sample, and a dense group that no direction divides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import rp_forest


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    spread = rng.standard_normal((900, 16))
    near = np.repeat(spread, 3, axis=0) + 0.05 * rng.standard_normal((2700, 16))
    dense = spread[0] + 0.02 * rng.standard_normal((300, 16))
    return np.concatenate([near, dense])


def test_crowded_leaves_are_split(spark, vectors, monkeypatch):
    sizes = []
    split = rp_forest._split_crowds

    def seen(placed, *args):
        out = split(placed, *args)
        m = [[r.m for r in t.select(F.explode("leaves").alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("m")).collect()] for t in (placed, out)]
        assert placed.count() == out.count()
        sizes.append(m)
        return out

    monkeypatch.setattr(rp_forest, "_split_crowds", seen)
    monkeypatch.setattr(rp_forest, "PART", 256)
    monkeypatch.setattr(rp_forest, "BATCH", 100)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.id: r for r in rp_forest.near_duplicates(table, sample=150, leaf=16).collect()}
    (before, after), = sizes
    assert sorted(before)[-12] > 300  # leaves of the sample's trees: many hold a tenth of all rows
    assert np.median(after) <= 64 and sum(m > 64 for m in after) < sum(m > 64 for m in before) / 2
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert len({got[i].component_id for i in range(2700, 3000)}) == 1  # the dense group stays together
