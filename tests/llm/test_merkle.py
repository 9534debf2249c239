"""The Merkle manifest against a recursive brute force, over one block and over many."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def forest(digests):
    """(top, the siblings of each digest on its way up)."""
    paths, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        for i, a in enumerate(at):
            paths[i] += now[a ^ 1:(a ^ 1) + 1]
            at[i] = a // 2
        now = [h(*now[i:i + 2]) for i in range(0, len(now), 2)]
    return now[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: [leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))] for g in names}
    ids = {g: sorted((r[0] for r in groups[g]), key=lambda i: (i is not None, i or 0)) for g in names}
    tops = {g: forest(leaves[g]) for g in names}
    root, upper = forest([tops[g][0] for g in names])
    return sorted([(i, leaf, tops[g][0], root, "".join(path + upper[k])) for k, g in enumerate(names)
                   for i, leaf, path in zip(ids[g], leaves[g], tops[g][1])], key=str)


def manifest(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    return merkle.manifest(df, told=F.lit("x"), **more)


@pytest.mark.parametrize("sizes, levels", [((1,), 1), ((2, 1), 12), ((5, 8, 1, 9), 1), ((37, 3, 16), 2), ((37, 3, 16), 3)])
def test_against_brute_force(spark, sizes, levels):
    rows, langs = [], [None, "", "en", "é"]
    for g, n in enumerate(sizes):
        rows += [(i * 10 + g, "s" if i % 3 else None, langs[g], None if i % 4 == 0 else i, "t:é" * i or None) for i in range(n)]
    found = manifest(spark, rows, levels=levels).withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"), F.col("steps"))).collect()
    assert sorted([(r.id, r.leaf, r.subroot, r.root, r.proof) for r in found], key=str) == brute(rows)
    assert all(r.back == r.root and r.told == "x" for r in found)


def test_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(1, "a", "en", 3, "abc")] * 3 + [(None, None, None, None, None), (None, "b", "en", 1, ""), (7, "c", "en", 1, "long " * 300_000)]
    found = manifest(spark, rows, levels=1).collect()
    assert sorted([(r.id, r.leaf, r.subroot, r.root, r.proof) for r in found], key=str) == brute(rows)


def test_empty(spark):
    assert manifest(spark, []).count() == 0


def test_changed_values_lead_elsewhere(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(50)]
    df = manifest(spark, rows, levels=2)
    bad = df.select(merkle.fold(F.sha2(F.concat("leaf", F.lit("!")), 256), F.col("proof"), F.col("steps")).alias("a"), "root")
    assert bad.filter("a = root").count() == 0
