"""Alias matching with several keys and journal de-duplication against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import matching as mt
from folioframe.operators import rollups as ru


def chosen(keys, characters, least):
    keys = [k for k in keys if k and len(k) >= 2]
    named = [(c, [n for n in names if len(n) >= 2]) for c, names in characters]
    exact = next((c for c, names in named if any(n in keys for n in names)), None)
    if exact is not None:
        return exact, "exact"
    part = next((c for c, names in named if any(k in n and len(k) >= least or n in k and len(n) >= least for n in names for k in keys)), None)
    return (part, "partial") if part is not None else (None, None)


@pytest.mark.parametrize("least", [2, 3])
def test_match_alias_with_several_keys(spark, least):
    rng = random.Random(least)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(0, 6)))
    characters = [(f"c{i}", [word() for _ in range(rng.randint(0, 3))]) for i in range(25)]
    speakers = [(i, rng.choice([word(), "", None]), rng.choice([word(), None])) for i in range(200)]
    a = spark.createDataFrame([(c, p, n) for p, (c, names) in enumerate(characters) for n in names], "character string, place int, alias string")
    s = spark.createDataFrame(speakers, "id int, cn string, py string")
    got = {r.id: (r.character, r.tier) for r in mt.match_alias(s, a, None, key=["cn", "py"], min_partial=least).collect()}
    assert got == {i: chosen([cn, py], characters, least) for i, cn, py in speakers}
    assert {t for _, t in got.values()} == {"exact", "partial", None}


def test_match_alias_long_names_and_manual(spark):
    long = "the quick brown fox " * 60
    a = spark.createDataFrame([("x", 1, long), ("y", 2, "brown fox the"), ("z", 3, "q")], "character string, place int, alias string")
    s = spark.createDataFrame([(1, "fox the quick"), (2, "say: brown fox the " + "z" * 1000), (3, "nobody"), (4, "chosen"), (5, "quick")], "id int, key string")
    manual = spark.createDataFrame([("chosen", "y"), ("quick", "none")], "key string, character string")
    got = {r.id: (r.character, r.tier) for r in mt.match_alias(s, a, manual).collect()}
    assert got == {1: ("x", "partial"), 2: ("y", "partial"), 3: (None, None), 4: ("y", "manual"), 5: (None, None)}


def journal(rows):
    """(id, key, hash, note): entries one after another."""
    kept = []
    for i, key, digest, note in rows:
        if key and any(e["key"] == key for e in kept):
            continue
        twin = next((e for e in kept if digest and e["digest"] == digest), None)
        if twin:
            twin["key"], twin["note"], twin["n"] = twin["key"] or key, twin["note"] or note, twin["n"] + 1
        else:
            kept.append({"id": i, "key": key, "digest": digest, "note": note, "n": 1})
    return sorted((e["id"], e["key"] or None, e["digest"] or None, e["note"] or None, e["n"]) for e in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_richest_against_one_entry_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "", *[f"k{k}" for k in range(25)]]), rng.choice(["", *[f"h{k}" for k in range(25)]]), rng.choice(["", f"n{i}"])) for i in range(160)]
    # A key that was merged away blocks nobody.
    rows += [(200, "p", "x", ""), (201, "q", "x", ""), (202, "q", "y", "late"), (203, "", "z", ""), (204, "r", "z", ""), (205, "r", "w", "")]
    df = spark.createDataFrame(rows, "id int, skey string, digest string, note string")
    got = ru.dedup_richest(df, "skey", "digest", ["id"], ["note"]).select("id", F.nullif("skey", F.lit("")), F.nullif("digest", F.lit("")), F.nullif("note", F.lit("")), "copies").collect()
    assert sorted(map(tuple, got)) == journal(rows)
    assert (202, "q", "y", "late", 1) in journal(rows)


def test_is_subsequence_of_long_texts(spark):
    import time

    rows = [("abc", "xaxbxcx"), ("abc", "acb"), ("", "a"), ("aé", "éaé"), ("ab", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(mt.is_subsequence(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False, None]
    long = spark.createDataFrame([("é" * 400_000 + "x", "éy" * 400_000 + "x"), ("é" * 400_000 + "x", "éy" * 400_000)], "a string, b string")
    start = time.perf_counter()
    assert [r[0] for r in long.select(mt.is_subsequence(F.col("a"), F.col("b"))).collect()] == [True, False]
    assert time.perf_counter() - start < 30
