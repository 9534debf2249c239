"""Recognised text: lines, blocks, evidence."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from folioframe.functions.alignment import match_share
from folioframe.operators import reading as rd


def greedy_rows(words):
    """Rows of words followed one by one, in plain Python."""
    rows = []
    for w in sorted(words, key=lambda w: (w["y"] + w["h"] / 2, w["x"], w["i"])):
        cy = w["y"] + w["h"] / 2
        near = [(abs(cy - r["c"]), k) for k, r in enumerate(rows) if abs(cy - r["c"]) <= max(w["h"], r["h"]) * 0.6]
        if near:
            r = rows[min(near)[1]]
            r["w"].append(w)
            r["c"] = sum(x["y"] + x["h"] / 2 for x in r["w"]) / len(r["w"])
            r["h"] = median(x["h"] for x in r["w"])
        else:
            rows.append({"c": cy, "h": w["h"], "w": [w]})
    lines = []
    for r in sorted(rows, key=lambda r: r["c"]):
        parts = []
        for w in sorted(r["w"], key=lambda w: (w["x"], w["i"])):
            if not parts or w["x"] - (parts[-1][-1]["x"] + parts[-1][-1]["w"]) > max(r["h"] * 3, 0.025):
                parts.append([])
            parts[-1].append(w)
        lines += [" ".join(w["text"] for w in p) for p in parts]
    return lines


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_group_words_to_lines(spark, seed):
    rnd = random.Random(seed)
    words = [{"page": p, "i": i, "text": f"w{i}", "x": rnd.random() * 0.9, "y": rnd.random(), "w": 0.05 + rnd.random() * 0.05, "h": 0.01 + rnd.random() * 0.02}
             for p in range(3) for i in range(60)]
    df = spark.createDataFrame(words, "page int, i int, text string, x double, y double, w double, h double")
    got = rd.group_words_to_lines(df, ["page"], "i").collect()
    for p in range(3):
        mine = sorted((int(r.id.split("-")[1]), r.text) for r in got if r.page == p)
        assert [t for _, t in mine] == greedy_rows([w for w in words if w["page"] == p])


def test_near_words_far_column_next_row(spark):
    rows = [(1, "你", 0.1, 0.1, 0.02, 0.02), (2, "好", 0.121, 0.102, 0.02, 0.02), (3, "far", 0.7, 0.1, 0.05, 0.02), (4, "next", 0.1, 0.2, 0.05, 0.02), (5, "  ", 0.5, 0.5, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "i int, text string, x double, y double, w double, h double").withColumn("page", F.lit(1))
    got = {r.id: r.text for r in rd.group_words_to_lines(df, ["page"], "i").collect()}
    assert got == {"line-1": "你好", "line-2": "far", "line-3": "next"}


def test_fuzzy_assign(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    blocks = [(1, 1, "Initials", (0.1, 0.1, 0.2, 0.05)), (1, 2, "Initials and finals of the syllables", (0.1, 0.18, 0.5, 0.05)), (1, 3, "Initials", (0.1, 0.8, 0.2, 0.05))]
    lines = [(1, 1, "initials", (0.11, 0.11, 0.1, 0.03)), (1, 2, "Initials and flnals of the syllab1es", (0.1, 0.19, 0.4, 0.03)), (1, 3, "Initials", (0.1, 0.81, 0.1, 0.03)),
             (1, 4, "unrelated words", (0.1, 0.2, 0.2, 0.03)), (1, 5, "x", (0.1, 0.1, 0.1, 0.1))]
    b = spark.createDataFrame(blocks, f"page int, block int, text string, box {box}")
    l = spark.createDataFrame(lines, f"page int, line int, text string, box {box}")
    assert {r.line: r.block for r in rd.fuzzy_assign(l, b, ["page"]).collect()} == {1: 1, 2: 2, 3: 3}


def test_claim_rest(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    blocks = [(p, b, word(r.choice([1, 2, 3, 5, 8, 13, 20]))) for p in range(6) for b in range(12)]
    lines = [(p, n, word(r.choice([1, 4, 9, 30]))) for p in range(6) for n in range(25)]
    claimed = [(p, n, b) for p in range(6) for n, b in ((1, 2), (5, 2), (7, 9))]
    want = {}
    for p, n, line in lines:
        if not any(c[:2] == (p, n) for c in claimed):
            fits = [b for q, b, key in blocks if q == p and len(key) >= 2 and (p, b) not in {(c[0], c[2]) for c in claimed} and match_share(key, line) >= 0.8]
            if fits and len(line) >= 2:
                want[p, n] = min(fits)
    l, b = spark.createDataFrame(lines, "page int, line int, text string"), spark.createDataFrame(blocks, "page int, block int, text string")
    got = {(x.page, x.line): x.block for x in rd.claim_rest(l, b, spark.createDataFrame(claimed, "page int, line int, block int"), ["page"]).collect()}
    assert len(want) > 40 and got == want

@pytest.mark.parametrize("most", [20_000, 30])
def test_claim_rest_reads_pages_whole(spark, monkeypatch, most):
    monkeypatch.setattr(rd, "LARGE_PAGE", most)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcé") for _ in range(n))
    blocks = [(p, r.choice([None, *range(9)]), word(r.choice([2, 3, 5, 8, 13, 20]))) for p in (None, 1, 2) for _ in range(14)]
    lines = [(p, r.choice([None, *range(30)]), word(r.choice([1, 4, 9, 30]))) for p in (None, 1, 2) for _ in range(10 if p == 1 else 25)]
    claimed = [(None, 3, 4), (1, None, 2), (2, 7, None)]
    bare = lambda t: t.replace("é", "e")
    want = {}
    for p, n, line in lines:
        if not any(c[:2] == (p, n) for c in claimed) and len(line) >= 2:
            fits = [(b is not None, b or 0, -share) for q, b, key in blocks if q == p and (p, b) not in {(c[0], c[2]) for c in claimed} and (share := match_share(bare(key), bare(line))) >= 0.8]
            if fits:
                want[p, n] = min([*fits, *([want[p, n]] if (p, n) in want else [])])
    l, b = spark.createDataFrame(lines, "page int, line int, text string"), spark.createDataFrame(blocks, "page int, block int, text string")
    done = rd.claim_rest(l, b, spark.createDataFrame(claimed, "page int, line long, block int"), ["page"])
    assert done.schema.simpleString() == "struct<page:int,line:int,block:int,score:double>"
    assert ("Join" in done._jdf.queryExecution().executedPlan().toString()) == (most < 100)
    got = {(x.page, x.line): (x.block is not None, x.block or 0, -x.score) for x in done.collect()}
    assert len(want) > 15 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_align_lines(spark):
    rows = [(1, "你好 世界朋友", ["你好世", "界朋"]), (2, "abcdefgh", ["zzzz", "yyyy"]), (3, "x" * 1600, ["x" * 1600]), (4, None, ["a"]), (5, " ", [" "])]
    df = spark.createDataFrame(rows, "id int, clean string, lines array<string>")
    got = {r.id: (r.aligned, r.aligned_reason) for r in rd.align_lines(df, "clean", "lines").collect()}
    assert got == {1: (["你好 世", "界朋友"], None), 2: (None, "far"), 3: (["x" * 1600], None), 4: (None, "empty"), 5: (None, "empty")}
    short = {r.id: r.aligned_reason for r in rd.align_lines(df, "clean", "lines", limit=1500).collect()}
    assert short == {1: None, 2: "far", 3: "long", 4: "empty", 5: "empty"}


def test_align_long_text(spark):
    r = random.Random(4)
    clean = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    cuts = [0, *sorted(r.sample(range(60_000), 400)), 60_000]
    lines = ["".join(c if r.random() > 0.03 else "z" for c in clean[i:j]) for i, j in zip(cuts, cuts[1:])]
    df = spark.createDataFrame([(clean, lines)], "clean string, lines array<string>")
    got = rd.align_lines(df, "clean", "lines").first()
    assert got.aligned_reason is None and "".join(got.aligned) == clean and len(got.aligned) == len(lines)
    same = sum(a.split() == b.split() for a, b in zip(got.aligned, [clean[i:j] for i, j in zip(cuts, cuts[1:])]))
    assert same > 350  # a mark misread at a border can move it by a letter


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_region_disagreement_stretches(spark, stretch):
    sources = [("same", "Ab cdefg hij"), ("late", "abcdefghij"), ("short", "abcdefgh"), ("more", "abc"), ("none", "abc"), ("empty", " "), ("null", None), ("marks", "a😀b你c")]
    pieces = [("same", 1, "abC"), ("same", 2, ""), ("same", 3, "defghi j"), ("late", 1, "abcdefgh"), ("late", 2, "iX"), ("short", 1, "abcdefg"), ("more", 1, "ab"), ("more", 2, "cdefgh"),
              ("null", 1, "a"), ("marks", 1, "a😀"), ("marks", 2, None), ("marks", 3, "b你C")]
    s, p = spark.createDataFrame(sources, "region string, text string"), spark.createDataFrame(pieces, "region string, pos int, piece string")
    got = {r.region for r in rd.region_disagreement(s, p, ["region"], "text", ["pos"], "piece", stretch).collect()}
    assert got == {"late", "short", "more", "none"}


def test_arbitrate_and_reads(spark):
    df = spark.createDataFrame([(1, "abd", 0.7, "abc", 0.95), (2, "abd", 0.9, "abc", 0.95), (3, "é", 0.5, "e", 0.99), (4, "a", 0.96, "b", 1.0), (5, "a", 0.7, "a", 0.99)],
                               "id int, t string, c double, t2 string, c2 double")
    got = {r.id: (r.t, r.previous_text) for r in rd.arbitrate(df, "t", "c", "t2", "c2").collect()}
    assert got == {1: ("abc", "abd"), 2: ("abd", None), 3: ("é", None), 4: ("a", None), 5: ("a", None)}
    reads = spark.createDataFrame([(1, "“好”", 0.8), (1, "“好”", 0.9), (2, "“好”", 0.6), (2, "“好”", 0.9), (3, "“一二三四五”", 0.9), (3, "“一二三四五”", 0.9), (4, "“a”", 0.9), (4, "“b”", 0.9)],
                                  "id int, t string, c double")
    assert {r.id: r.accepted for r in rd.agreeing_reads(reads, ["id"], "t", "c").collect()} == {1: True, 2: False, 3: False, 4: False}
    han = spark.createDataFrame([(1, "好", 0.95), (1, "好", 0.9), (2, "好", 0.95), (2, "好", 0.8), (3, "ab", 0.95), (3, "ab", 0.95)], "id int, t string, c double")
    assert {r.id: r.kind for r in rd.agreeing_reads(han, ["id"], "t", "c", rule="han").collect()} == {1: "recovered-caption", 2: "unresolved-caption-component", 3: "unresolved-caption-component"}


def test_long_pages_read_as_short_ones(spark, monkeypatch):
    rnd = random.Random(7)
    words = [(p, i, rnd.choice(["a", "你", " ", "bc"]), round(rnd.random(), 1), rnd.random(), 0.05, 0.01 + rnd.random() * 0.02) for p in (None, 1, 2) for i in range(30 if p == 2 else 90)]
    df = spark.createDataFrame(words, "page int, i int, text string, x double, y double, w double, h double")
    read = lambda: sorted(((r.page or 0, r.id, r.text, *[round(r[c], 9) for c in "xywh"]) for r in rd.group_words_to_lines(df, ["page"], "i").collect()))
    whole = read()
    monkeypatch.setattr(rd, "LONG_PAGE", 50)
    assert read() == whole


def test_short_pages_are_shuffled_once(spark):
    df = spark.range(100).selectExpr("id % 3 AS page", "id AS i", "'w' AS text", "0.1 AS x", "id / 100 AS y", "0.1 AS w", "0.01 AS h")
    plan = rd.group_words_to_lines(df, ["page"], "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_text_beyond_a_full_stretch(spark):
    sources = spark.createDataFrame([(1, "abcd"), (2, "abcd"), (3, ""), (4, ""), (5, None), (6, "abcd"), (6, "abcdefgh"), (None, "ab"), (7, "abcdefgh")], "r int, s string")
    pieces = spark.createDataFrame([(1, 0, "ab"), (1, 1, "C d"), (2, 0, "abcd"), (2, 1, "e"), (4, 0, "x"), (5, 0, "x"), (6, 0, "abcdefgh"), (None, 0, "ab"), (7, 0, "abcd"), (9, 0, "x")], "r int, i int, t string")
    done = rd.region_disagreement(sources, pieces, ["r"], "s", ["i"], "t", stretch=4)
    assert sorted(r.r for r in done.collect()) == [2, 4, 6, 6, 7]
    # The pieces are put in order once.
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
