"""Cases that once gave wrong answers."""

import unicodedata

from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import matching as mt
from folioframe.operators import rollups as ru
from folioframe.operators import tables as tb


def test_cyrillic_accents_agree(spark):
    row = spark.createDataFrame([("Мой ёж", "Мой ёж")], "a string, b string").select(
        tx.plain_key(F.col("a")), tx.plain_key(F.col("b")), tx.memory_key(F.col("a")), tx.memory_key(F.col("b"))).first()
    assert row[0] == row[1] == "моиеж" and row[2] == row[3] == unicodedata.normalize("NFC", "мой ёж")


def test_transliterate_long_words(spark):
    rows = spark.createDataFrame([("ma" * 1000,), ("ma" * 5000,), ("ma " * 500 + "xyz",)], "t string").select(tx.transliterate(F.col("t"))).collect()
    assert [r[0] and len(r[0]) for r in rows] == [2000, 10_000, None]


def test_odd_aspects(spark):
    requests = spark.createDataFrame([("m", "720p", a, False, 2.0) for a in ("auto", "16:9", "4:0", "", None, "1:1")], "model string, resolution string, aspect string, audio boolean, duration double")
    skus = spark.createDataFrame([("m", "video_tokens", 0.001)], "model string, sku string, price double")
    usd = {r.aspect: r.usd for r in mt.price_estimate(requests, skus).collect()}
    assert usd["auto"] == usd["16:9"] == usd["4:0"] == usd[""] == usd[None] > usd["1:1"] > 0


def test_unsound_boxes_do_not_vote(spark):
    nan = float("nan")
    boxes = spark.createDataFrame([(1, .1, .1, .2, .2), (1, .3, .3, .2, .2), (1, nan, .1, .2, .2), (2, nan, nan, nan, nan), (2, None, .1, .1, .1)], "p long, x double, y double, w double, h double")
    got = {r.p: (r.unit, r.sx, r.sy) for r in ru.unit_vote(boxes, ["p"], "x", "y", "w", "h", F.lit(100), F.lit(100)).collect()}
    assert got == {1: ("fraction", 1.0, 1.0), 2: ("fraction", 1.0, 1.0)}


def test_repeated_ids_match_one_to_one(spark):
    schema = "page long, id string, type string, hash string, y long"
    old = spark.createDataFrame([(1, "a", "t", "h1", 1), (1, "b", "t", "h2", 2)], schema)
    new = spark.createDataFrame([(1, "a", "t", "h1", 1), (1, "a", "t", "h2", 2)], schema)
    got = sorted((r.y, r.matched_id) for r in mt.match_revision(new, old, ["page"], "id", ["type", "hash"], ["y"]).collect())
    assert got == [(1, "a"), (2, "b")]


def test_pieces_are_joined_in_order(spark):
    schema = "page long, id string, alt string, region long, x long, text string, value string"
    old = spark.createDataFrame([(1, "gone", "k", 1, 0, "abcd", "v")], schema)
    for first, second in (("b-2", "b-10"), ("b-10", "b-2")):
        new = spark.createDataFrame([(1, first, "k1", 1, 1, "ab", "v"), (1, second, "k2", 1, 2, "cd", "v")], schema)
        lost = mt.revision_regressions(new, old, ["page"], "id", "value", alternate=["alt"], region=["region"], text="text", order=["x"])
        assert lost.count() == 0


def test_repeated_lookup_keys_do_not_multiply_rows(spark):
    work = spark.createDataFrame([("c", "k", "p")], "content string, code string, prompt string")
    cache = spark.createDataFrame([("c", "k", "r2", "q"), ("c", "k", "r1", "p")], "content string, code string, result string, prompt string")
    assert [(r.result, r.review) for r in tb.memo_join(work, cache, "content", "code", "result", "prompt").collect()] == [("r1", False)]
    items, done = spark.createDataFrame([(1, "h")], "id long, h string"), spark.createDataFrame([(1, "h", "error"), (1, "h", "done")], "id long, h string, state string")
    assert [r.state for r in tb.batch_status(items, done, ["id"], "h").collect()] == ["done"]
    assert mt.dictionary_fill(spark.createDataFrame([("a", "")], "k string, v string"), spark.createDataFrame([("a", "x"), ("a", "y")], "k string, v string"), ["k"], "v").count() == 1


def test_regions_with_edges_anywhere(spark):
    from folioframe.operators import spatial as sp
    regions = spark.createDataFrame([(1, 1, 0.105, 0.0, 0.2, 1.0), (1, 2, 0.0, 0.0, 1.0, 1.0), (1, 3, 0.5, 0.5, 0.4, 0.9)], "page int, id int, x0 double, y0 double, x1 double, y1 double")
    tokens = spark.createDataFrame([(1, 1, 0.1041, 0.5), (1, 2, 0.105, 0.5), (1, 3, 0.2, 1.0), (1, 4, 1.01, 0.5), (2, 5, 0.15, 0.5), (1, 6, None, 0.5)], "page int, t int, cx double, cy double")
    for cell in (0.01, 0.3, 5.0):
        done = sp.assign_to_region(tokens, regions, ["page"], F.col("cx"), F.col("cy"), ("x0", "y0", "x1", "y1"), "id", ["id"], cell)
        assert {r.t: r.region and r.region.id for r in done.collect()} == {1: 2, 2: 1, 3: 1, 4: None, 5: None, 6: None}


def test_lesson_rules_by_page_type(spark):
    from folioframe.operators import contracts as ct
    pages = spark.createDataFrame([(1, 1, "scanned", 4, 10.0, 10.0), (1, 2, "electronic", 5, 10.0, 10.0), (1, 3, "electronic", 5, 10.0, 0.0)], "lesson int, page int, page_type string, scan int, width double, height double")
    box = (0.1, 0.1, 0.2, 0.2)
    file = "/assets/b/" + "a" * 32
    blocks = [(1, 1, "scanned", "b", None, None, "t", None, None, None, *box), (1, 1, "scanned", "b", None, None, "t", None, None, None, 0.9, 0.9, 0.0, 0.9), (1, 1, "scanned", "b", None, None, " ", None, None, None, *box),
              (1, 2, "electronic", "b", "1", "text", "t", "", None, None, *box), (1, 2, "electronic", "b", "2", "image", None, None, "a", file + ".jpeg", *box),
              (1, 2, "electronic", "b", "3", "image", None, None, "", file + ".gif", *box), (1, 2, "electronic", "b", "3", None, "t", "", None, None, *box)]
    df = spark.createDataFrame(blocks, "lesson int, page int, page_type string, book string, id string, type string, text string, translation string, alt string, image string, x double, y double, w double, h double")
    got = sorted((r.page, r.rule) for r in ct.lesson_contract(df, pages, "lesson", "page").collect())
    assert got == [(1, "block.text"), (2, "block.alt"), (2, "block.image"), (2, "block.type"), (2, "block.unique"), (2, "scan.unique"), (3, "blocks.count"), (3, "scan.size")]
