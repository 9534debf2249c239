"""Catalogue, revision, contract, activity and version cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import contracts as ct
from folioframe.operators import matching as mt
from folioframe.operators import rollups as ru
from folioframe.operators import sequences as sq
from folioframe.operators import tables as tb
from folioframe.sources import pages as pg
from folioframe.sources import schemas
from folioframe.sources.versions import VersionConflict, VersionedTable, write_checked


def test_translation_memory(spark):
    rows = [(1, "Hello", "Привет", "Сәлем"), (2, "Bye", "Пока", "Сау"), (3, "bye ", "пока", "Қош"), (4, "hello", " привет", None), (5, "Bye", "Пока", ""), (6, "Hi", "Привет", None)]
    df = spark.createDataFrame(rows, "id int, en string, ru string, kk string")
    got = {r.id: (r.kk, r.restored) for r in mt.restore(df, mt.translation_memory(df, "en", "ru", "kk"), "en", "ru", "kk").collect()}
    assert got[4] == ("Сәлем", True) and got[5] == (None, False) and got[6] == (None, False) and got[1] == ("Сәлем", False)


def test_revision_identity(spark):
    schema = "page int, id string, type string, hash string, y int, value string, text string"
    old = spark.createDataFrame([(1, "a", "para", "h1", 1, "va", "x"), (1, "b", "para", "h2", 2, "vb", "y"), (1, "c", "para", "h3", 3, "vc", "z")], schema)
    # a keeps its id with the same source, b moved and lost its id, c changed its source
    new = spark.createDataFrame([(1, "a", "para", "h1", 3, None, "x"), (1, None, "para", "h2", 1, None, "y"), (1, "c", "para", "h9", 2, None, "w"), (1, None, "para", "h8", 4, None, "v")], schema)
    m = mt.match_revision(new, old, ["page"], "id", ["type", "hash"], ["y"])
    ids = {r.hash: r.block_id for r in m.collect()}
    assert ids["h1"] == "a" and ids["h2"] == "b" and ids["h9"] == "c" and ids["h8"].startswith("b-")
    kept = {r.hash: r.value for r in mt.carry_translations(m, old, ["page"], "id", "hash", "value").collect()}
    assert kept == {"h1": "va", "h2": "vb", "h9": None, "h8": None}


def test_revision_regressions(spark):
    schema = "page int, id string, alt string, value string, region int, text string"
    old = spark.createDataFrame([(1, "a", "1A", "v", 1, "你好世界"), (1, "b", "1B", "v", 2, "x"), (1, "c", "1C", None, 3, "y"), (1, "d", "1D", "v", 4, "abc")], schema)
    new = spark.createDataFrame([(1, "p", "z1", "v", 1, "你好"), (1, "q", "z2", "v", 1, "世界"), (1, "n", "1B", "v", 2, "x"), (1, "m", "z3", "v", 4, "ac")], schema)
    lost = mt.revision_regressions(new, old, ["page"], "id", "value", alternate=["alt"], region=["region"], text="text")
    assert [r.id for r in lost.collect()] == ["d"]


def test_replace_partition_by_equality(spark):
    t = spark.createDataFrame([("press:hsk1", 1), ("press:hsk1-workbook", 2)], "book string, n int")
    s = spark.createDataFrame([("press:hsk1", 9)], "book string, n int")
    assert sorted(tuple(r) for r in tb.replace_partition(t, s, ["book"]).collect()) == [("press:hsk1", 9), ("press:hsk1-workbook", 2)]


def test_refuse_unlisted(spark):
    df = spark.createDataFrame([("press", "textbook"), ("press", "workbook")], "source string, kind string")
    rules = {"source": F.col("source") == "press", "kind": F.col("kind").isin("textbook", "workbook")}
    assert tb.refuse_unlisted(df, rules).count() == 2
    with pytest.raises(ValueError, match="kind"):
        tb.refuse_unlisted(df.unionByName(spark.createDataFrame([("press", "x")], df.schema)), rules)
    with pytest.raises(ValueError, match="users"):
        tb.refuse_unlisted(df, rules, {"users": df})


def test_consensus_needs_confidence(spark):
    names = spark.createDataFrame([(1, "张三丰"), (2, "张三丰"), (3, "张二丰"), (4, "李四")], "g int, name string")
    def run(conf):
        ev = spark.createDataFrame([(g, "张三丰", conf) for g in (1, 2, 3)] + [(4, "李四", 0.95)], "g int, seen string, confidence double")
        return {r.g: r.corrected for r in mt.correct_by_consensus(names, ev, "g", "name", "seen", "confidence").collect()}
    assert run(0.95) == {1: None, 2: None, 3: "张三丰", 4: None}
    assert run(0.8) == {1: None, 2: None, 3: None, 4: None}


def test_draft_contract(spark):
    pages = spark.createDataFrame([(1, "1", "t", "c"), (1, "true", "t", "c"), (1, "2", " ", "c"), (1, "2", "t", "c"), (1, "9", "t", "c")], "draft int, pdf_page string, task string, chaoIntro string")
    expected = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "draft int, page int")
    vocab = spark.createDataFrame([(1, "1", "词", "cí", "", "word"), (1, "2", " ", "x", "n", "y")] + [(1, "3", "w", "p", "", "t")] * 21, "draft int, pdf_page string, word string, py string, pos string, trans string")
    got = sorted((r.pdf_page, r.rule) for r in ct.draft_contract(pages, expected, vocab, "draft").collect())
    assert got == sorted([("true", "pdf_page.type"), ("2", "task"), ("9", "pdf_page.range"), ("2", "pdf_page.unique"), ("3", "pages.missing"), ("2", "vocab.word"), ("3", "vocab.count")])


def test_publish_contract(spark):
    pages = spark.createDataFrame([("hsk1", 3, "2342/3190", 0.1, None, 1, "t"), ("Bad_Slug", 3, "2342/3190", None, None, 1, "t"), ("hsk2", 1000, "x", 0.3, 0.1, 1, " ")],
                                  "slug string, n int, aspect string, crop_left double, crop_right double, lesson_number int, title string")
    files = spark.createDataFrame([("hsk1", 3, "pages/003/a.png"), ("hsk1", 3, "pages/004/a.png"), ("hsk1", 3, "../x.png"), ("hsk1", 3, "cast/li.webp")], "slug string, n int, path string")
    words = spark.createDataFrame([("hsk1", 3, "你")] * 13, "slug string, n int, word string")
    vocab = spark.createDataFrame([("hsk1", 3, "词", "cí", "", "w")] * 48, "slug string, n int, word string, py string, pos string, trans string")
    got = sorted((r.slug, r.rule) for r in ct.publish_contract(pages, files, words, vocab, "slug", "n").collect())
    assert got == sorted([("Bad_Slug", "book.slug"), ("hsk2", "page.n"), ("hsk2", "page.aspect"), ("hsk2", "page.crop"), ("hsk2", "lesson.title"), ("hsk1", "file.page"),
                          ("hsk1", "file.path"), ("hsk1", "builder.count")])


def test_publish_contract_needs_its_text_columns(spark):
    pages = spark.createDataFrame([("hsk1", 3, "2342/3190", 0.1, None, 1, "t", "x" * 41)],
                                  "slug string, n int, aspect string, crop_left double, crop_right double, lesson_number int, title string, pageNum string")
    files, words = (spark.createDataFrame([], f"slug string, n int, {c} string") for c in ("path", "word"))
    vocab = spark.createDataFrame([], "slug string, n int, word string, py string, pos string, trans string")
    got = sorted(r.rule for r in ct.publish_contract(pages, files, words, vocab, "slug", "n", required=ct.TEXT_LIMITS).collect())
    assert got == sorted(f"page.{c}" for c in ct.TEXT_LIMITS)


def test_publish_query_gives_every_text_field(spark, sf, monkeypatch):
    from folioframe.plans import QUERIES
    monkeypatch.setattr(ct, "TEXT_LIMITS", dict.fromkeys(ct.TEXT_LIMITS, 0))  # no text is short enough
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    rules = {r.rule: r["count"] for r in QUERIES["publish_contract"](spark, sf).groupBy("rule").count().collect()}
    assert all(rules.get(f"page.{c}") == n for c in ct.TEXT_LIMITS)


def test_activity_days_and_buckets(spark):
    rows = [("2024-02-29 18:59:59", 60.0, "a"), ("2024-02-29 19:00:00", 30.0, "a"), ("2024-03-01 03:00:00", -5.0, "b"), ("2024-03-30 10:00:00", 90.0, "a")]
    df = spark.createDataFrame(rows, "ts string, seconds double, word string").withColumn("ts", F.col("ts").cast("timestamp"))
    days = {str(r.day): (r.seconds, r.words) for r in ru.daily_activity(df, [], "ts", "seconds", "word", zone="Asia/Tashkent").collect()}
    assert days == {"2024-02-29": (60.0, 1), "2024-03-01": (30.0, 2), "2024-03-30": (90.0, 1)}
    month = [tuple(r) for r in ru.month_buckets(df, "ts", "seconds", "word", F.lit("2024-03-15").cast("date"), zone="Asia/Tashkent").orderBy("first_day").collect()]
    assert month == [(1, 7, 1, 2), (8, 14, 0, 0), (15, 21, 0, 0), (22, 28, 0, 0), (29, 31, 2, 1)]
    week = [(str(r.day), r.minutes) for r in ru.week_series(df, "ts", "seconds", "word", F.lit("2024-03-01").cast("date"), zone="Asia/Tashkent").orderBy("day").collect()]
    assert week[0][0] == "2024-02-26" and week[3] == ("2024-02-29", 1) and week[4] == ("2024-03-01", 1) and len(week) == 7


def test_local_zone():
    assert ru.LOCAL_ZONE == "Asia/Qyzylorda"


def test_expansion_shift(spark):
    rows = [(1, 1, 0.0, 20.0, 50.0), (1, 2, 0.0, 20.0, 35.0), (1, 3, 40.0, 20.0, 30.0), (1, 4, 100.0, 20.0, 20.0)]
    df = spark.createDataFrame(rows, "page int, id int, top double, height double, required double")
    got = {r.id: r.shift for r in sq.expansion_shift(df, ["page"], ["id"], "top", "height", "required").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 30.0, 4: 40.0}


def test_review_ladder(spark):
    t0 = dt.datetime(2024, 1, 1)
    oks = [True] * 7 + [False, True]
    df = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=i), i, ok) for i, ok in enumerate(oks)], "u int, ts timestamp, i int, ok boolean")
    done = sq.review_ladder(df, ["u"], ["ts", "i"], "ts", F.col("ok")).withColumn("wait", F.col("due_ms") - sq.millis("ts")).orderBy("i").collect()
    day = 86_400_000
    assert [r.level for r in done] == [1, 2, 3, 4, 5, 5, 5, 0, 1]
    assert [r.wait for r in done] == [day, 3 * day, 7 * day, 14 * day, 30 * day, 30 * day, 30 * day, 60_000, day]
    last = sq.review_state(df, ["u"], ["ts", "i"], "ts", F.col("ok")).first()
    assert (last.attempts, last.successes, last.level, last.due_ms) == (9, 8, 1, done[-1].due_ms)


def test_adjust_segments(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 12, 20), ("a", 40, 50), ("a", 55, 60), ("b", 0, 100)], "s string, start long, end long")
    got = {}
    for r in sq.adjust_segments(df, ["s"], 3).collect():
        got.setdefault(r.s, []).append((r.start, r.end))
    assert sorted(got["a"]) == [(0, 20), (40, 50), (55, 60)]
    assert sorted(got["b"]) == [(0, 25), (26, 50), (51, 100)]


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "book"))
    ok = lambda df: df.filter("n < 0")
    a, b, bad = (spark.createDataFrame([(n,)], "n int") for n in (1, 2, -1))
    table.commit(a, "v1", ok)
    table.commit(b, "v2", ok, based_on="v1")
    with pytest.raises(ValueError):
        table.commit(bad, "v3", ok, based_on="v2")
    assert table.active() == "v2" and table.read().first().n == 2
    with pytest.raises(VersionConflict):
        table.commit(b, "v4", ok, based_on="v1")
    table.rollback("v1", ok)
    assert table.read().first().n == 1 and [h[1:] for h in table.history()] == [("v1", "commit"), ("v2", "commit"), ("v1", "rollback")]


def test_checked_write(spark, tmp_path):
    path, ok = str(tmp_path / "book"), lambda df: df.filter("n < 0")
    good, bad = (spark.createDataFrame([(n,)], "n int") for n in (1, -1))
    write_checked(good, path, 1, ok)
    with pytest.raises(ValueError):
        write_checked(bad, path, 2, ok)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_checked(good, path, 1, ok)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, 1)]


def test_signatures_of_all_rows(spark, sf):
    from folioframe.plans import QUERIES
    rows = QUERIES["check_signatures"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.verdict for r in rows} == {"ok", "wrong content", "unknown type", "empty"}
    heads = [("a.png", b"\x89PNG\r\n\x1a\n", 9), ("b.jpg", b"not a pictur", 13), ("c.webp", b"RIFF1234WEBP", 13), ("d.png", b"", 0), ("e.png", b"x", 50), ("f", b"x", 1), ("g.png", None, None)]
    df = spark.createDataFrame(heads, "name string, head binary, length long")
    got = {r.name: r.verdict for r in df.select("name", pg.signature_verdict(F.col("name"), F.col("head"), F.col("length"), max_bytes=40).alias("verdict")).collect()}
    assert got == {"a.png": "ok", "b.jpg": "wrong content", "c.webp": "ok", "d.png": "empty", "e.png": "too large", "f": "unknown type", "g.png": "empty"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "b.jpg").write_bytes(b"not a picture")
    (tmp_path / "c.webp").write_bytes(b"RIFF1234WEBPx")
    (tmp_path / "d.png").write_bytes(b"")
    (tmp_path / "e.png").write_bytes(b"x" * 50)
    names = spark.createDataFrame([("a.png",), ("d.png",)], "name string")
    got = {r.path.split("/")[-1]: r.verdict for r in pg.check_signatures(spark, str(tmp_path), max_bytes=40, listed=names).collect()}
    assert got == {"a.png": "ok", "b.jpg": "wrong content", "c.webp": "ok", "d.png": "empty", "e.png": "too large"}
    tsv = tmp_path / "t" / "page.tsv"
    tsv.parent.mkdir()
    head = "level page_num block_num par_num line_num word_num left top width height conf text".split()
    rows = [["5", "1", "1", "1", "1", "1", "100", "50", "30", "10", "96.5", "word"], ["5", "1", "1", "1", "1", "2", "1", "1", "1", "1", "24", "low"], ["4"] + ["1"] * 10 + ["x"],
            ["5", "1", "1", "1", "1", "3", "n/a", "1", "1", "1", "90", "bad"], ["5", "1", "1", "1", "1", "4", "1", "1", "1", "1", "90", " "]]
    tsv.write_text("\n".join("\t".join(r) for r in [head, *rows]))
    done = pg.ingest_ocr_tsv(pg.read_ocr_tsv(spark, str(tsv)), F.lit(1000), F.lit(500)).select("text", "x", "y", "w", "h").collect()
    assert [tuple(r) for r in done] == [("word", 0.1, 0.1, 0.03, 0.02)]


def test_read_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"book_id": "b", "page": 1, "lines": [{"id": 0, "text": "t", "confidence": 0.5, "position": {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}}]}\n{broken\n')
    docs = schemas.read_documents(spark, str(tmp_path / "p.json"), schemas.OCR_PAGE).cache()
    assert docs.filter("_corrupt IS NOT NULL").count() == 1
    assert tuple(schemas.page_lines(docs).first()) == ("b", 1, 0, "t", 0.5, 0.1, 0.2, 0.3, 0.4)


def test_hot_group_is_split(spark):
    from folioframe.operators.ordered import Ordered
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id")
    o = Ordered(df, ["k"], ["id"], chunks=20)
    sizes = o.df.groupBy("k", "__ord_chunk").count().agg(F.max("count")).first()[0]
    assert sizes < 2000


def test_global_order_is_never_one_task(spark, sf):
    """Whole-table numberings are cut like any other table: none of their plans gathers the rows in one partition."""
    from folioframe.operators.ordered import Ordered
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    done = Ordered(df, [], ["l_orderkey", "l_linenumber"]).add(i=("row",), top=("max", F.col("l_linenumber"))).done()
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__ord_chunk" in line for line in windows)
    rows = done.orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1, df.count() + 1))
    assert [(r[0], r[1]) for r in rows] == sorted((r[0], r[1]) for r in rows)


def test_split_points_of_odd_keys(spark):
    """NaN, null and empty keys, nulls and ties in the order, and an empty table."""
    from folioframe.operators.ordered import Ordered
    data = [(k, v) for k in (float("nan"), None, 0.0, 2.5) for v in [None, *range(40), 39]]
    df = spark.createDataFrame(data, "k double, v long")
    got = Ordered(df, ["k"], ["v"], chunks=9).add(n=("row",), total=("sum", F.coalesce("v", F.lit(0)))).done().collect()
    assert len(got) == len(data)
    for key in ("nan", "None", "0.0", "2.5"):
        mine = [r for r in got if str(r["k"]) == key]
        assert sorted(r["n"] for r in mine) == list(range(1, 43))
        assert max(r["total"] for r in mine) == sum(range(40)) + 39
    assert Ordered(df.limit(0), ["k"], ["v"]).add(n=("row",)).done().collect() == []


def test_ordered_total(spark):
    """The total of a key is the same in all of its rows, whether the key is cut or not."""
    from folioframe.operators.ordered import Ordered
    rows = [(1 if i < 900 else None if i < 950 else i, i, i % 7 if i % 5 else None) for i in range(1000)]
    o = Ordered(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], chunks=9).add(t=("total", "v"), n=("total", F.lit(1)))
    assert o.hot is not None
    for r in o.done().collect():
        mine = [v for k, _, v in rows if k == r.k]
        assert (r.t, r.n) == (sum(v for v in mine if v is not None) if any(v is not None for v in mine) else None, len(mine))


def test_pieces_and_widths_need_no_join(spark):
    from folioframe.operators import layout
    df = spark.createDataFrame([(1, 0, ","), (1, 1, "a"), (1, 2, "!"), (1, 3, "b"), (None, 0, "c"), (None, 1, "?")], "d int, i int, t string")
    pieces = sq.attach_punctuation(df, ["d"], ["i"], "t", F.col("t").rlike("[a-z]"))
    assert {tuple(r) for r in pieces.collect()} == {(1, 1, ","), (1, 2, "a!"), (1, 3, "b"), (None, 1, "c?")}
    widths = layout.allocate_width(df.withColumns({"x": F.lit(0.1), "w": F.lit(0.8)}), ["d"], "i", "t", "x", "w")
    assert {r.i: round(r.x + r.w, 9) for r in widths.collect() if r.d == 1}[3] == 0.9
    for done in (pieces, widths):
        plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert "SortMergeJoin" not in plan and plan.count("Exchange") == 1


def test_expansion_shift_in_one_shuffle(spark):
    r = random.Random(12)
    rows = [(r.choice([None, *range(40)]), n, r.choice([None, *[float(k) for k in range(60)]]), r.choice([0.0, 0.5, 1.0, 7.0, 15.0, None]), r.choice([None, 3.0, 9.0, 20.0])) for n in range(600)]
    df = spark.createDataFrame(rows, "page int, id int, top double, height double, required double")
    done = sq.expansion_shift(df, ["page"], ["id"], "top", "height", "required")
    low = float("-inf")  # a row without a place stands before all others
    want = {}
    for page in {x[0] for x in rows}:
        here = sorted(((low if x[2] is None else x[2], x[1], x[3], x[4]) for x in rows if x[0] == page))
        bands, reach = [], None
        for top, _, h, need in here:
            if h and need is not None:
                if reach is None or top >= reach - 1:
                    bands.append([low, 0.0])
                bands[-1] = [max(bands[-1][0], top + h), max(bands[-1][1], need - h)]
                reach = reach if top == low else max(top + h, reach or low)
        want |= {n: sum(extra for end, extra in bands if end <= top + 1) for top, n, _, _ in here}
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {x.id: x.shift for x in done.collect()} == want
