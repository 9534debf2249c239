"""Example queries for sources and whole-table operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.records import content_digest
from ..operators import tables as tb
from ..operators.contracts import violations
from ..operators.lineage import work_folder
from ..sources import pages as pg
from ..sources.versions import write_checked
from .demo import demo


@demo("ingest_ocr_tsv", """
SELECT event_id, event_type AS text, round(user_id / 2342, 6) AS x, round(CAST(json_extract(props, '$.k') AS INT) / 3190, 6) AS y, round(40 / 2342, 6) AS w, round(20 / 3190, 6) AS h
FROM events WHERE value >= 25 AND event_type <> 'error' AND event_type <> 'view'""")
def _(t):
    kind = F.col("event_type")
    word = F.when(kind == "error", "  ").otherwise(F.concat(F.lit(" "), kind, F.lit(" ")))
    rows = t.events.select("event_id", F.lit("5").alias("level"), F.col("value").cast("string").alias("conf"), word.alias("text"), F.col("user_id").cast("string").alias("left"),
                           F.when(kind == "view", "n/a").otherwise(F.get_json_object("props", "$.k")).alias("top"), F.lit("40").alias("width"), F.lit("20").alias("height"))
    return pg.ingest_ocr_tsv(rows, F.lit(2342), F.lit(3190))


@demo("ordered_catalog", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END, o_orderdate, o_orderkey) AS position FROM orders""")
def _(t):
    df = t.orders.withColumn("key", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return tb.ordered_catalog(df, "key", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@demo("upsert", """
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) = 1""")
def _(t):
    e = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    done = tb.upsert(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"])
    return done.select("user_id", "event_id", "event_type", "value")


@demo("replace_partition", """
SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT s_suppkey, s_nationkey, s_name FROM supplier WHERE s_acctbal > 5000""")
def _(t):
    new = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("c_name"))
    return tb.replace_partition(t.customer.select("c_custkey", "c_nationkey", "c_name"), new, ["c_nationkey"])


@demo("manifest_upsert", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS version, length(html) AS size FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0""")
def _(t):
    p = t.pages.select("page_id", F.length("html").alias("size"))
    old = p.filter("page_id % 2 = 0").withColumn("version", F.lit("old"))
    return tb.manifest_upsert(old, p.filter("page_id % 3 = 0").withColumn("version", F.lit("new")), ["page_id"])


@demo("inventory", """
SELECT DISTINCT 'book-' || (o_custkey % 40) AS book, CAST(o_orderkey AS INT) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 40 IN (SELECT o_custkey % 40 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 480000)""")
def _(t):
    book = F.concat(F.lit("library/book-"), F.col("o_custkey") % 40)
    name = F.when(F.col("o_orderstatus") == "F", "layout.json").otherwise("scan.png")
    files = t.orders.select(F.concat(book, F.lit("/pages/"), F.lpad("o_orderkey", 9, "0"), F.lit("/"), name).alias("path")).unionByName(
        t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 480000").select(F.concat(book, F.lit("/book.json")).alias("path")))
    return pg.inventory(files)


@demo("allowlisted_export", """
SELECT count(*) AS rows, count(*) FILTER (lang NOT IN ('en', 'fr')) AS lang, count(*) FILTER (n_chars > 10000) AS size FROM documents""")
def _(t):
    return tb.allowlisted_export(t.documents, {"lang": F.col("lang").isin("en", "fr"), "size": F.col("n_chars") <= 10000})


@demo("referenced_copies", """
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:src|href|data-src)="([^"<>]+)"', 1)) AS url FROM pages), f AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS file FROM l),
k AS (SELECT file FROM f GROUP BY file HAVING count(DISTINCT page_id) > 1)
SELECT page_id, url, file, file NOT IN (SELECT file FROM k) AS missing FROM f""")
def _(t):
    links = pg.references(t.pages, "html", "page_id").withColumn("file", F.regexp_replace("url", "[?#].*$", ""))
    known = links.groupBy("file").agg(F.countDistinct("page_id").alias("n")).filter("n > 1")
    return pg.referenced_copies(t.pages, "html", "page_id", known)


_MEMO = "(SELECT doc_id, sha256('{\"text\":' || to_json(text) || '}') AS h, lang AS code, source AS prompt FROM documents)"


@demo("memo_join", f"""
WITH c AS (SELECT h, code, min(doc_id) AS doc_id FROM {_MEMO} WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT m.doc_id, c.doc_id IS NOT NULL AS reused, c.doc_id AS result, c.doc_id IS NOT NULL AND m.prompt <> p.source AS review
FROM {_MEMO} m LEFT JOIN c ON c.h = m.h AND c.code = m.code LEFT JOIN documents p ON p.doc_id = c.doc_id""")
def _(t):
    work = t.documents.select("doc_id", content_digest("text").alias("h"), F.col("lang").alias("code"), F.col("source").alias("prompt"))
    cache = work.filter("doc_id % 2 = 0").groupBy("h", "code").agg(F.min("doc_id").alias("result"), F.min_by("prompt", "doc_id").alias("prompt"))
    return tb.memo_join(work, cache, "h", "code", "result", "prompt").select("doc_id", "reused", "result", "review")


@demo("memo_misses", f"SELECT doc_id FROM {_MEMO} m WHERE NOT EXISTS (SELECT 1 FROM {_MEMO} c WHERE c.doc_id % 2 = 0 AND c.h = m.h AND c.code = m.code)")
def _(t):
    work = t.documents.select("doc_id", content_digest("text").alias("h"), F.col("lang").alias("code"))
    return tb.memo_misses(work, work.filter("doc_id % 2 = 0"), "h", "code").select("doc_id")


@demo("batch_status", """
SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_totalprice > 250000 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'error' END AS state FROM orders) GROUP BY state""")
def _(t):
    h = F.col("o_custkey")
    items = t.orders.select("o_orderkey", h.alias("source_hash"))
    done = t.orders.filter("o_orderstatus <> 'O'").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, h + 1).otherwise(h).alias("source_hash"),
                                                           F.when(F.col("o_orderstatus") == "F", "done").otherwise("error").alias("state"))
    return tb.status_counts(tb.batch_status(items, done, ["o_orderkey"], "source_hash"))


@demo("commit_version", "SELECT 1 + o_orderkey % 2 AS version, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def _(t):
    path = f"{work_folder(t.spark)}/orders-{uuid.uuid4().hex}"
    rules = lambda df: violations(df, ["o_orderkey"], {"price": F.col("o_totalprice") > 0})
    for version in (1, 2):
        write_checked(t.orders.filter(F.col("o_orderkey") % 2 == version - 1), path, version, rules)
    return t.spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@demo("check_signatures")
def _(t):
    # Each document as a file: some with the leading bytes that their names promise, others without, of another type or empty.
    kind = F.element_at(F.array(*map(F.lit, ("png", "jpg", "webp", "parquet", "txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    marks = F.element_at(F.array(*map(F.lit, ("89504E470D0A1A0A", "FFD8FF", "524946460000000057454250", "50415231", ""))), (F.col("doc_id") % 7 % 5 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 11 == 0, F.lit("").cast("binary")).otherwise(F.concat(F.unhex(marks), F.coalesce("text", F.lit("")).cast("binary")))
    files = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), kind).alias("file"), body.alias("body"))
    heads = files.select("file", F.octet_length("body").cast("long").alias("length"), F.substring("body", 1, 12).alias("head"))
    return heads.select("file", "length", pg.signature_verdict(F.col("file"), F.col("head"), F.col("length")).alias("verdict"))
