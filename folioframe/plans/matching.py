"""Example queries for key joins, revisions, prices and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from ..operators.sequences import millis
from .demo import demo


@demo("dictionary_fill", """
SELECT n_nationkey, coalesce(CASE WHEN r_regionkey < 3 THEN r_name END, n_name) AS label FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    d = t.region.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label"))
    n = t.nation.select("n_nationkey", F.col("n_regionkey").alias("key"), F.col("n_name").alias("label"))
    return mt.dictionary_fill(n, d, ["key"], "label").select("n_nationkey", "label")


_PARTS = """(SELECT p_partkey, lower(p_brand) AS b, lower(p_name) AS n, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS v FROM part)"""


@demo("translation_memory", f"SELECT b || chr(10) || n AS memory_key, min(v) AS value FROM {_PARTS} WHERE v <> '' GROUP BY ALL HAVING count(DISTINCT v) = 1")
def _(t):
    return mt.translation_memory(_memory_parts(t), "p_brand", "p_name", "value")


def _memory_parts(t):
    value = F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).otherwise("")
    return t.part.select("p_partkey", F.concat(F.lit(" "), F.upper("p_brand")).alias("p_brand"), "p_name", value.alias("value"))


@demo("restore_translations", f"""
WITH m AS (SELECT b, n, min(v) AS value FROM {_PARTS} WHERE v <> '' GROUP BY ALL HAVING count(DISTINCT v) = 1)
SELECT p_partkey, CASE WHEN v <> '' THEN v ELSE value END AS value, v = '' AND value IS NOT NULL AS restored FROM {_PARTS} p LEFT JOIN m ON m.b = p.b AND m.n = p.n""")
def _(t):
    p = _memory_parts(t)
    return mt.restore(p, mt.translation_memory(p, "p_brand", "p_name", "value"), "p_brand", "p_name", "value").select("p_partkey", "value", "restored")


@demo("missing_from", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    return mt.missing_from(t.customer, t.orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@demo("require_existing", """
SELECT l_orderkey, l_linenumber, l_extendedprice, 'l_partkey' AS reference, CAST(l_partkey AS VARCHAR) AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice, 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000)""")
def _(t):
    refs = [("l_partkey", t.part.filter("p_size > 5"), "p_partkey"), ("l_suppkey", t.supplier.filter("s_acctbal > 1000"), "s_suppkey")]
    return mt.require_existing(t.lineitem, refs, ["l_orderkey", "l_linenumber", "l_extendedprice"])


@demo("reconcile", """
SELECT coalesce(l_partkey, p_partkey) AS track, coalesce(n, 0) AS pages, a AS first_page, b AS last_page, CASE WHEN l_partkey IS NULL THEN 'unused' WHEN p_partkey IS NULL THEN 'missing' ELSE 'playable' END AS state
FROM (SELECT l_partkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1) FULL JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def _(t):
    marks = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("track"), "l_orderkey")
    return mt.reconcile(marks, t.part.filter("p_size > 10").select(F.col("p_partkey").alias("track")), "track", "l_orderkey")


@demo("missing_marks", "SELECT DISTINCT l_partkey AS track, l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(t):
    marks = t.lineitem.select(F.col("l_partkey").alias("track"), "l_orderkey")
    return mt.missing_marks(marks, t.part.filter("p_size > 10").select(F.col("p_partkey").alias("track")), "track", "l_orderkey")


@demo("next_larger", "SELECT p_partkey, coalesce((SELECT min(s) FROM (SELECT DISTINCT p_size // 7 * 8 AS s FROM part WHERE p_size < 40) WHERE s >= p_size), (SELECT max(p_size // 7 * 8) FROM part WHERE p_size < 40)) AS step FROM part")
def _(t):
    steps = t.part.filter("p_size < 40").select((F.floor(F.col("p_size") / 7) * 8).cast("int").alias("s")).distinct()
    return mt.next_larger(t.part, steps, "p_size", "s").select("p_partkey", "step")


@demo("match_alias", """
WITH s AS (SELECT c_custkey, lower(c_mktsegment) || (c_custkey % 40) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'household' || (c_nationkey % 7) END AS second FROM customer), a AS (SELECT DISTINCT p_type || p_size AS character, p_size * 10 + length(p_type) AS place, CASE WHEN p_size % 2 = 0 THEN 'household' || p_size ELSE left('furniture', 4) || CASE WHEN p_size > 25 THEN '' ELSE 'x' END END AS alias FROM part),
e AS (SELECT c_custkey, min((place, character)) AS h FROM s JOIN a ON alias IN (key, second) GROUP BY 1), p AS (SELECT c_custkey, min((place, character)) AS h FROM s JOIN a ON (contains(alias, key) AND length(key) >= 3) OR (length(alias) >= 3 AND (contains(key, alias) OR contains(second, alias))) OR contains(alias, second) GROUP BY 1)
SELECT s.c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN key = 'building3' THEN NULL WHEN key = 'machinery7' THEN 'PROMO1' ELSE coalesce(e.h[2], p.h[2]) END AS character,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN key = 'building3' THEN NULL WHEN key = 'machinery7' THEN 'manual' WHEN e.h IS NOT NULL THEN 'exact' WHEN p.h IS NOT NULL THEN 'partial' END AS tier
FROM s LEFT JOIN e USING (c_custkey) LEFT JOIN p USING (c_custkey)""")
def _(t):
    s = t.customer.select("c_custkey", F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 40)).alias("key"),
                            F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("household"), F.col("c_nationkey") % 7)).alias("second"))
    size = F.col("p_size")
    alias = F.when(size % 2 == 0, F.concat(F.lit("household"), size)).otherwise(F.concat(F.lit("furn"), F.when(size > 25, "").otherwise("x")))
    a = t.part.select(F.concat("p_type", size).alias("character"), (size * 10 + F.length("p_type")).alias("place"), alias.alias("alias")).distinct()
    manual = t.spark.createDataFrame([("building3", "none"), ("machinery7", "PROMO1")], "key string, character string")
    return mt.match_alias(s, a, manual, key=["key", "second"], group=F.col("c_custkey") % 11 == 0).select("c_custkey", "character", "tier")


def _revision(t):
    """An old and a new revision of the documents: some ids lost, some texts changed, some values missing."""
    d = t.documents
    i = F.col("doc_id")
    base = [F.col("source").alias("page"), F.col("lang").alias("type"), i.alias("place")]
    old = d.select(*base, F.concat(F.lit("o"), i).alias("id"), F.sha1("text").alias("hash"), F.when(i % 5 != 0, F.concat(F.lit("v"), i)).alias("value"), "text")
    text = F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 13 <> 0").select(*base, F.when(i % 3 != 0, F.concat(F.lit("o"), i)).alias("id"), F.sha1(text).alias("hash"),
                                              F.when(i % 10 == 1, F.concat(F.lit("w"), i)).alias("value"), text.alias("text"))
    return new, old


_REV = """o AS (SELECT source AS page, lang AS type, doc_id AS place, 'o' || doc_id AS id, sha1(text) AS hash, CASE WHEN doc_id % 5 <> 0 THEN 'v' || doc_id END AS value, text FROM documents),
n AS (SELECT source AS page, lang AS type, doc_id AS place, CASE WHEN doc_id % 3 <> 0 THEN 'o' || doc_id END AS id, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash,
  CASE WHEN doc_id % 10 = 1 THEN 'w' || doc_id END AS value, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0),
a AS (SELECT n.*, o.id AS mid FROM n LEFT JOIN o ON o.page = n.page AND o.id = n.id),
fo AS (SELECT *, row_number() OVER (PARTITION BY page, type, hash ORDER BY place) AS k FROM o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page = o.page AND a.mid = o.id)),
fn AS (SELECT *, row_number() OVER (PARTITION BY page, type, hash ORDER BY place) AS k FROM a WHERE mid IS NULL),
m AS (SELECT page, type, place, id, hash, value, mid FROM a WHERE mid IS NOT NULL UNION ALL SELECT fn.page, fn.type, fn.place, fn.id, fn.hash, fn.value, fo.id FROM fn LEFT JOIN fo ON fo.page = fn.page AND fo.type = fn.type AND fo.hash = fn.hash AND fo.k = fn.k)"""


@demo("match_revision", f"WITH {_REV} SELECT page, place, mid AS matched_id, coalesce(mid, id) IS NULL AS fresh FROM m")
def _(t):
    new, old = _revision(t)
    done = mt.match_revision(new, old, ["page"], "id", ["type", "hash"], ["place"])
    return done.select("page", "place", "matched_id", F.col("block_id").startswith("b-").alias("fresh"))


@demo("carry_translations", f"WITH {_REV} SELECT m.page, m.place, coalesce(m.value, CASE WHEN o.hash = m.hash THEN o.value END) AS value FROM m LEFT JOIN o ON o.page = m.page AND o.id = m.mid")
def _(t):
    new, old = _revision(t)
    matched = mt.match_revision(new, old, ["page"], "id", ["type", "hash"], ["place"])
    return mt.carry_translations(matched, old, ["page"], "id", "hash", "value").select("page", "place", "value")


@demo("revision_regressions", f"""
WITH {_REV}, h AS (SELECT * FROM o WHERE value IS NOT NULL AND type <> 'de'), w AS (SELECT * FROM n WHERE value IS NOT NULL),
r AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.page = h.page AND w.id = h.id) AND NOT EXISTS (SELECT 1 FROM w WHERE w.page = h.page AND w.type = h.type AND w.hash = h.hash)
  AND NOT EXISTS (SELECT 1 FROM w WHERE w.page = h.page AND w.place = h.place AND regexp_matches(h.text, '[\\p{{L}}\\p{{N}}]')))
SELECT page, id, value AS lost_value FROM r""")
def _(t):
    new, old = _revision(t)
    return mt.revision_regressions(new, old, ["page"], "id", "value", alternate=["type", "hash"], region=["place"], text="text", optional=F.col("type") == "de")


@demo("correct_by_consensus", """
WITH w AS (SELECT p_brand AS g, p_partkey, split_part(p_name, ' ', 2) AS word FROM part), n AS (SELECT g, p_partkey, CASE WHEN p_partkey % 17 = 0 THEN left(word, length(word) - 1) || 'x' ELSE word END AS name FROM w),
s AS (SELECT DISTINCT g, word AS name FROM w WHERE p_partkey % 5 <> 0), k AS (SELECT name FROM s WHERE name IN (SELECT name FROM n) GROUP BY name HAVING count(*) >= 2),
c AS (SELECT d.g, d.name, min(s.name) AS corrected FROM (SELECT DISTINCT g, name FROM n) d JOIN s ON s.g = d.g AND length(s.name) = length(d.name) AND hamming(s.name, d.name) = 1
  WHERE s.name IN (SELECT name FROM k) AND NOT EXISTS (SELECT 1 FROM s x WHERE x.g = d.g AND x.name = d.name) AND length(d.name) >= 2 GROUP BY ALL)
SELECT p_partkey, n.g AS brand, n.name AS name, corrected FROM n LEFT JOIN c ON c.g = n.g AND c.name = n.name""")
def _(t):
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    w = t.part.select(F.col("p_brand").alias("brand"), "p_partkey", word.alias("word"))
    typo = F.when(F.col("p_partkey") % 17 == 0, F.concat(F.expr("left(word, length(word) - 1)"), F.lit("x"))).otherwise(F.col("word"))
    names = w.select("brand", "p_partkey", typo.alias("name"))
    evidence = w.withColumn("confidence", F.when(F.col("p_partkey") % 5 != 0, 0.95).otherwise(0.5))
    return mt.correct_by_consensus(names, evidence, "brand", "name", "word", "confidence").select("p_partkey", "brand", "name", "corrected")


@demo("merge_fill_empty", """
WITH p AS (SELECT c_custkey, c_mktsegment || (c_custkey % 200) AS name, CASE WHEN c_acctbal > 5000 THEN '' ELSE c_name END AS role, CASE WHEN c_acctbal > 8000 THEN 'n' || c_nationkey ELSE '' END AS style FROM customer),
c AS (SELECT lower(name) AS k, arg_min(name, c_custkey) AS name, arg_min(role, c_custkey) FILTER (role <> '') AS role, arg_min(style, c_custkey) FILTER (style <> '') AS style FROM p WHERE c_custkey % 2 = 0 GROUP BY 1),
i AS (SELECT lower(name) AS k, arg_min(name, c_custkey) AS name, arg_min(role, c_custkey) FILTER (role <> '') AS role, arg_min(style, c_custkey) FILTER (style <> '') AS style FROM p WHERE c_custkey % 2 = 1 GROUP BY 1)
SELECT coalesce(c.name, lower(i.name)) AS name, coalesce(c.role, i.role) AS role, coalesce(c.style, i.style) AS style, c.k IS NULL AS added FROM c FULL JOIN i ON c.k = i.k""")
def _(t):
    p = t.customer.select("c_custkey", F.concat("c_mktsegment", F.col("c_custkey") % 200).alias("name"), F.when(F.col("c_acctbal") > 5000, "").otherwise(F.col("c_name")).alias("role"),
                          F.when(F.col("c_acctbal") > 8000, F.concat(F.lit("n"), "c_nationkey")).otherwise("").alias("style"))
    new = p.filter("c_custkey % 2 = 1").withColumn("name", F.concat(F.lit(" "), F.lower("name")))
    return mt.merge_fill_empty(p.filter("c_custkey % 2 = 0"), new, "name", "c_custkey", ["role", "style"])


@demo("merge_keep_existing", """
SELECT p_partkey, p_name FROM part WHERE p_size <= 30 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 30""")
def _(t):
    current = t.part.filter("p_size <= 30").select("p_partkey", "p_name")
    return mt.merge_keep_existing(current, t.part.filter("p_size > 20").select("p_partkey", F.col("p_brand").alias("p_name")), ["p_partkey"])


_SKUS = """(SELECT 'm' || (s_suppkey % 7) AS model, CASE s_suppkey % 6 WHEN 0 THEN 'duration_seconds_720p' WHEN 1 THEN 'cents_per_second_with_audio' WHEN 2 THEN 'output_second_without_audio_1080p' WHEN 3 THEN 'video_tokens' WHEN 4 THEN 'minimum_cents' ELSE 'text_to_video_per_second' END AS sku, s_acctbal / 1000 AS price FROM supplier WHERE s_acctbal > 0)"""


@demo("price_estimate", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, 'm' || (l_suppkey % 8) AS model, CASE l_returnflag WHEN 'A' THEN '720p' WHEN 'N' THEN '1080p' ELSE '' END AS res, l_linestatus = 'O' AS audio, l_quantity AS duration FROM lineitem),
c AS (SELECT DISTINCT model, res, audio FROM r), o AS (SELECT c.*, sku, price, CASE WHEN res <> '' AND contains(sku, res) THEN 4 WHEN regexp_matches(sku, '[0-9]+p|4k|2k') THEN -3 ELSE 0 END
  + CASE WHEN audio THEN CASE WHEN contains(sku, 'with_audio') THEN 2 WHEN contains(sku, 'without_audio') THEN -2 ELSE 0 END ELSE CASE WHEN contains(sku, 'without_audio') THEN 2 WHEN contains(sku, 'with_audio') THEN -2 ELSE 0 END END
  + CASE WHEN contains(sku, 'text_to_video') THEN 1 ELSE 0 END AS score, regexp_matches(sku, 'duration_seconds|per_second|output_second') AS sec FROM c JOIN {_SKUS} s ON s.model = c.model),
b AS (SELECT model, res, audio, arg_max(price * CASE WHEN contains(sku, 'cents') THEN .01::DOUBLE ELSE 1 END, (audio AND contains(sku, 'with_audio'), score, -price, sku)) FILTER (sec) AS ps,
  arg_max(price, (score, -price, sku)) FILTER (sku = 'video_tokens') AS tp, min(price) FILTER (sku = 'minimum_cents') AS mn FROM o GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN coalesce(ps, tp) IS NOT NULL THEN round(greatest(coalesce(ps * duration, tp * (CASE r.res WHEN '1080p' THEN 1920 * 1080 ELSE 1280 * 720 END * 24 * duration / 1024)), mn / 100), 6) END AS usd FROM r LEFT JOIN b ON b.model = r.model AND b.res = r.res AND b.audio = r.audio""")
def _(t):
    k = F.col("s_suppkey") % 6
    sku = (F.when(k == 0, "duration_seconds_720p").when(k == 1, "cents_per_second_with_audio").when(k == 2, "output_second_without_audio_1080p").when(k == 3, "video_tokens")
           .when(k == 4, "minimum_cents").otherwise("text_to_video_per_second"))
    skus = t.supplier.select(F.concat(F.lit("m"), F.col("s_suppkey") % 7).alias("model"), sku.alias("sku"), (F.col("s_acctbal") / 1000).alias("price"))
    flag = F.col("l_returnflag")
    r = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat(F.lit("m"), F.col("l_suppkey") % 8).alias("model"),
                          F.when(flag == "A", "720p").when(flag == "N", "1080P").otherwise("").alias("resolution"), F.lit("16:9").alias("aspect"),
                          (F.col("l_linestatus") == "O").alias("audio"), F.col("l_quantity").alias("duration"))
    return mt.price_estimate(r, skus).select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("usd", 6).alias("usd"))


@demo("state_matrix", """
WITH e AS (SELECT user_id AS id, day(ts) AS n, max(CASE WHEN event_type IN ('click', 'view') AND value > 60 THEN CASE event_type WHEN 'click' THEN 'queued' ELSE 'running' END END) AS job,
  bool_or(event_type = 'purchase') AS lay, bool_or(event_type = 'error') AS err, max(epoch_us(ts) // 1000) FILTER (event_type = 'view') AS ch, max(epoch_us(ts) // 1000) FILTER (event_type = 'signup') AS pu FROM events GROUP BY ALL)
SELECT g.id, g.n, coalesce(job, CASE WHEN lay THEN 'done' WHEN err THEN 'error' END, 'none') AS state, coalesce(job IS NULL AND lay AND ch > pu + 2000, false) AS stale
FROM (SELECT id, unnest(generate_series(1, 20 + id % 11)) AS n FROM (SELECT DISTINCT user_id AS id FROM events)) g LEFT JOIN e ON e.id = g.id AND e.n = g.n""")
def _(t):
    e = t.events.select(F.col("user_id").alias("id"), F.dayofmonth("ts").cast("long").alias("n"), "event_type", "value", millis("ts").alias("ms"))
    kind = F.col("event_type")
    jobs = e.filter("event_type IN ('click', 'view') AND value > 60").select("id", "n", F.when(kind == "click", "queued").otherwise("running").alias("state"))
    facts = e.groupBy("id", "n").agg(F.bool_or(kind == "purchase").alias("has_layout"), F.bool_or(kind == "error").alias("failed"),
                                     F.max(F.when(kind == "view", F.col("ms"))).alias("changed_ms"), F.max(F.when(kind == "signup", F.col("ms"))).alias("published_ms"))
    books = e.select("id").distinct().withColumn("pages", 20 + F.col("id") % 11)
    return mt.state_matrix(books, "id", "pages", jobs, facts)
