"""Example queries for aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as ru
from ..operators import sets
from .demo import demo


def kind(name):
    return F.col("event_type") == name


_JOURNAL = """(SELECT event_id, ts, event_type AS model, 'p' || (user_id % 3) AS provider, CASE WHEN user_id % 2 = 0 THEN 'image' ELSE 'video' END AS kind,
  CASE WHEN event_id % 7 <> 0 THEN value END AS cost, user_id % 5 = 0 AS subscription, CASE WHEN event_id % 3 = 0 THEN CAST(greatest(1, least(5, floor(value / 10 + .5))) AS INT) END AS rating FROM events)"""


def _journal(t):
    e = t.events
    from ..functions.text import clamp_rating
    return e.select("event_id", "ts", F.col("event_type").alias("model"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"),
                    F.when(F.col("user_id") % 2 == 0, "image").otherwise("video").alias("kind"),
                    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("cost"), (F.col("user_id") % 5 == 0).alias("subscription"),
                    F.when(F.col("event_id") % 3 == 0, clamp_rating(F.col("value") / 10)).alias("rating"))


@demo("model_rollup", f"""
SELECT provider, model, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, round(coalesce(sum(cost) FILTER (NOT subscription), 0), 2) AS cost,
  count(cost) FILTER (NOT subscription) AS priced, count(*) FILTER (subscription) AS subscription, count(rating) AS rated, round(avg(rating), 4) AS avg_rating FROM {_JOURNAL} GROUP BY ALL""")
def _(t):
    r = ru.model_rollup(_journal(t), ["provider", "model"], "kind", "cost", "subscription", "rating")
    return r.withColumns({"cost": F.round("cost", 2), "avg_rating": F.round("avg_rating", 4)})


@demo("journal_totals", f"""
SELECT count(*) AS entries, count(*) FILTER (kind = 'image') AS first_kind, count(*) FILTER (kind <> 'image') AS other_kinds, round(sum(CASE WHEN subscription THEN 0 ELSE coalesce(cost, 0) END), 2) AS spend,
  count(*) FILTER (subscription) AS subscription, count(rating) AS rated FROM {_JOURNAL}""")
def _(t):
    return ru.journal_totals(_journal(t), "kind", "image", "cost", "subscription", "rating").withColumn("spend", F.round("spend", 2))


@demo("group_rollup", """
SELECT quality, count(*) AS n, max(n_chars) AS last FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""")
def _(t):
    return ru.group_rollup(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", "quality", "n_chars")


@demo("dedup_richest", """
WITH RECURSIVE d AS (SELECT doc_id, sha1(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END AS model, source AS provider, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS purpose,
   CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS page, CASE WHEN doc_id % 10 = 0 THEN 'k' || (doc_id % 50) ELSE '' END AS skey FROM documents),
e AS (SELECT doc_id, skey, digest, row_number() OVER (ORDER BY doc_id) AS n FROM d WHERE skey <> ''),
r(n, ks, hs) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT e.n, CASE WHEN list_contains(ks, skey) OR list_contains(hs, digest) THEN ks ELSE list_append(ks, skey) END,
  CASE WHEN list_contains(ks, skey) OR list_contains(hs, digest) THEN hs ELSE list_append(hs, digest) END FROM r JOIN e ON e.n = r.n + 1),
u AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM e JOIN r ON r.n = e.n - 1 WHERE list_contains(ks, skey)))
SELECT min(doc_id) AS doc_id, digest, arg_min(purpose, doc_id) FILTER (purpose <> '') AS purpose, arg_min(page, doc_id) FILTER (page IS NOT NULL) AS page,
  coalesce(arg_min(model, doc_id) FILTER (model <> 'unknown'), 'unknown') AS model,
  coalesce(arg_min(provider, doc_id) FILTER (model <> 'unknown'), arg_min(provider, doc_id)) AS provider, arg_min(skey, doc_id) FILTER (skey <> '') AS skey, count(*) AS copies FROM u GROUP BY digest""")
def _(t):
    i = F.col("doc_id")
    d = t.documents.select("doc_id", F.sha1("text").alias("digest"), F.when(i % 3 == 0, "unknown").otherwise(F.col("lang")).alias("model"), F.col("source").alias("provider"),
                           F.when(i % 4 == 0, "").otherwise(F.col("source")).alias("purpose"), F.when(i % 5 != 0, F.col("n_chars")).alias("page"),
                           F.when(i % 10 == 0, F.concat(F.lit("k"), i % 50)).otherwise("").alias("skey"))
    done = ru.dedup_richest(d, "skey", "digest", ["doc_id"], ["purpose", "page"], {"model": ["provider"]})
    return done.select("doc_id", "digest", "purpose", "page", "model", "provider", "skey", "copies")


_DAY = "CAST(ts + INTERVAL 5 HOUR AS DATE)"


@demo("daily_activity", f"""
SELECT * FROM (SELECT user_id, {_DAY} AS day, round(sum(greatest(value - 5, 0)), 2) AS seconds, count(DISTINCT props) AS words FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 20""", day="VARCHAR")
def _(t):
    df = t.events.withColumn("seconds", F.col("value") - 5)
    return ru.daily_activity(df, ["user_id"], "ts", "seconds", "props", keep=20).withColumns({"seconds": F.round("seconds", 2), "day": F.col("day").cast("string")})


@demo("week_series", f"""
WITH a AS (SELECT max({_DAY}) AS d FROM events), w AS (SELECT CAST(d - CAST(isodow(d) - 1 AS INT) + CAST(i AS INT) AS DATE) AS day FROM a, generate_series(0, 6) AS g(i))
SELECT day, CAST(floor(coalesce(sum(value), 0) / 60 + .5) AS BIGINT) AS minutes, count(DISTINCT props) AS words FROM w LEFT JOIN events ON {_DAY} = day GROUP BY day""", day="VARCHAR")
def _(t):
    anchor = t.events.agg(F.max(ru.local_day("ts"))).scalar()
    return ru.week_series(t.events, "ts", "value", "props", anchor).withColumn("day", F.col("day").cast("string"))


@demo("month_buckets", f"""
SELECT b * 7 + 1 AS first_day, least(b * 7 + 7, 31) AS last_day, CAST(floor(coalesce(sum(value), 0) / 60 + .5) AS BIGINT) AS minutes, count(DISTINCT props) AS words
FROM generate_series(0, 4) AS g(b) LEFT JOIN (SELECT *, (day({_DAY}) - 1) // 7 AS bucket FROM events WHERE date_trunc('month', {_DAY}) = DATE '2024-01-01') ON bucket = b GROUP BY b""")
def _(t):
    return ru.month_buckets(t.events, "ts", "value", "props", F.lit("2024-01-15").cast("date"))


@demo("coverage", "SELECT lang, count(*) AS total, count(quality) AS translated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def _(t):
    df = t.documents.join(t.labels, "doc_id", "left").withColumn("quality", F.col("quality").cast("string"))
    return ru.coverage(df, ["lang"], "quality")


@demo("missing_fields", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    df = t.documents.join(t.labels, "doc_id", "left").withColumn("quality", F.col("quality").cast("string"))
    return ru.missing_fields(df, "quality", ["doc_id", "lang"])


@demo("contract_state", """
SELECT o_orderkey, count(*) FILTER (l_quantity > 45) AS errors, count(*) FILTER (l_discount > .08) AS warnings,
  CASE WHEN count(*) FILTER (l_quantity > 45) > 0 THEN 'failed' WHEN count(*) FILTER (l_discount > .08) > 0 THEN 'review' ELSE 'passed' END AS state
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _(t):
    rules = F.array_compact(F.array(F.when(F.col("l_quantity") > 45, "error"), F.when(F.col("l_discount") > 0.08, "warning")))
    v = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(rules).alias("severity"))
    return ru.contract_state(t.orders, v, ["o_orderkey"])


@demo("binned_mode", """
SELECT l_returnflag, b * 8 + 4 AS centre, round(c / n, 6) AS share, n FROM (SELECT *, sum(c) OVER (PARTITION BY l_returnflag) AS n FROM (
  SELECT l_returnflag, CAST(l_quantity AS BIGINT) >> 3 AS b, count(*) AS c FROM lineitem GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY c DESC, b) = 1""", n="BIGINT")
def _(t):
    return ru.binned_mode(t.lineitem, ["l_returnflag"], "l_quantity").withColumn("share", F.round("share", 6))


@demo("median_stats", """
SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_suppkey""")
def _(t):
    return ru.median_stats(t.lineitem, ["l_suppkey"], "l_extendedprice").withColumn("median", F.round("median", 4))


@demo("build_documents", """
WITH p AS (SELECT o_custkey % 50 AS book, o_custkey AS lesson, o_orderkey AS page, o_orderstatus AS status, o_orderpriority AS section, o_orderdate FROM orders)
SELECT book, lesson, page, row_number() OVER w AS position, first_value(section) OVER w AS section,
  coalesce(first_value(CASE WHEN status = 'P' THEN CAST(page AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY book, lesson ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), CAST(first_value(page) OVER w AS VARCHAR)) AS lesson_title,
  count(*) OVER (PARTITION BY book, lesson) AS pages, printf('%d-%03d', book, lesson) AS lesson_id, printf('%d|%04d', book, lesson) AS sort_key,
  CASE WHEN first_value(section) OVER w = '5-LOW' THEN 'workbook' ELSE 'textbook' END AS kind FROM p WINDOW w AS (PARTITION BY book, lesson ORDER BY page)""")
def _(t):
    p = t.orders.select((F.col("o_custkey") % 50).alias("book"), F.col("o_custkey").alias("lesson"), F.col("o_orderkey").alias("page"),
                        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").cast("string").alias("title"))
    done = ru.build_documents(p, "book", "lesson", "page", ["section"], "title", F.col("status") == "P", F.when(F.col("section") == "5-LOW", "workbook").otherwise("textbook"))
    return done.select("book", "lesson", "page", "position", "section", "lesson_title", "pages", "lesson_id", "sort_key", "kind")


@demo("distinct_first", """
WITH u AS (SELECT p_name AS native, p_brand AS reading, p_type AS trans, 0 AS source, p_partkey AS no FROM part WHERE p_size > 25
  UNION ALL SELECT p_name, ' ' || lower(p_brand), p_type, 1, p_partkey FROM part WHERE p_size <= 25 OR p_type = 'PROMO')
SELECT native, lower(regexp_replace(reading, '\\s+', '', 'g')) AS reading, arg_min(trans, (source, no)) AS trans, arg_min(source, (source, no)) AS source, arg_min(no, (source, no)) AS no FROM u WHERE trans <> 'SMALL' GROUP BY 1, 2""")
def _(t):
    cols = [F.col("p_name").alias("native"), F.col("p_type").alias("trans"), F.col("p_partkey").alias("no")]
    a = t.part.filter("p_size > 25").select(*cols, F.col("p_brand").alias("reading"))
    b = t.part.filter("p_size <= 25 OR p_type = 'PROMO'").select(*cols, F.concat(F.lit(" "), F.lower("p_brand")).alias("reading"))
    done = ru.distinct_first([a, b], "native", "reading", F.col("trans") != "SMALL", ["no"])
    return done.select("native", F.lower(F.regexp_replace("reading", "\\s+", "")).alias("reading"), "trans", "source", "no")


@demo("symbol_inventory", """
WITH c AS (SELECT doc_id, unnest(generate_series(1, len(k))) AS p, k FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x7f]') AS k FROM documents)),
f AS (SELECT k[p] AS symbol, min((doc_id, p)) AS at_ FROM c GROUP BY 1),
b AS (SELECT coalesce(f.symbol, v.symbol) AS symbol, v.position AS kept, f.at_, v.reading FROM f FULL JOIN (VALUES ('ü', 1, 'umlaut'), ('ß', 2, ''), ('漢', 3, 'han')) AS v(symbol, position, reading) ON f.symbol = v.symbol)
SELECT symbol, coalesce(nullif(reading, ''), lower(strip_accents(symbol))) AS reading, row_number() OVER (ORDER BY kept IS NULL, kept, at_, symbol) AS position, at_[1] AS first_seen FROM b""")
def _(t):
    kept = t.spark.createDataFrame([("ü", 1, "umlaut"), ("ß", 2, ""), ("漢", 3, "han")], "symbol string, position int, reading string")
    pattern = "[^\\x00-\\x7f]"
    from ..functions.text import toneless
    seen = t.documents.select(F.explode(ru.symbols(F.col("text"), pattern)).alias("symbol")).distinct()
    return ru.symbol_inventory(t.documents, "doc_id", "text", kept, seen.withColumn("reading", toneless(F.col("symbol"))), pattern)


@demo("option_completeness", """
SELECT o_orderkey, count(l_orderkey) AS options, CASE WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'A' ELSE '' END || CASE WHEN count(*) FILTER (l_returnflag = 'N') = 0 THEN 'N' ELSE '' END
  || CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'R' ELSE '' END AS missing FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING options <> 3 OR missing <> ''""")
def _(t):
    li = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return ru.option_completeness(t.orders, li, ["o_orderkey"], "l_returnflag", ["A", "N", "R"])


@demo("cell_coverage", """
WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS r, CAST(l_quantity AS INT) % 4 AS c, 1 + CAST(l_discount * 100 AS INT) % 2 AS rs, 1 + CAST(l_tax * 100 AS INT) % 3 AS cs FROM lineitem),
f AS (SELECT *, r + rs <= 6 AND c + cs <= 5 AS ok FROM c),
g AS (SELECT l_orderkey, a, b, count(*) AS n FROM (SELECT l_orderkey, a, unnest(generate_series(c, c + cs - 1)) AS b FROM (SELECT *, unnest(generate_series(r, r + rs - 1)) AS a FROM f WHERE ok)) GROUP BY ALL),
s AS (SELECT l_orderkey, count(*) AS filled, sum(n - 1) AS extra FROM g GROUP BY ALL)
SELECT f.l_orderkey, count(*) FILTER (NOT ok) AS invalid, coalesce(any_value(extra), 0) AS overlapping, 30 - coalesce(any_value(filled), 0) AS gaps FROM f LEFT JOIN s ON s.l_orderkey = f.l_orderkey GROUP BY f.l_orderkey""", overlapping="BIGINT")
def _(t):
    pct = lambda c: F.round(F.col(c) * 100).cast("int")
    cells = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("r"), (F.col("l_quantity").cast("int") % 4).alias("c"), (1 + pct("l_discount") % 2).alias("rs"),
                              (1 + pct("l_tax") % 3).alias("cs"), F.lit(6).alias("rows"), F.lit(5).alias("cols"))
    return ru.cell_coverage(cells, ["l_orderkey"], "r", "c", "rs", "cs", "rows", "cols")


_BEST = """(SELECT p_type, p_size, max(p_retailprice) AS before_, max(l_extendedprice / l_quantity) AS s, arg_max(l_partkey, (l_extendedprice / l_quantity, -l_partkey)) AS c FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""


@demo("best_candidate", f"""
SELECT p_type, p_size, round(before_, 4) AS before, CASE WHEN s > before_ + 1e-4 THEN c END AS chosen, round(CASE WHEN s > before_ + 1e-4 THEN s ELSE before_ END, 4) AS score,
  before_ * 1.5 < s - 1e-3 AS reverted FROM {_BEST}""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("score", F.col("l_extendedprice") / F.col("l_quantity"))
    before = j.groupBy("p_type", "p_size").agg(F.max("p_retailprice").alias("before"))
    best = ru.best_candidate(j, ["p_type", "p_size"], "l_partkey", "score", before)
    kept = ru.revert_regressions(best.withColumn("pick", F.col("chosen")), F.col("before") * 1.5, F.col("score"), "pick")
    return kept.select("p_type", "p_size", F.round("before", 4).alias("before"), "chosen", F.round("score", 4).alias("score"), "reverted")


def _scores(df):
    cells = df.groupBy("user_id", F.col("event_type").alias("cell")).agg(F.max("value").alias("score"))
    pages = df.groupBy("user_id").agg(F.max("value").alias("score")).select("user_id", F.lit(None).cast("string").alias("cell"), "score")
    return cells.unionByName(pages)


@demo("regression_report", """
WITH c AS (SELECT user_id, event_type, max(value) FILTER (event_id % 2 = 0) AS b, max(value) FILTER (event_id % 2 = 1) AS n FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))),
r AS (SELECT user_id, event_type, round(b, 4) AS b, round(n, 4) AS n FROM c WHERE n IS NOT NULL),
p AS (SELECT user_id, max(n) FILTER (event_type IS NULL) AS score, max(b) FILTER (event_type IS NULL) AS base, count(*) FILTER (event_type IS NOT NULL AND n - b <= -4) AS dropped_cells FROM r GROUP BY user_id)
SELECT user_id, score, base, dropped_cells, round(score - base, 1) AS delta, CASE WHEN base IS NULL THEN 'new' WHEN round(score - base, 1) <= -.5 OR dropped_cells > 0 THEN 'worse' WHEN round(score - base, 1) >= .5 THEN 'better' ELSE 'same' END AS status FROM p""")
def _(t):
    half = F.col("event_id") % 2
    return ru.regression_report(_scores(t.events.filter(half == 1)), _scores(t.events.filter(half == 0)), ["user_id"], ["cell"], "score")


@demo("regression_totals", """
WITH c AS (SELECT user_id, event_type, max(value) FILTER (event_id % 2 = 0) AS b, max(value) FILTER (event_id % 2 = 1) AS n FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))),
r AS (SELECT user_id, event_type, b, n FROM c WHERE n IS NOT NULL),
p AS (SELECT user_id, max(n) FILTER (event_type IS NULL) AS score, max(b) FILTER (event_type IS NULL) AS base, count(*) FILTER (event_type IS NOT NULL AND n - b <= -4) AS dropped FROM r GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'error' WHEN base IS NULL THEN 'new' WHEN round(score - base, 1) <= -.5 OR dropped > 0 THEN 'worse' WHEN round(score - base, 1) >= .5 THEN 'better' ELSE 'same' END AS status FROM p)
SELECT user_id % 5 AS book, count(*) AS pages, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'worse') AS worse,
  count(*) FILTER (status = 'better') AS better, count(*) FILTER (status = 'same') AS same, count(*) FILTER (status IN ('worse', 'error')) AS regressions FROM s GROUP BY ALL""")
def _(t):
    half = F.col("event_id") % 2
    now = _scores(t.events.filter(half == 1)).withColumn("error", F.when(F.col("user_id") % 11 == 0, "no page was built").otherwise(""))
    report = ru.regression_report(now, _scores(t.events.filter(half == 0)), ["user_id"], ["cell"], "score", error="error")
    return ru.regression_totals(report.withColumn("book", F.col("user_id") % 5), ["book"])


@demo("grid_scores", """
WITH c AS (SELECT event_type, least(hour(ts) * 6 // 24, 5) AS row, least((isodow(ts) - 1) * 7 // 7, 6) AS col, avg(value) AS score FROM events GROUP BY ALL)
SELECT event_type, row, col, round(score, 9) AS score, row_number() OVER (PARTITION BY event_type ORDER BY round(score, 6), row, col) AS rank,
  row_number() OVER (PARTITION BY event_type ORDER BY round(score, 6), row, col) <= 4 AND score < 18 AS worst FROM c""")
def _(t):
    x, y = F.weekday("ts") / 7 + 0.01, F.hour("ts") / 24
    return ru.grid_scores(t.events, ["event_type"], x, y, "value", 6, 7, worst=4, below=18).withColumn("score", F.round("score", 9))


@demo("array_similarity", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 100 + 128) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
u AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM p),
m AS (SELECT vec_id, avg((abs(a - b) <= 24)::INT) AS share, avg(abs(a - b)) AS mae, avg(a) AS ma, avg(b) AS mb, avg(a * a) - avg(a) ** 2 AS va, avg(b * b) - avg(b) ** 2 AS vb, avg(a * b) - avg(a) * avg(b) AS cov FROM u GROUP BY vec_id)
SELECT vec_id, round(share, 4) AS share, round(mae, 3) AS mae, round((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 4) AS ssim FROM m""")
def _(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 100 + 128).alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    s = e.join(nxt, "vec_id").withColumn("s", ru.array_similarity(F.col("a"), F.col("b")))
    return s.select("vec_id", F.round("s.share", 4).alias("share"), F.round("s.mae", 3).alias("mae"), F.round("s.ssim", 4).alias("ssim"))


@demo("precision_recall_f1", """
SELECT lang, truth, found, round(CASE WHEN truth + found < 12 THEN 1 WHEN both_ = 0 THEN CASE WHEN truth = 0 OR found = 0 THEN CASE WHEN truth = 0 AND found = 0 THEN 1 ELSE 0 END ELSE 0 END
  ELSE 2 * (both_ / truth) * (both_ / found) / (both_ / truth + both_ / found) END, 6) AS f1,
  round(100 * (.45 * greatest(0, found / total - .5) + .35 * truth / total + .2), 4) AS score
FROM (SELECT lang, count(*) AS total, count(*) FILTER (quality = 0) AS truth, count(*) FILTER (toxic = 1) AS found, count(*) FILTER (quality = 0 AND toxic = 1) AS both_ FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def _(t):
    q, x = F.col("quality") == 0, F.col("toxic") == 1
    n = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("total"), F.count_if(q).alias("truth"), F.count_if(x).alias("found"), F.count_if(q & x).alias("both"))
    f1 = ru.precision_recall_f1(F.col("both"), F.col("truth"), F.col("both"), F.col("found"))
    score = ru.fidelity_score(F.col("found") / F.col("total") - 0.5, F.col("truth") / F.col("total"), F.lit(1.0))
    # One empty side has precision or recall 1 by rule; with no common hit the F1 is 0 then.
    return n.select("lang", "truth", "found", F.round(F.when((F.col("both") == 0) & (F.col("truth") + F.col("found") >= 12), 0.0).otherwise(f1), 6).alias("f1"), F.round(score, 4).alias("score"))


@demo("best_variant", """
WITH w AS (SELECT word, min(doc_id) AS no FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents) GROUP BY word),
k AS (SELECT *, lower(strip_accents(word)) AS k, length(regexp_replace(word, '[\\x00-\\x7fßæœøªº]+', '', 'g')) AS m FROM w),
b AS (SELECT k, arg_max(word, (m, -no, word)) AS b, max(m) AS bm FROM k WHERE m > 0 GROUP BY k)
SELECT word, CASE WHEN bm > m THEN CASE WHEN left(word, 1) = upper(left(word, 1)) THEN upper(left(b, 1)) || substr(b, 2) ELSE b END ELSE word END AS printed FROM k LEFT JOIN b ON b.k = k.k""")
def _(t):
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.min("doc_id").alias("doc_id"))
    # The order within a document is given by the word itself.
    ranked = w.withColumn("no", F.struct((-F.col("doc_id")).alias("d"), "word"))
    return ru.best_variant(ranked, "word", F.col("no")).select("word", "printed")


@demo("novelty", """
WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS symbol FROM documents),
f AS (SELECT symbol, min(doc_id) AS doc_id FROM c WHERE symbol NOT IN (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) FROM benchmark) GROUP BY symbol)
SELECT d.doc_id, count(f.symbol) AS novel FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(t):
    known = t.benchmark.select(F.explode(ru.symbols(F.col("text"), "\\p{L}+")).alias("symbol"))
    return ru.novelty(t.documents, "doc_id", "text", "\\p{L}+", known)


@demo("unit_vote", """
WITH b AS (SELECT l_orderkey, l_quantity * CASE l_orderkey % 4 WHEN 0 THEN .01 WHEN 1 THEN 1 WHEN 2 THEN 15 ELSE 60 END AS x, l_linenumber * CASE l_orderkey % 4 WHEN 0 THEN .1 WHEN 1 THEN 9 WHEN 2 THEN 100 ELSE 300 END AS y, l_discount * 10 AS w, l_tax * 10 AS h FROM lineitem),
v AS (SELECT l_orderkey, avg((x + w <= 1.05 AND y + h <= 1.05)::INT) AS f, avg((x + w <= 101 AND y + h <= 101)::INT) AS p, avg((x + w <= 1005 AND y + h <= 1005)::INT) AS g, max(y) AS sy, max(x + w) AS mx, max(y + h) AS my FROM b GROUP BY l_orderkey),
u AS (SELECT *, CASE WHEN f >= .7 THEN 'fraction' WHEN p >= .7 THEN 'percent' WHEN g >= .7 AND sy <= 1000 AND sy < 3190 * .66 THEN 'grid1000' ELSE 'pixels' END AS unit FROM v)
SELECT l_orderkey, unit, round(CASE unit WHEN 'fraction' THEN 1 WHEN 'percent' THEN .01 WHEN 'grid1000' THEN .001 ELSE 1 / greatest(2342, mx) END, 8) AS sx,
  round(CASE unit WHEN 'fraction' THEN 1 WHEN 'percent' THEN .01 WHEN 'grid1000' THEN .001 ELSE 1 / greatest(3190, my) END, 8) AS sy FROM u""")
def _(t):
    k = F.col("l_orderkey") % 4
    pick = lambda a, b, c, d: F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(d)
    b = t.lineitem.select("l_orderkey", (F.col("l_quantity") * pick(0.01, 1.0, 15.0, 60.0)).alias("x"), (F.col("l_linenumber") * pick(0.1, 9.0, 100.0, 300.0)).alias("y"),
                          (F.col("l_discount") * 10).alias("w"), (F.col("l_tax") * 10).alias("h"))
    done = ru.unit_vote(b, ["l_orderkey"], "x", "y", "w", "h", F.lit(2342), F.lit(3190))
    return done.select("l_orderkey", "unit", F.round("sx", 8).alias("sx"), F.round("sy", 8).alias("sy"))


@demo("palette")
def _(t):
    e = t.embeddings.select(*[F.round(F.col("embedding")[i] * 255 + 128).cast("double").alias(c) for i, c in enumerate("rgb")])
    return ru.palette(e, ["r", "g", "b"])


@demo("manifest_check", """
WITH h AS (SELECT o_orderkey, 4 AS count, o_totalprice AS total_bytes, 100 AS total_duration FROM orders),
s AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS b, sum(l_quantity) AS d, count(*) - count(DISTINCT l_linenumber) AS dup FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(n, 0) = count AS count_ok, abs(coalesce(b, 0) - total_bytes) < .005 AS bytes_ok, abs(coalesce(d, 0) - total_duration) <= 3 AS duration_ok, coalesce((SELECT count(*) FROM (
  SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x WHERE x.k = o_orderkey), 0) AS duplicate_ids FROM h LEFT JOIN s ON l_orderkey = o_orderkey""")
def _(t):
    h = t.orders.select("o_orderkey", F.lit(4).alias("count"), F.col("o_totalprice").alias("total_bytes"), F.lit(100.0).alias("total_duration"))
    return ru.manifest_check(h, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], "l_linenumber", "l_extendedprice", "l_quantity")


@demo("expected_vs_returned", """
SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus <> 'P'
UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT l_orderkey, 'repeated' FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def _(t):
    return sets.expected_vs_returned(t.orders.filter("o_orderstatus <> 'P'"), t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@demo("ordered_union_distinct", """
SELECT n AS nation, row_number() OVER (ORDER BY a, n) AS position FROM (SELECT n, min(a) AS a FROM (
  SELECT c_nationkey AS n, (0, c_custkey) AS a FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, (1, s_suppkey) FROM supplier) GROUP BY n)""")
def _(t):
    a = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("no"))
    return sets.ordered_union_distinct(a, t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("no")), "nation", "no")


@demo("common_keys", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return sets.common_keys(t.customer.filter("c_acctbal > 9500").withColumnRenamed("c_nationkey", "nation"), t.supplier.filter("s_acctbal > 5000").withColumnRenamed("s_nationkey", "nation"), ["nation"])
