"""Example queries for recognised text, evidence, contracts and strokes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.text import plain_key
from ..operators import contracts as ct
from ..operators import reading as rd
from ..operators import strokes
from .demo import demo


def kind(name):
    return F.col("event_type") == name


def _doc_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


_WORDS = """(SELECT doc_id, ln, pos, ws[pos] AS word FROM (SELECT doc_id, ln, ws, unnest(generate_series(1, len(ws))) AS pos FROM (
  SELECT doc_id, ln, list_filter(string_split(s[ln], ' '), lambda x: x <> '') AS ws FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))))"""


@demo("group_words_to_lines", f"""
WITH g AS (SELECT doc_id, ln, (pos - 1) // 5 AS seg, string_agg(word, ' ' ORDER BY pos) AS text, min(pos) AS p, count(*) AS n FROM {_WORDS} GROUP BY ALL)
SELECT doc_id, 'line-' || row_number() OVER (PARTITION BY doc_id ORDER BY ln, seg) AS id, md5(text) AS text, round((p - 1) * 5e-2 + seg * 2e-1, 4) AS x, round((n - 1) * 5e-2 + 45e-3, 4) AS w FROM g""")
def _(t):
    lines = _doc_lines(t).select("doc_id", "ln", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("pos", "text"))
    words = lines.select("doc_id", F.struct("ln", "pos").alias("ident"), "text", (F.col("pos") * 0.05 + F.floor(F.col("pos") / 5) * 0.2).alias("x"),
                         (F.col("ln") * 0.05 + F.length("text") % 3 * 0.001).alias("y"), F.lit(0.045).alias("w"), F.lit(0.02).alias("h"))
    done = rd.group_words_to_lines(words, ["doc_id"], "ident")
    return done.select("doc_id", "id", F.md5("text").alias("text"), F.round("x", 4).alias("x"), F.round("w", 4).alias("w"))


@demo("fuzzy_assign")
def _(t):
    spot = boxes.box(F.lit(0.1), F.col("ln") * 0.12, F.lit(0.6), F.lit(0.1))
    noisy = F.when(F.col("ln") % 2 == 1, F.translate("line", "eé", "c")).otherwise(F.col("line"))
    rows = _doc_lines(t).withColumn("box", spot)
    lines = rows.select("doc_id", F.col("ln").alias("line_no"), noisy.alias("text"), "box").withColumnRenamed("line_no", "line")
    blocks = rows.select("doc_id", F.col("ln").alias("block"), F.col("line").alias("text"), "box")
    done = rd.fuzzy_assign(lines, blocks, ["doc_id"])
    return done.select("doc_id", "line", "block", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"))


@demo("claim_rest", """
WITH p AS (SELECT doc_id, ln, s[ln] AS line FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
l AS (SELECT doc_id, ln, regexp_replace(lower(strip_accents(line)), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM p WHERE ln % 3 <> 1),
b AS (SELECT doc_id, ln, k, ceil(length(k) * 8e-1 - 1e-9) AS r FROM (SELECT doc_id, ln, regexp_replace(lower(strip_accents(replace(string_split(line, ' ')[1], 'e', 'c'))), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM p WHERE ln % 3 <> 1) WHERE length(k) BETWEEN 2 AND 11),
runs AS (SELECT DISTINCT doc_id, ln, k, substr(k, CAST(i AS BIGINT), CAST(r AS BIGINT)) AS run FROM (SELECT *, unnest(generate_series(1, CAST(length(k) - r + 1 AS BIGINT))) AS i FROM b))
SELECT l.doc_id, l.ln - 1 AS line, min(runs.ln) - 1 AS block FROM l JOIN runs ON runs.doc_id = l.doc_id AND contains(l.k, runs.run) WHERE length(l.k) >= 2 GROUP BY l.doc_id, l.ln""")
def _(t):
    rows = _doc_lines(t)
    lines = rows.select("doc_id", F.col("ln").alias("line_no"), F.col("line").alias("text")).withColumnRenamed("line_no", "line")
    labels = rows.select("doc_id", F.col("ln").alias("block"), F.replace(F.split("line", " ")[0], F.lit("e"), F.lit("c")).alias("text")).filter(F.length(plain_key(F.col("text"))).between(2, 11))
    claimed = rows.filter("ln % 3 = 0").select("doc_id", F.col("ln").alias("line"), F.col("ln").alias("block"))
    return rd.claim_rest(lines, labels, claimed, ["doc_id"]).select("doc_id", "line", "block")


@demo("align_lines", """
SELECT doc_id, CASE WHEN reason IS NULL THEN n END AS n, CASE WHEN reason IS NULL THEN true END AS whole, reason FROM (SELECT doc_id, n, CASE WHEN greatest(length(z), length(a)) = 0 THEN 'empty'
  WHEN abs(length(z) - length(a)) > greatest(length(z), length(a)) * 3e-1 THEN 'far'
  WHEN levenshtein(z, a) > greatest(length(z), length(a)) * 3e-1 THEN 'far' END AS reason FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, regexp_replace(text, '\\s+', '', 'g') AS z,
  regexp_replace(CASE WHEN doc_id % 4 = 0 THEN translate(text, 'aeno', 'xyzw') ELSE translate(text, 'e', '') END, '\\s+', '', 'g') AS a FROM documents))""")
def _(t):
    noisy = F.when(F.col("doc_id") % 4 == 0, F.translate("text", "aeno", "xyzw")).otherwise(F.translate("text", "e", ""))
    done = rd.align_lines(t.documents.select("doc_id", "text", F.split(noisy, "\n").alias("lines")), "text", "lines")
    whole = F.array_join("aligned", "") == F.replace("text", F.lit("\n"), F.lit(""))
    return done.select("doc_id", F.when(F.col("aligned").isNotNull(), F.size("aligned")).cast("long").alias("n"), whole.alias("whole"), F.col("aligned_reason").alias("reason"))


_V = "(SELECT p_brand AS page, p_partkey AS no, p_name AS text FROM part WHERE p_size <= 25)"
_L = """(SELECT p_brand AS page, p_partkey AS no, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, 'i', 'ü') END AS text, 8e-1 + (p_partkey % 2) * 15e-2 AS conf FROM part WHERE p_size > 22)"""


def _tier(n, vk, lk, ok, v, l):
    return (f"v{n} AS (SELECT page, no, {vk} AS k, row_number() OVER (PARTITION BY page, {vk} ORDER BY no) AS i FROM {v}), l{n} AS (SELECT page, no, {lk} AS k, row_number() OVER (PARTITION BY page, {lk} ORDER BY no) AS i FROM {l} WHERE {ok}), "
            f"h{n} AS (SELECT v.page, v.no AS vno, l.no AS lno, {n} AS tier FROM v{n} v JOIN l{n} l ON l.page = v.page AND l.k = v.k AND l.i = v.i)")


@demo("tiered_match", f"""
WITH v AS {_V}, l AS {_L}, {_tier(1, 'text', 'text', 'true', 'v', 'l')},
va AS (SELECT * FROM v WHERE no NOT IN (SELECT vno FROM h1)), la AS (SELECT * FROM l WHERE no NOT IN (SELECT lno FROM h1)), {_tier(2, 'lower(text)', 'lower(text)', 'conf >= 9e-1', 'va', 'la')},
vb AS (SELECT * FROM va WHERE no NOT IN (SELECT vno FROM h2)), lb AS (SELECT * FROM la WHERE no NOT IN (SELECT lno FROM h2)), {_tier(3, 'text', "replace(lower(text), 'ü', 'i')", 'true', 'vb', 'lb')},
h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT v.page, v.no, tier, lno AS line, count(tier) OVER (PARTITION BY v.page) >= count(*) OVER (PARTITION BY v.page) * 7e-1 AS page_ok FROM v LEFT JOIN h ON vno = no""")
def _(t):
    k = F.col("p_partkey")
    values = t.part.filter("p_size <= 25").select(F.col("p_brand").alias("page"), k.alias("no"), F.col("p_name").alias("text"))
    text = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.upper("p_name")).otherwise(F.replace(F.col("p_name"), F.lit("i"), F.lit("ü")))
    lines = t.part.filter("p_size > 22").select(F.col("p_brand").alias("page"), k.alias("no"), text.alias("text"), (0.8 + k % 2 * 0.15).alias("conf"))
    x = F.col("text")
    tiers = [(x, x, F.lit(True)), (F.lower(x), F.lower(x), F.col("conf") >= 0.9), (x, F.replace(F.lower(x), F.lit("ü"), F.lit("i")), F.lit(True))]
    done = rd.tiered_match(values, lines, ["page"], ["no"], tiers)
    return done.select("page", "no", "tier", F.col("matched.no").alias("line"), "page_ok")


@demo("flag_low_confidence", """
SELECT event_id, kind FROM (SELECT event_id, unnest(list_filter([CASE WHEN value / 40 < 9e-1 THEN 'low-confidence' END, CASE WHEN event_type = 'error' THEN 'empty-recognition' END], lambda x: x IS NOT NULL)) AS kind FROM events)""")
def _(t):
    segments = t.events.select("event_id", F.when(kind("error"), " ").otherwise(F.col("event_type")).alias("text"), (F.col("value") / 40).alias("confidence"))
    return rd.quality_issues(segments, ["event_id"], "text", "confidence")


@demo("arbitrate", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS t, 7e-1 + l_discount * 3 AS c, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE l_linestatus END AS t2, 8e-1 + l_tax * 2 AS c2 FROM lineitem),
b AS (SELECT *, c < 95e-2 AND t2 <> t AND c2 >= 9e-1 AND c2 > c + 1e-1 AS take FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN take THEN t2 ELSE t END AS text, round(CASE WHEN take THEN c2 ELSE c END, 6) AS confidence, CASE WHEN take THEN t END AS previous_text, c < 95e-2 AS checked FROM b""")
def _(t):
    flag = F.col("l_returnflag")
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", flag.alias("text"), (0.7 + F.col("l_discount") * 3).alias("confidence"),
                           F.when(F.col("l_quantity") > 25, flag).otherwise(F.col("l_linestatus")).alias("t2"), (0.8 + F.col("l_tax") * 2).alias("c2"))
    done = rd.arbitrate(df, "text", "confidence", "t2", "c2")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "text", F.round("confidence", 6).alias("confidence"), "previous_text", "checked")


@demo("agreeing_reads", """
WITH r AS (SELECT event_id // 2 AS id, '“' || left(event_type, 1 + CAST(event_id // 2 % 5 AS INT)) || '”' AS text, 6e-1 + value / 100 AS conf FROM events),
p AS (SELECT id, min(text) AS a, max(text) AS b, min(conf) AS conf, count(*) AS n FROM r GROUP BY id), q AS (SELECT *, n >= 2 AND a = b AND conf >= 7e-1 AND length(a) BETWEEN 3 AND 6 AS ok FROM p)
SELECT id, ok AS accepted, CASE WHEN ok THEN a END AS text, CASE WHEN ok THEN 'recovered-quoted-text' ELSE 'unresolved-empty-quotes' END AS kind FROM q""")
def _(t):
    pair = F.floor(F.col("event_id") / 2)
    text = F.concat(F.lit("“"), F.expr("left(event_type, 1 + floor(event_id / 2) % 5)"), F.lit("”"))
    reads = t.events.select(pair.alias("id"), text.alias("text"), (0.6 + F.col("value") / 100).alias("confidence"))
    return rd.agreeing_reads(reads, ["id"], "text", "confidence").drop("confidence")


@demo("blank_evidence", """
WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 6 = 0 THEN '--' ELSE text END, chr(10))) AS text, CASE WHEN doc_id % 12 = 0 THEN 2e-1 ELSE 8e-1 END AS c FROM documents),
n AS (SELECT doc_id, count(*) FILTER (NOT (c < 35e-2 AND NOT regexp_matches(text, '[\\p{L}\\p{N}]'))) AS credible_lines, count(*) AS raw_lines FROM l GROUP BY doc_id)
SELECT doc_id, credible_lines, raw_lines, credible_lines = 0 AND n_chars / 1e8 < 2e-5 AS blank FROM documents JOIN n USING (doc_id)""")
def _(t):
    i = F.col("doc_id")
    body = F.when(i % 6 == 0, "--").otherwise(F.col("text"))
    lines = t.documents.select("doc_id", F.explode(F.split(body, "\n")).alias("text"), F.when(i % 12 == 0, 0.2).otherwise(0.8).alias("confidence"), F.lit(0.99).alias("y"))
    pages = t.documents.select("doc_id", (F.col("n_chars") / 1e7).alias("ink"))
    return rd.blank_evidence(pages, lines, ["doc_id"], "ink", "text", "confidence", "y").drop("ink")


@demo("region_disagreement", """
WITH p AS (SELECT doc_id, text, pos, k[pos] AS piece FROM (SELECT doc_id, text, k, unnest(generate_series(1, len(k))) AS pos FROM (SELECT doc_id, text, string_split(text, ' ') AS k FROM documents))),
r AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS joined FROM p WHERE NOT (doc_id % 7 = 0 AND pos = 3) GROUP BY doc_id)
SELECT d.doc_id, 'recognition-disagreement' AS kind FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id WHERE lower(regexp_replace(text, '\\s+', '', 'g')) <> coalesce(lower(regexp_replace(joined, '\\s+', '', 'g')), '')""")
def _(t):
    pieces = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "piece")).filter("NOT (doc_id % 7 = 0 AND pos = 2)")
    pieces = pieces.withColumn("piece", F.when(F.col("doc_id") % 2 == 0, F.lower("piece")).otherwise(F.col("piece")))
    return rd.region_disagreement(t.documents, pieces, ["doc_id"], "text", ["pos"], "piece")


def _rules(report, table, rules, where="true"):
    return " UNION ALL ".join(f"SELECT {report}, '{name}' AS rule FROM {table} WHERE NOT coalesce({ok}, false) AND {where}" for name, ok in rules.items())


_DRAFT = """(SELECT conv_id, CASE WHEN turn % 5 = 4 THEN 'true' WHEN turn % 5 = 3 THEN '1' ELSE CAST(turn AS VARCHAR) END AS pdf_page, CASE WHEN length(text) % 4 = 0 THEN ' ' ELSE text END AS task, text FROM conversations)"""
_VOCAB = "(SELECT conv_id, pdf_page, w AS word FROM (SELECT conv_id, CAST(turn AS VARCHAR) AS pdf_page, unnest(string_split(text, ' ')) AS w FROM conversations))"


@demo("draft_contract", f"""
WITH d AS {_DRAFT}, v AS {_VOCAB}, e AS (SELECT DISTINCT conv_id, unnest([0, 1, 2, 6]) AS page FROM conversations), i AS (SELECT conv_id, TRY_CAST(pdf_page AS INT) AS page FROM d WHERE pdf_page <> 'true')
{_rules('conv_id, pdf_page', 'd', {'task': "trim(task) <> ''", 'chaoIntro': "trim(text) <> ''", 'pdf_page.type': "pdf_page <> 'true'"})}
UNION ALL SELECT conv_id, CAST(page AS VARCHAR), 'pdf_page.range' FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = i.conv_id AND e.page = i.page)
UNION ALL SELECT conv_id, CAST(page AS VARCHAR), 'pdf_page.unique' FROM i GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT conv_id, CAST(page AS VARCHAR), 'pages.missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE e.conv_id = i.conv_id AND e.page = i.page)
UNION ALL SELECT conv_id, pdf_page, 'vocab.word' FROM v WHERE trim(word) = '' UNION ALL SELECT conv_id, pdf_page, 'vocab.count' FROM v GROUP BY ALL HAVING count(*) > 20""")
def _(t):
    turn = F.col("turn")
    page = F.when(turn % 5 == 4, "true").when(turn % 5 == 3, "1").otherwise(turn.cast("string"))
    pages = t.conversations.select("conv_id", page.alias("pdf_page"), F.when(F.length("text") % 4 == 0, " ").otherwise(F.col("text")).alias("task"), F.col("text").alias("chaoIntro"))
    expected = t.conversations.select("conv_id").distinct().withColumn("page", F.explode(F.array(*[F.lit(n) for n in (0, 1, 2, 6)])))
    vocab = t.conversations.select("conv_id", turn.cast("string").alias("pdf_page"), F.explode(F.split("text", " ")).alias("word"), F.lit("x").alias("py"), F.lit("").alias("pos"), F.lit("x").alias("trans"))
    return ct.draft_contract(pages, expected, vocab, "conv_id").drop("severity")


_BLOCKS = """(SELECT l_orderkey AS lesson, l_linenumber AS page, CASE l_linenumber % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'scanned' ELSE 'electronic' END AS page_type, CAST(l_partkey % 9 AS VARCHAR) AS id,
  CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'R' THEN 'image' ELSE 'table' END AS type, CASE WHEN l_suppkey % 7 = 0 THEN ' ' ELSE l_linestatus END AS text, CASE WHEN l_suppkey % 6 > 0 THEN '' END AS translation,
  md5(CAST(l_partkey AS VARCHAR)) || CASE WHEN l_suppkey % 5 = 0 THEN '.gif' ELSE '.png' END AS file, l_discount * 15 AS x, l_quantity / 60 AS y, l_tax * 8 AS w, l_discount * 5 AS h FROM lineitem WHERE l_quantity > 5)"""
_LEAVES = "(SELECT DISTINCT l_orderkey AS lesson, l_linenumber AS page, CASE l_linenumber % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'scanned' ELSE 'electronic' END AS page_type, l_linenumber % 6 AS scan, l_linenumber - 2 AS width FROM lineitem)"
_E = "page_type = 'electronic'"


@demo("lesson_contract", f"""
WITH b AS {_BLOCKS}, p AS {_LEAVES}
{_rules('lesson, page', 'p', {'page.type': "page_type <> 'video'", 'scan.number': 'scan >= 1', 'scan.size': 'width > 0'})}
UNION ALL {_rules('lesson, page', 'b', {'block.type': "type <> 'table'", 'block.text': "type <> 'text' OR (trim(text) <> '' AND translation IS NOT NULL)", 'block.alt': "type <> 'image' OR trim(text) <> ''",
                                        'block.image': "type <> 'image' OR file LIKE '%.png'", 'block.box': 'w > 0 AND h > 0 AND x + w <= 1.001::DOUBLE AND y + h <= 1.001::DOUBLE'}, _E)}
UNION ALL {_rules('lesson, page', 'b', {'block.text': "trim(text) <> ''"}, "page_type = 'scanned'")}
UNION ALL {_rules('lesson, page', 'b', {'block.number': 'x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1'}, "page_type <> 'video'")}
UNION ALL SELECT lesson, page, 'block.unique' FROM b WHERE {_E} GROUP BY lesson, page, id HAVING count(*) > 1 UNION ALL SELECT lesson, min(page), 'scan.unique' FROM p GROUP BY lesson, scan HAVING count(*) > 1
UNION ALL SELECT lesson, page, 'blocks.count' FROM p WHERE {_E} AND (SELECT count(*) FROM b WHERE b.lesson = p.lesson AND b.page = p.page) NOT BETWEEN 1 AND 500""")
def _(t):
    c = F.col
    kinds = F.when(c("l_returnflag") == "A", "text").when(c("l_returnflag") == "R", "image").otherwise("table")
    number = c("l_linenumber")
    leaf = F.when(number % 4 == 0, "video").when(number % 4 == 1, "scanned").otherwise("electronic").alias("page_type")
    pages = t.lineitem.select(c("l_orderkey").alias("lesson"), number.alias("page"), leaf, (number % 6).alias("scan"), (number - 2).alias("width"), F.lit(1).alias("height")).distinct()
    said = F.when(c("l_suppkey") % 7 == 0, " ").otherwise(c("l_linestatus"))
    file = F.concat(F.lit("/assets/a.b/"), F.md5(c("l_partkey").cast("string")), F.when(c("l_suppkey") % 5 == 0, ".gif").otherwise(".png"))
    b = t.lineitem.filter("l_quantity > 5").select(
        c("l_orderkey").alias("lesson"), number.alias("page"), leaf, F.lit("a.b").alias("book"), (c("l_partkey") % 9).cast("string").alias("id"), kinds.alias("type"), said.alias("text"),
        F.when(c("l_suppkey") % 6 > 0, "").alias("translation"), said.alias("alt"), file.alias("image"), (c("l_discount") * 15).alias("x"), (c("l_quantity") / 60).alias("y"), (c("l_tax") * 8).alias("w"),
        (c("l_discount") * 5).alias("h"))
    return ct.lesson_contract(b, pages, "lesson", "page").drop("severity")


@demo("publish_contract", f"""
WITH p AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS slug, page_id AS n, html, CASE WHEN page_id % 9 = 0 THEN '2342x3190' ELSE '2342/3190' END AS aspect, CASE WHEN page_id % 5 = 0 THEN 3e-1 ELSE 1e-1 END AS cl FROM pages),
f AS (SELECT slug, n, 'pages/' || lpad(CAST(CASE WHEN n % 4 = 0 THEN 1 ELSE n END AS VARCHAR), 3, '0') || '/' || f AS path FROM (SELECT slug, n, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS f FROM p)),
w AS (SELECT slug, n, unnest(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ')) AS word FROM p)
{_rules('slug, n', 'p', {'book.slug': f"regexp_matches(slug, '{ct.SLUG}')", 'page.n': 'n BETWEEN 1 AND 999', 'page.aspect': f"regexp_matches(aspect, '{ct.ASPECT}')", 'page.crop': 'cl <= 2e-1', 'lesson.number': 'n BETWEEN 0 AND 999'})}
UNION ALL {_rules('slug, n', 'f', {'file.path': f"regexp_matches(path, '{ct.FILE_PATH}')", 'file.page': "starts_with(path, 'pages/' || lpad(CAST(n AS VARCHAR), 3, '0') || '/')"})}
UNION ALL {_rules('slug, n', 'w', {'builder.word': 'length(word) BETWEEN 1 AND 40'})} UNION ALL SELECT slug, n, 'builder.count' FROM w GROUP BY ALL HAVING count(*) > 12 UNION ALL SELECT slug, n, 'files.count' FROM f GROUP BY ALL HAVING count(*) > 80""")
def _(t):
    n = F.col("n")
    p = t.pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("slug"), F.col("page_id").alias("n"), "html", "url")
    heading = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = p.select("slug", "n", F.when(n % 9 == 0, "2342x3190").otherwise("2342/3190").alias("aspect"), F.when(n % 5 == 0, 0.3).otherwise(0.1).alias("crop_left"),
                     F.lit(None).cast("double").alias("crop_right"), n.alias("lesson_number"), F.lit("title").alias("title"),
                     n.cast("string").alias("pageNum"), F.col("slug").alias("navLabel"), heading.alias("chaoIntro"), F.col("url").alias("task"),
                     F.concat_ws(" ", heading, "url").alias("systemPrompt"))
    links = p.select("slug", "n", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))).alias("f"))
    files = links.select("slug", "n", F.concat(F.lit("pages/"), F.lpad(F.when(n % 4 == 0, 1).otherwise(n).cast("string"), 3, "0"), F.lit("/"), "f").alias("path"))
    words = p.select("slug", "n", F.explode(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")).alias("word"))
    vocab = words.select("slug", "n", F.lit("w").alias("word"), F.lit("p").alias("py"), F.lit("").alias("pos"), F.lit("t").alias("trans"))
    return ct.publish_contract(pages, files, words, vocab, "slug", "n", required=ct.TEXT_LIMITS).drop("severity")


@demo("trace_score")
def _(t):
    # A user's values over one day as a stroke, against the stroke of the day over all users by hour.
    e = t.events.select("user_id", F.dayofmonth("ts").alias("day"), (F.hour("ts") + F.minute("ts") / 60).alias("x"), "value", F.hour("ts").alias("hour"))
    point = F.struct(F.round("x", 4).alias("x"), F.col("value").alias("y"))
    traces = e.groupBy("day", "user_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    hourly = e.groupBy("day", "hour").agg(F.round(F.avg("value"), 4).alias("y"))
    refs = hourly.groupBy("day").agg(F.array_sort(F.collect_list(F.struct(F.col("hour").cast("double").alias("x"), "y"))).alias("points"))
    return strokes.trace_score(traces, refs, ["day"], ["user_id"], 300.0).withColumn("distance", F.round("distance", 4))
