"""Example queries for the text, box and record functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, records, text as tx
from ..operators import layout
from ..operators.lineage import cut_lineage
from .demo import demo

HAN = ("aou", "汉字页")  # gives the Latin test documents some Han characters
PAGE_ATTRS = ["href", "class", "id", "src", "lang"]


def han_text(col="text"):
    return F.translate(F.col(col), *HAN)


def words(t):
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("word")).distinct()


WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents)"


@demo("script_profile", """
SELECT doc_id, length(regexp_replace(h, '[^\\p{Han}]+', '', 'g')) AS han, length(regexp_replace(h, '[^\\p{Latin}]+', '', 'g')) AS latin,
  length(regexp_replace(h, '[^\\p{Nd}]+', '', 'g')) AS digit,
  length(h) - length(regexp_replace(h, '[^\\p{Han}\\p{Latin}\\p{Nd}]+', '', 'g')) AS other,
  regexp_matches(h, '[A-Za-z]') AS english,
  length(trim(regexp_replace(h, '\\s+', ' ', 'g'))) BETWEEN 1 AND 120 AND regexp_matches(h, '\\p{Han}') AS speakable
FROM (SELECT doc_id, translate(text, 'aou', '汉字页') AS h FROM documents)""")
def _(t):
    d = t.documents.withColumn("h", han_text())
    return (d.withColumn("p", tx.script_profile(F.col("h")))
            .select("doc_id", "p.*", tx.has_ascii_letter(F.col("h")).alias("english"), tx.speakable(F.col("h")).alias("speakable")))


@demo("plain_key", """
SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', '', 'g')) AS plain FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.plain_key(F.col("text"))).alias("plain"))


@demo("toneless", f"""
SELECT word, lower(strip_accents(word)) AS bare, length(regexp_replace(word, '[\\x00-\\x7fßæœøªº]+', '', 'g')) AS marks FROM {WORDS}""")
def _(t):
    w = F.col("word")
    return words(t).select("word", tx.toneless(w).alias("bare"), tx.tone_count(w).alias("marks"))


@demo("memory_key", """
SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS memory, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS compact
FROM documents""")
def _(t):
    c = F.col("text")
    # The decomposed spelling of a letter has to give the same key.
    split = F.replace(F.replace(c, F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return t.documents.select("doc_id", F.md5(tx.memory_key(split)).alias("memory"), F.md5(tx.compact_key(c)).alias("compact"))


def _widen_sql(col: str) -> str:
    for mark in ",!?:;)":
        col = f"regexp_replace({col}, '([\\p{{Han}}”’）])\\s*[{mark}]', '\\1{tx.FULL_WIDTH[mark]}', 'g')"
    for mark in ",!?:;(":
        col = f"regexp_replace({col}, '[{mark}]\\s*(\\p{{Han}})', '{tx.FULL_WIDTH[mark]}\\1', 'g')"
    for _ in range(2):
        col = f"regexp_replace({col}, '(\\p{{Han}})\\s*\\.(\\s*$|\\s*\\p{{Han}}|\\s*\\n)', '\\1。\\2', 'g')"
    return col


@demo("widen_punctuation", f"SELECT doc_id, md5({_widen_sql('h')}) AS widened FROM (SELECT doc_id, translate(text, 'aou', '汉字页') AS h FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.widen_punctuation(han_text())).alias("widened"))


@demo("mixed_tokens", """
SELECT doc_id, len(k) AS tokens, md5(array_to_string(k, '|')) AS digest FROM (SELECT doc_id,
  regexp_extract_all(translate(text, 'aou', '汉字页'), '[\\x{3400}-\\x{9fff}]|\\p{Latin}+(?:[''’]\\p{Latin}+)*|\\p{Nd}+|\\S') AS k FROM documents)""")
def _(t):
    k = tx.mixed_tokens(han_text())
    return t.documents.select("doc_id", F.size(k).cast("long").alias("tokens"), F.md5(F.array_join(k, "|")).alias("digest"))


@demo("tone_key", f"""
SELECT word, CASE WHEN regexp_matches(word, '[áéíóúÁÉÍÓÚ]') AND regexp_matches(word, '[àèìòùÀÈÌÒÙ]') THEN NULL
    WHEN regexp_matches(word, '[áéíóúÁÉÍÓÚ]') THEN 2 WHEN regexp_matches(word, '[àèìòùÀÈÌÒÙ]') THEN 4 END AS tone,
  CASE WHEN length(regexp_replace(word, '[^áéíóúÁÉÍÓÚàèìòùÀÈÌÒÙ]', '', 'g')) = 1
      AND regexp_matches(translate(lower(word), 'áéíóúàèìòù', 'aeiouaeiou'), '{tx.SYLLABLE}')
    THEN replace(translate(lower(word), 'áéíóúàèìòù', 'aeiouaeiou'), 'ü', 'v') || CASE WHEN regexp_matches(word, '[áéíóúÁÉÍÓÚ]') THEN '2' ELSE '4' END END AS key
FROM {WORDS}""")
def _(t):
    w = F.col("word")
    return words(t).select("word", tx.tone_of(w).alias("tone"), tx.tone_key(w).alias("key"))


@demo("syllable_count", f"""
SELECT word, len(regexp_extract_all(w, '[{tx.PINYIN_VOWELS}]+')) + CASE WHEN length(w) > 2 AND NOT regexp_matches(w, '(^|'')[eēéěè]r$')
  AND regexp_matches(w, '[{tx.PINYIN_VOWELS}ng]r$') THEN 1 ELSE 0 END AS syllables
FROM (SELECT word, regexp_replace(lower(word), '[^a-z{tx.PINYIN_VOWELS}'']+', '', 'g') AS w FROM {WORDS})""")
def _(t):
    return words(t).select("word", tx.syllable_count(F.col("word")).alias("syllables"))


@demo("transliterate")
def _(t):
    # Written first, as the filter would else be pushed below the distinct and work on every occurrence.
    return cut_lineage(words(t)).select("word", tx.transliterate(F.col("word")).alias("russian")).filter("russian IS NOT NULL")


@demo("track_code", """
SELECT p_partkey, CASE WHEN a <> '' THEN CAST(a AS INT) || '-' || CAST(b AS INT) END AS track FROM (
  SELECT p_partkey, regexp_extract(n, '(?:^|[^0-9])([0-9]{1,2})\\s*[-_–—.]\\s*([0-9]{1,3})(?:[^0-9]|$)', 1) AS a,
    regexp_extract(n, '(?:^|[^0-9])([0-9]{1,2})\\s*[-_–—.]\\s*([0-9]{1,3})(?:[^0-9]|$)', 2) AS b
  FROM (SELECT p_partkey, p_type || ' 0' || (p_size % 10) || CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN ' _ ' ELSE ' to ' END || (p_partkey % 1000) AS n FROM part))""")
def _(t):
    name = F.concat(F.col("p_type"), F.lit(" 0"), F.col("p_size") % 10,
                    F.when(F.col("p_size") % 3 == 0, "-").when(F.col("p_size") % 3 == 1, " _ ").otherwise(" to "),
                    F.col("p_partkey") % 1000, F.lit(".mp3"))
    return t.part.select("p_partkey", tx.track_code(name).alias("track"))


@demo("infer_metadata", """
SELECT p_partkey, CASE WHEN l <> '' THEN 'HSK ' || l ELSE '' END AS level,
  CASE WHEN l <> '' THEN 'HSK ' || l || CASE WHEN l = '1' AND p_type = 'SMALL' THEN ' v3.0' ELSE '' END || CASE WHEN p_type = 'PROMO' THEN ' · Рабочая тетрадь' ELSE '' END ELSE n END AS section,
  coalesce(own, CASE WHEN l <> '' THEN 'hsk' || l || CASE WHEN l = '1' AND p_type = 'SMALL' THEN '-v3' ELSE '' END || CASE WHEN p_type = 'LARGE' THEN '-upper' ELSE '' END
    || CASE WHEN p_type = 'PROMO' THEN '-workbook' ELSE '' END ELSE 'book-' || p_partkey END) AS slug
FROM (SELECT p_partkey, p_type, CASE WHEN p_brand = 'Brand#1' THEN 'own' END AS own, n, regexp_extract(n, 'HSK[\\s_-]*([1-6])', 1) AS l FROM (
  SELECT *, 'HSK ' || (p_size % 9) || CASE p_type WHEN 'PROMO' THEN ' Workbook' WHEN 'SMALL' THEN ' v3.0' WHEN 'LARGE' THEN ' 上' ELSE ' Course' END AS n FROM part))""")
def _(t):
    kind = F.col("p_type")
    name = F.concat(F.lit("HSK "), F.col("p_size") % 9, F.when(kind == "PROMO", " Workbook").when(kind == "SMALL", " v3.0")
                    .when(kind == "LARGE", " 上").otherwise(" Course"))
    df = t.part.withColumns({"name": name, "own": F.when(F.col("p_brand") == "Brand#1", "own")})
    return records.infer_metadata(df, "name", "p_partkey", {"slug": "own"}).select("p_partkey", "level", "section", "slug")


@demo("allocate_width", """
WITH l AS (SELECT doc_id, ln, unnest(generate_series(1, len(string_split(l, ' ')))) AS pos, string_split(l, ' ') AS p FROM (
    SELECT doc_id, unnest(generate_series(1, len(s))) AS ln, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) q, LATERAL (SELECT q.s[q.ln] AS l)),
w AS (SELECT doc_id, ln, pos, length(p[pos]) * .53 - .26 * length(regexp_replace(p[pos], '[^ilI''.,:;\\s]+', '', 'g')) + .32 * length(regexp_replace(p[pos], '[^mwMW]+', '', 'g')) AS w FROM l),
a AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, ln) AS total, count(*) OVER (PARTITION BY doc_id, ln) AS n,
   sum(w) OVER (PARTITION BY doc_id, ln ORDER BY pos) - w AS before FROM w),
b AS (SELECT *, least(.006, .8 / (n * 12)) AS gap FROM a WHERE total > 0)
SELECT doc_id, count(*) AS parts, round(sum(.1 + (.8 - gap * (n - 1)) * before / total + gap * (pos - 1)), 3) AS x, round(sum((.8 - gap * (n - 1)) * w / total), 3) AS w
FROM b GROUP BY doc_id""")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    parts = (lines.select("doc_id", "ln", F.posexplode(F.split("line", " ")).alias("pos", "part"))
             .withColumns({"x": F.lit(0.1), "w": F.lit(0.8)}))
    placed = layout.allocate_width(parts, ["doc_id", "ln"], "pos", "part", "x", "w")
    return (placed.filter("w IS NOT NULL").groupBy("doc_id")
            .agg(F.count("*").alias("parts"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("w"), 3).alias("w")))


@demo("parse_json_column", """
SELECT event_type, count(*) AS n, count(k) AS parsed, sum(k) AS total FROM (
  SELECT event_type, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY event_type""", total="BIGINT")
def _(t):
    broken = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    df = records.parse_json_column(t.events.withColumn("props", broken), "props", "k BIGINT")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.count("parsed.k").alias("parsed"), F.sum("parsed.k").alias("total"))


@demo("parse_fenced_json", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(t):
    kind, props = F.col("event_type"), F.col("props")
    reply = (F.when(kind == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == "view", F.concat(F.lit("Answer: "), props, F.lit(" done")))
             .when(kind == "error", F.lit("no answer")).otherwise(props))
    return t.events.select("event_id", records.parse_fenced_json(reply, "k BIGINT")["k"].alias("k"))


@demo("content_digest", """
SELECT doc_id, sha256('{"lang":' || to_json(lang) || ',"source":' || to_json(source) || ',"n_chars":' || n_chars || '}') AS digest,
  sha1(lang || '|' || source || '|' || text) AS memo FROM documents""")
def _(t):
    return t.documents.select("doc_id", records.content_digest("lang", "source", "n_chars").alias("digest"),
                              records.memo_digest("lang", "source", "text").alias("memo"))


@demo("fields_by_suffix", """
SELECT conv_id, turn, path, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS digest FROM conversations,
  (VALUES ('body.text_ru'), ('items.0.ru')) AS p(path) WHERE NOT regexp_full_match(text, '\\s*')""")
def _(t):
    doc = F.to_json(F.struct("role", F.struct(F.col("text").alias("text_ru"), "turn", F.col("role").alias("guru")).alias("body"),
                             F.array(F.struct(F.col("text").alias("ru"))).alias("items"), F.struct(F.col("text").alias("ru")).alias("printed")))
    df = t.conversations.select("conv_id", "turn", doc.alias("doc"))
    return records.fields_by_suffix(df, "doc").select("conv_id", "turn", "path", F.md5("value").alias("digest"))


@demo("drop_repeated_lines", """
SELECT doc_id, md5(CASE WHEN contains(text, chr(10)) AND en <> '' THEN array_to_string(list_filter(string_split(h, chr(10)), lambda x:
   NOT (regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '\\p{Han}') AND contains(trim(regexp_replace(en, '\\s+', ' ', 'g')), trim(regexp_replace(x, '\\s+', ' ', 'g'))))), chr(10)) ELSE h END) AS kept
FROM (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN translate(text, 'aou', '汉字页') ELSE text END AS h, regexp_extract(text, '[^\\n]*\\n[^\\n]*') AS en FROM documents)""")
def _(t):
    native = F.when(F.col("lang") == "fr", han_text()).otherwise(F.col("text"))
    english = F.regexp_extract("text", "[^\\n]*\\n[^\\n]*", 0)
    return t.documents.select("doc_id", F.md5(tx.drop_repeated_lines(native, english)).alias("kept"))


_RUN = "[①-⑳0-9]*\\s*[\\x{3400}-\\x{9fff}]+(?:[0-9\\s，。！？：；、“”‘’（）《》【】—…·]*[\\x{3400}-\\x{9fff}]+)*"


@demo("split_language_layers", f"""
WITH d AS (SELECT doc_id, translate(text, 'aou', '汉字页') AS h, text AS r FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(r, '[{tx._TONED_FROM}]') THEN list_filter(regexp_extract_all(r, '[A-Z]{{2,}}|\\p{{L}}+|[①-⑳]|[0-9]+|\\S'),
    lambda x: regexp_matches(x, '[{tx._TONED_FROM}]|^[A-Z]{{2,}}$|^[①-⑳]$')) ELSE [] END AS kept FROM d),
s AS (SELECT doc_id, h, kept, list_distinct(list_transform(list_filter(kept, lambda x: regexp_matches(x, '\\p{{L}}')), lambda x: lower(x))) AS gone,
    string_split(trim(regexp_replace(regexp_replace(h, '{_RUN}', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS words FROM k)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string(list_filter(words, lambda w: NOT list_contains(gone, lower(w))), ' '), '[①-⑳]', ' ', 'g'), '\\s+', ' ', 'g'))) AS english,
  md5(regexp_replace(array_to_string(regexp_extract_all(h, '{_RUN}'), ' '), '^\\s+|\\s+$', '', 'g')) AS native, md5(array_to_string(kept, ' ')) AS pinyin FROM s""")
def _(t):
    # The list of one struct, so that the three layers come from one reading of the text.
    layers = t.documents.select("doc_id", F.explode(F.array(tx.split_language_layers(han_text(), F.col("text")))).alias("s"))
    return layers.select("doc_id", *[F.md5(F.col("s")[c]).alias(c) for c in ("english", "native", "pinyin")])


_TRIGGER, _TARGET, _NEGATION = " (?:with|that|dans|und) ", " (?:are|le|die) ", " (?:the|la|not) [^.;\\n]{0,30}$"


@demo("proximity_flag", f"""
WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '{_TRIGGER}') AS hits, string_split_regex(text, '{_TRIGGER}') AS gaps FROM documents),
u AS (SELECT doc_id, text, i, hits[i] AS h, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS p
  FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM s)),
f AS (SELECT doc_id, i, trim(regexp_replace(substr(text, CAST(greatest(p - 70, 0) + 1 AS BIGINT), CAST(p + length(h) + 70 - greatest(p - 70, 0) AS BIGINT)), '\\s+', ' ', 'g')) AS e,
   substr(text, CAST(greatest(p - 70, 0) + 1 AS BIGINT), CAST(p + length(h) + 70 - greatest(p - 70, 0) AS BIGINT)) AS near, substr(text, CAST(greatest(p - 35, 0) + 1 AS BIGINT), CAST(p - greatest(p - 35, 0) AS BIGINT)) AS pre FROM u)
SELECT doc_id, arg_min(e, i) AS evidence FROM f WHERE regexp_matches(near, '{_TARGET}') AND NOT regexp_matches(pre, '{_NEGATION}') GROUP BY doc_id""")
def _(t):
    flag = tx.proximity_flag(F.col("text"), _TRIGGER, _TARGET, _NEGATION)
    return t.documents.select("doc_id", flag.alias("evidence")).filter("evidence IS NOT NULL")


@demo("spoken_match", """
SELECT conv_id, turn, a <> '' AND a = b AS matched FROM (SELECT conv_id, turn, lower(regexp_replace(text, '[\\s\\p{P}\\p{S}]+', '', 'g')) AS a,
  lower(regexp_replace(CASE WHEN turn % 2 = 0 THEN text ELSE left(text, greatest(length(text) - 4, 0)) END, '[\\s\\p{P}\\p{S}]+', '', 'g')) AS b FROM conversations)""")
def _(t):
    heard = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", "[.,]", "! ")).otherwise(
        F.expr("left(text, greatest(length(text) - 4, 0))"))
    return t.conversations.select("conv_id", "turn", tx.spoken_match(F.col("text"), heard).alias("matched"))


@demo("clamp_rating", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(greatest(1, least(5, floor(value / 10 + .5))) AS INT) END AS rating FROM events""")
def _(t):
    return t.events.select("event_id", tx.clamp_rating(F.when(F.col("event_type") != "view", F.col("value") / 10)).alias("rating"))


_TOKEN_VALUE = "token = \"[0-9a-f]{40}\""


@demo("secret_scan", "SELECT doc_id, pattern, hits FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS hits FROM documents" for n, p in
    {**tx.CREDENTIALS, "token_value": _TOKEN_VALUE}.items()) + ") WHERE hits > 0")
def _(t):
    # The last pattern fits the kind of secret this corpus holds.
    return records.secret_scan(t.documents.select("doc_id", "text"), "text", {**tx.CREDENTIALS, "token_value": _TOKEN_VALUE})


@demo("layer_counts", """
SELECT page_id, """ + ", ".join(f"len(regexp_extract_all(html, '{a}=')) AS n_{a}" for a in PAGE_ATTRS) + """,
  array_to_string(list_filter(['href', 'class', 'id', 'src', 'lang'], lambda a: NOT contains(html, a || '=')), ',') AS missing FROM pages""")
def _(t):
    m = tx.layer_counts(F.col("html"), PAGE_ATTRS)
    return t.pages.select("page_id", *[m[a].alias(f"n_{a}") for a in PAGE_ATTRS], tx.missing_layers(F.col("html"), PAGE_ATTRS).alias("missing"))


def _line_boxes(t):
    """Two boxes per line item, from its numbers."""
    c = F.col
    a = boxes.box(c("l_quantity") / 60, c("l_discount") * 5, c("l_tax") * 3 + 0.01, c("l_linenumber") / 20)
    b = boxes.box(c("l_tax") * 5, c("l_quantity") / 80, c("l_discount") * 4 + 0.02, c("l_linenumber") / 15)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", a.alias("a"), b.alias("b"))


_BOXES = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 60 AS ax, l_discount * 5 AS ay, l_tax * 3 + .01 AS aw, l_linenumber / 20 AS ah,
  l_tax * 5 AS bx, l_quantity / 80 AS by_, l_discount * 4 + .02 AS bw, l_linenumber / 15 AS bh FROM lineitem)"""


@demo("box_math", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(ax + aw, bx + bw) - least(ax, bx), 6) AS union_w, round(greatest(ay + ah, by_ + bh) - least(ay, by_), 6) AS union_h,
  round(least(1 - least(1, greatest(0, ax - .01)), greatest(.002, aw + .02)), 6) AS clamped_w,
  ax + aw / 2 BETWEEN bx AND bx + bw AND ay + ah / 2 BETWEEN by_ AND by_ + bh AS inside,
  round(CASE WHEN least(ax + aw, bx + bw) > greatest(ax, bx) AND least(ay + ah, by_ + bh) > greatest(ay, by_)
    THEN (least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by_ + bh) - greatest(ay, by_)) / (bw * bh) ELSE 0 END, 6) AS share,
  round(sqrt((ax + aw / 2 - bx - bw / 2) ** 2 + (ay + ah / 2 - by_ - bh / 2) ** 2), 6) AS dist,
  round(greatest(0, greatest(ax, bx) - least(ax + aw, bx + bw), greatest(ay, by_) - least(ay + ah, by_ + bh)), 6) AS gap FROM {_BOXES}""")
def _(t):
    a, b = F.col("a"), F.col("b")
    u = boxes.union(a, b)
    return _line_boxes(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(u["w"], 6).alias("union_w"), F.round(u["h"], 6).alias("union_h"),
        F.round(boxes.clamp(boxes.grow(a, 0.01, 0.01))["w"], 6).alias("clamped_w"), boxes.inside(a, b).alias("inside"),
        F.round(boxes.overlap_share(a, b), 6).alias("share"), F.round(boxes.center_dist(a, b), 6).alias("dist"), F.round(boxes.box_gap(a, b), 6).alias("gap"))


@demo("normalize_box", """
WITH r AS (SELECT *, CASE WHEN x > 1.05 AND x / 10 <= 1.05 THEN x / 10 ELSE x END AS rx, CASE WHEN w > 1.05 AND w / 10 <= 1.05 THEN w / 10 ELSE w END AS rw FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 12 AS x, l_discount AS y, l_tax * 20 AS w, l_discount AS h FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(1, rx), 6) AS x, round(y, 6) AS y, round(greatest(.002, least(1 - least(1, rx), rw)), 6) AS w, round(h, 6) AS h
FROM r WHERE rx + rw <= 1.1 AND y + h <= 1.1 AND rw > .002 AND h > .002""")
def _(t):
    c = F.col
    one = F.lit(1.0)
    b = boxes.normalize_box(c("l_quantity") / 12, c("l_discount"), c("l_tax") * 20, c("l_discount"), one, one)
    return (t.lineitem.withColumn("b", b).filter("b IS NOT NULL")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(f"b.{k}", 6).alias(k) for k in "xywh"]))


@demo("polygon_to_box", """
SELECT vec_id, round(list_min(embedding[1:4]), 5) AS x, round(list_min(embedding[5:8]), 5) AS y, round(list_max(embedding[1:4]) - list_min(embedding[1:4]), 5) AS w,
  round(list_max(embedding[5:8]) - list_min(embedding[5:8]), 5) AS h FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS embedding FROM embeddings)""")
def _(t):
    e = F.col("embedding").cast("array<double>")
    return (t.embeddings.withColumn("b", boxes.polygon_to_box(F.slice(e, 1, 4), F.slice(e, 5, 4))).filter("b IS NOT NULL")
            .select("vec_id", *[F.round(f"b.{k}", 5).alias(k) for k in "xywh"]))


@demo("fix_conditional_glyphs", """
SELECT l_linestatus, CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'l' WHEN 'N' THEN 'o' ELSE 'l' END ELSE CASE l_returnflag WHEN 'A' THEN '|' WHEN 'N' THEN 'O' ELSE 'I' END END AS text,
  CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN '|' WHEN 'N' THEN 'O' ELSE 'I' END END AS original_text,
  CASE WHEN l_linestatus = 'O' THEN 'phonetics-table-glyph-ambiguity' END AS normalization, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(t):
    glyph = F.when(F.col("l_returnflag") == "A", "|").when(F.col("l_returnflag") == "N", "O").otherwise("I")
    df = t.lineitem.select("l_linestatus", glyph.alias("text"))
    fixed = records.fix_conditional_glyphs(df, "text", F.col("l_linestatus") == "O")
    return fixed.groupBy("l_linestatus", "text", "original_text", "normalization").agg(F.count("*").alias("n"))
