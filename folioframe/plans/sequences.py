"""Example queries for the order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choices as ch
from ..operators import sequences as sq
from .demo import demo

U = "PARTITION BY user_id ORDER BY ts, event_id"
EV = ["ts", "event_id"]


def kind(name):
    return F.col("event_type") == name


@demo("number_missing", """
SELECT event_id, coalesce(no, (SELECT max(event_id) FROM events WHERE event_type <> 'view') + row_number() OVER (PARTITION BY no IS NULL ORDER BY ts, event_id)) AS no
FROM (SELECT *, CASE WHEN event_type <> 'view' THEN event_id END AS no FROM events)""")
def _(t):
    df = t.events.select("event_id", "ts", F.when(~kind("view"), F.col("event_id")).alias("no"))
    return sq.number_missing(df, "no", EV).select("event_id", "no")


@demo("gap_runs", """
WITH a AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, event_id, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR ms - p > 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS run FROM a)
SELECT user_id, run, min(ms) AS start, max(ms) AS "end", count(*) AS n, count(*) / (max(ms) - min(ms) + 1) AS density FROM b GROUP BY user_id, run""", run="BIGINT")
def _(t):
    return sq.gap_runs(t.events, ["user_id"], EV, sq.millis("ts"), 7_200_000)


@demo("reading_order", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_partkey, l_suppkey, l_linenumber) - 1 AS id FROM lineitem""")
def _(t):
    done = sq.reading_order(t.lineitem, ["l_orderkey"], ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"])
    return done.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "id")


# Lines of a document as page lines: blank width as indent, y from the line number, longer gaps after long lines.
_LINES = """(SELECT doc_id, ln, length(l) % 7 / 50 AS x, ln * 2e-2 + (length(l) % 5) / 100 AS y, 12e-3 AS h FROM (
  SELECT doc_id, ln, s[ln] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(generate_series(1, len(string_split(text, chr(10))))) AS ln FROM documents)))"""


def _lines(t):
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "l")).withColumn("ln", F.col("ln") + 1)
    return d.select("doc_id", "ln", (F.length("l") % 7 / 50).alias("x"), (F.col("ln") * 0.02 + F.length("l") % 5 / 100).alias("y"), F.lit(0.012).alias("h"))


@demo("paragraphs", f"""
WITH a AS (SELECT *, lag(y + h) OVER (PARTITION BY doc_id ORDER BY y, ln) AS e, min(x) OVER (PARTITION BY doc_id) AS lft FROM {_LINES})
SELECT doc_id, ln, sum(CASE WHEN e IS NULL OR x > lft + .025 OR y > e + .025 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y, ln) AS paragraph FROM a""", paragraph="BIGINT")
def _(t):
    return sq.paragraphs(_lines(t), ["doc_id"], ["y", "ln"], "x", "y", "h").select("doc_id", "ln", "paragraph")


@demo("parse_choices", """
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS q, CASE WHEN role = 'assistant' THEN chr(65 + CAST(turn % 4 AS INT)) WHEN role = 'user' THEN '' END AS l, text FROM conversations),
f AS (SELECT conv_id, turn, text, last_value(q IGNORE NULLS) OVER w AS question, last_value(l IGNORE NULLS) OVER w AS letter FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, question, letter, md5(string_agg('- ' || text, '' ORDER BY turn)) AS answer, count(*) AS pieces FROM f WHERE question IS NOT NULL AND letter <> '' GROUP BY ALL""")
def _(t):
    body = F.concat(F.lit("- "), "text")
    line = (F.when(F.col("role") == "user", F.concat(F.col("turn"), F.lit(". "), body))
            .when(F.col("role") == "assistant", F.concat(F.expr("char(65 + turn % 4)"), F.lit(" "), body)).otherwise(body))
    parts = sq.parse_choices(t.conversations.withColumn("line", line), ["conv_id"], ["turn"], "line")
    return parts.select("conv_id", "question", "letter", F.md5("answer").alias("answer"), "pieces")


@demo("interval_assign", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN epoch_us(ts) - 60000000 ELSE epoch_us(ts) END,
  CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END) AS start FROM events QUALIFY event_type <> 'signup'""")
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lines, starts = t.events.filter(~kind("signup")), t.events.filter(kind("signup"))
    return sq.interval_assign(lines, starts, ["user_id"], us, us, "event_id", 60_000_000).select("event_id", "start")


_ITEMS = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity * 8 AS top, l_linenumber * 10.0 AS h, l_linenumber * 10.0 + l_discount * 400 - 10 AS req FROM lineitem)"


@demo("expansion_shift", f"""
WITH a AS (SELECT *, max(top + h) OVER (PARTITION BY l_orderkey ORDER BY top, l_partkey, l_suppkey, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_ITEMS}),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR top >= reach - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY top, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS band FROM a),
c AS (SELECT l_orderkey, band, max(top + h) AS e, max(greatest(0, req - h)) AS extra FROM b GROUP BY ALL)
SELECT i.l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(coalesce(sum(c.extra), 0), 4) AS shift, round(top + coalesce(sum(c.extra), 0), 4) AS shifted_top
FROM {_ITEMS} i LEFT JOIN c ON c.l_orderkey = i.l_orderkey AND c.e <= i.top + 1 AND c.extra > 0 GROUP BY i.l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, top""")
def _(t):
    h = F.col("l_linenumber") * 10.0
    ident = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    items = t.lineitem.select("l_orderkey", *ident, (F.col("l_quantity") * 8).alias("top"), h.alias("h"), (h + F.col("l_discount") * 400 - 10).alias("req"))
    done = sq.expansion_shift(items, ["l_orderkey"], ident, "top", "h", "req")
    return done.select("l_orderkey", *ident, F.round("shift", 4).alias("shift"), F.round("shifted_top", 4).alias("shifted_top"))


@demo("stack_rows", f"""
WITH a AS (SELECT user_id, ts, event_id, (epoch_us(ts) // 1000) / 3600000 AS y, value / 10 AS h, sum(value / 10 + .012) OVER ({U}) - (value / 10 + .012) AS c FROM events)
SELECT event_id, round(greatest(.012, max(y - c) OVER ({U})) + c, 4) AS stacked_y FROM a""")
def _(t):
    rows = t.events.select("user_id", "event_id", "ts", (sq.millis("ts") / 3_600_000).alias("y"), (F.col("value") / 10).alias("h"))
    return sq.stack_rows(rows, ["user_id"], EV, "y", "h", 0.012).select("event_id", F.round("stacked_y", 4).alias("stacked_y"))


@demo("adjacent_pairs", f"""
SELECT user_id, event_id AS open_id, nid AS close_id FROM (SELECT *, lead(event_type) OVER ({U}) AS n, lead(event_id) OVER ({U}) AS nid FROM events)
WHERE event_type = 'signup' AND n = 'error'""")
def _(t):
    return sq.adjacent_pairs(t.events, ["user_id"], EV, "event_type", "signup", "error", "event_id")


@demo("batches", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 60 AS batch FROM documents WHERE lang <> 'en'")
def _(t):
    return sq.batches(t.documents.filter("lang <> 'en'").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "batch")


_LADDER = f"""(WITH a AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER ({U}) AS attempts, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER ({U}) AS successes FROM events),
b AS (SELECT *, CAST(least(5, successes - coalesce(last_value(CASE WHEN NOT ok THEN successes END IGNORE NULLS) OVER ({U}), 0)) AS INT) AS level FROM a)
SELECT user_id, event_id, ts, attempts, successes, level, (epoch_us(ts) // 1000) + CASE WHEN ok THEN [0, 1, 3, 7, 14, 30][level + 1]::BIGINT * 86400000 ELSE 60000 END AS due_ms FROM b)"""


@demo("review_ladder", f"SELECT user_id, event_id, attempts, successes, level, due_ms FROM {_LADDER}", successes="BIGINT")
def _(t):
    done = sq.review_ladder(t.events, ["user_id"], EV, "ts", ~kind("error"))
    return done.select("user_id", "event_id", "attempts", "successes", "level", "due_ms")


@demo("due_queue", f"""
WITH s AS (SELECT user_id, arg_max(level, attempts) AS level, arg_max(due_ms, attempts) AS due_ms, max(attempts) AS attempts FROM {_LADDER} GROUP BY user_id),
n AS (SELECT (epoch_us(max(ts)) // 1000) AS now FROM events),
r AS (SELECT c_custkey AS user_id, level, due_ms, attempts, CASE WHEN due_ms IS NULL THEN 1 WHEN due_ms <= now THEN 0 ELSE 2 END AS rank FROM customer CROSS JOIN n LEFT JOIN s ON user_id = c_custkey)
SELECT user_id, attempts, level, due_ms, rank, row_number() OVER (ORDER BY rank, coalesce(due_ms, 0), user_id) AS position FROM r""")
def _(t):
    state = sq.review_state(t.events, ["user_id"], EV, "ts", ~kind("error"))
    learners = t.customer.select(F.col("c_custkey").alias("user_id")).join(state, "user_id", "left")
    now = t.events.agg(sq.millis(F.max("ts"))).scalar()
    return sq.due_queue(learners, [], "due_ms", now, ["user_id"]).select("user_id", "attempts", "level", "due_ms", "rank", "position")


@demo("lattice", """
WITH c AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS d, median(value) AS centre FROM events GROUP BY ALL),
s AS (SELECT *, centre - lag(centre) OVER (PARTITION BY event_type ORDER BY d) AS step, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i FROM c),
p AS (SELECT event_type, median(step) AS pitch FROM s GROUP BY ALL)
SELECT event_type, count(*) AS rows, round(median(centre - i * pitch), 6) AS start, round(any_value(pitch), 6) AS pitch FROM s JOIN p USING (event_type) GROUP BY ALL""")
def _(t):
    df = t.events.withColumn("d", F.to_date("ts"))
    return sq.lattice(df, ["event_type"], "d", "value").select("event_type", "rows", F.round("start", 6).alias("start"), F.round("pitch", 6).alias("pitch"))


@demo("reflow", """
WITH i AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation), n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL)
SELECT n_regionkey, i % 3 AS row, i // 3 AS col, n_name FROM i
UNION ALL SELECT n_regionkey, i % 3, i // 3, '' FROM (SELECT n_regionkey, unnest(generate_series(n, CAST(ceil(n / 3) * 3 - 1 AS BIGINT))) AS i FROM n)""")
def _(t):
    return sq.reflow(t.nation, ["n_regionkey"], ["n_nationkey"], "n_name", 3)


@demo("filtered_top", """
SELECT event_id, value, greatest((SELECT count(*) FROM events WHERE event_type = 'purchase') - 60, 0) AS remaining FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 60""")
def _(t):
    return sq.filtered_top(t.events.select("event_id", "event_type", "value"), kind("purchase"), [F.desc("value"), F.asc("event_id")]).drop("event_type")


@demo("last_per_key", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id DESC) = 1""")
def _(t):
    return sq.last_per_key(t.events, ["user_id"], EV, kind("purchase")).select("user_id", "event_id", "event_type")


@demo("attach_punctuation", """
WITH k AS (SELECT doc_id, regexp_extract_all(text, '\\p{Latin}+(?:[''’]\\p{Latin}+)*|\\p{Nd}+|\\S') AS k FROM documents),
p AS (SELECT doc_id, pos, k[pos] AS tok, regexp_matches(k[pos], '^[\\p{L}\\p{Nd}]') AS w FROM (SELECT doc_id, k, unnest(generate_series(1, len(k))) AS pos FROM k)),
g AS (SELECT *, sum(w::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM p),
f AS (SELECT *, g - min(g) OVER (PARTITION BY doc_id) + 1 AS piece FROM g)
SELECT doc_id, piece, string_agg(tok, '' ORDER BY pos) AS text FROM f GROUP BY ALL""", piece="BIGINT")
def _(t):
    from ..functions.text import mixed_tokens
    tokens = t.documents.select("doc_id", F.posexplode(mixed_tokens(F.col("text"))).alias("pos", "tok"))
    return sq.attach_punctuation(tokens, ["doc_id"], ["pos"], "tok", F.col("tok").rlike("^[\\p{L}\\p{Nd}]"))


_SERIES = "(SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)"
_SEGMENTS = f"""(WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c,
    row_number() OVER (PARTITION BY event_type ORDER BY n, h) AS r FROM {_SERIES}),
l AS (SELECT event_type, max(n) FILTER (r = floor(c * .2) + 1) AS p20, max(n) FILTER (r = floor(c * .95) + 1) AS p95 FROM s GROUP BY ALL),
u AS (SELECT s.event_type, i, c, lag(i) OVER (PARTITION BY s.event_type ORDER BY i) AS p FROM s JOIN l ON l.event_type = s.event_type WHERE n > p20 + (p95 - p20) * .3),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR i - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY i) AS g FROM u)
SELECT event_type, min(i) AS start, CASE WHEN max(c) - 1 - max(i) <= 2 THEN max(c) - 1 ELSE max(i) END AS "end" FROM g GROUP BY event_type, g HAVING "end" - start >= 3)"""


def _segments(t):
    series = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return sq.threshold_segments(series, ["event_type"], ["h"], "n", pause=2, shortest=3)


@demo("threshold_segments", f"SELECT * FROM {_SEGMENTS}")
def _(t):
    return _segments(t)


@demo("adjust_segments")
def _(t):
    return sq.adjust_segments(_segments(t), ["event_type"], 12)


@demo("trim_retention", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts, event_id) AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE event_type = 'purchase' OR age > n - 40""")
def _(t):
    return sq.trim_retention(t.events, ["user_id"], EV, kind("purchase"), 40).select("user_id", "event_id")


@demo("interpolate_missing", """
WITH g AS (SELECT event_type, d, CASE WHEN (d * 7 + length(event_type)) % 4 <> 0 THEN x END AS x FROM (SELECT event_type, day(ts) AS d, round(sum(value), 2) AS x FROM events GROUP BY ALL)),
n AS (SELECT g.*, (SELECT max(d) FROM g b WHERE b.event_type = g.event_type AND b.d < g.d AND b.x IS NOT NULL) AS a, (SELECT min(d) FROM g b WHERE b.event_type = g.event_type AND b.d > g.d AND b.x IS NOT NULL) AS z,
  (SELECT min(d) FROM g b WHERE b.event_type = g.event_type AND b.x IS NOT NULL) AS f, (SELECT max(d) FROM g b WHERE b.event_type = g.event_type AND b.x IS NOT NULL) AS l FROM g)
SELECT n.event_type, n.d, round(coalesce(n.x, ga.x + (gz.x - ga.x) * (n.d - n.a) / (n.z - n.a), gf.x + (gl.x - gf.x) * (n.d - n.f) / (n.l - n.f)), 4) AS x, n.x IS NULL AS recovered
FROM n LEFT JOIN g ga ON ga.event_type = n.event_type AND ga.d = n.a LEFT JOIN g gz ON gz.event_type = n.event_type AND gz.d = n.z
LEFT JOIN g gf ON gf.event_type = n.event_type AND gf.d = n.f LEFT JOIN g gl ON gl.event_type = n.event_type AND gl.d = n.l""")
def _(t):
    grid = t.events.groupBy("event_type", F.dayofmonth("ts").cast("long").alias("d")).agg(F.round(F.sum("value"), 2).alias("x"))
    grid = grid.withColumn("x", F.when((F.col("d") * 7 + F.length("event_type")) % 4 != 0, F.col("x")))
    done = sq.interpolate_missing(grid, [], "event_type", "d", "x")
    return done.select("event_type", "d", F.round("x", 4).alias("x"), "recovered")


@demo("carry_forward", f"""
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER ({U}),
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER ({U}), -1) AS lesson FROM events""")
def _(t):
    return sq.carry_forward(t.events, ["user_id"], EV, kind("signup"), kind("purchase"), F.col("event_id"), F.lit(-1), "lesson").select("event_id", "lesson")


@demo("lookahead", """
WITH a AS (SELECT conv_id, turn, role, lead(turn) OVER w AS t1, lead(role) OVER w AS r1, lead(turn, 2) OVER w AS t2, lead(role, 2) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN role = 'assistant' OR r1 = 'system' THEN NULL WHEN r1 = 'assistant' THEN t1 WHEN r2 = 'assistant' THEN t2 END AS answer FROM a""")
def _(t):
    role = F.col("role")
    done = sq.lookahead(t.conversations, ["conv_id"], ["turn"], role == "assistant", role == "system", F.col("turn"), "answer")
    return done.select("conv_id", "turn", "answer")


@demo("lookahead_pages", """
WITH a AS (SELECT conv_id, turn, role FROM conversations WHERE (conv_id + turn) % 4 <> 3)
SELECT a.conv_id, a.turn, CASE WHEN a.role = 'assistant' OR x.role IS NULL OR x.role = 'system' THEN NULL WHEN x.role = 'assistant' THEN x.turn WHEN y.role = 'assistant' THEN y.turn END AS answer
FROM a LEFT JOIN a AS x ON x.conv_id = a.conv_id AND x.turn = a.turn + 1 LEFT JOIN a AS y ON y.conv_id = a.conv_id AND y.turn = a.turn + 2""")
def _(t):
    role, kept = F.col("role"), t.conversations.filter("(conv_id + turn) % 4 <> 3")
    done = sq.lookahead(kept, ["conv_id"], ["turn"], role == "assistant", role == "system", F.col("turn"), "answer", number="turn")
    return done.select("conv_id", "turn", "answer")


@demo("debounce", f"""
SELECT user_id, event_id FROM (SELECT *, lead((epoch_us(ts) // 1000)) OVER ({U}) AS n FROM events) WHERE n IS NULL OR n - (epoch_us(ts) // 1000) > 1800000""")
def _(t):
    return sq.debounce(t.events, ["user_id"], EV, "ts", 1_800_000).select("user_id", "event_id")


@demo("idempotent_queue", f"""
SELECT event_id, CASE WHEN b = 'open' THEN 'absorbed' ELSE 'accepted' END AS outcome FROM (SELECT *, last_value(CASE WHEN event_type IN ('click', 'view') THEN 'open' WHEN event_type IN ('purchase', 'error') THEN 'closed' END IGNORE NULLS)
  OVER ({U} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE event_type IN ('click', 'view')""")
def _(t):
    request, finish = F.col("event_type").isin("click", "view"), F.col("event_type").isin("purchase", "error")
    return sq.idempotent_queue(t.events, ["user_id"], EV, request, finish).select("event_id", "outcome")


def choice_lines(t):
    """Lines of exercise pages: numbered letters, other letters and words, a few lines a page."""
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    text = (F.when((n == 1) & (F.col("l_suppkey") % 3 > 0), F.concat(key % 9 + 1, F.lit(". A "), key)).when(n == 1, F.concat(key % 9 + 1, F.lit(". Choose")))
            .when(n <= 4, F.concat(F.expr("char(64 + l_linenumber)"), F.lit(" "), key)).otherwise(F.concat(F.lit("word"), key)))
    return t.lineitem.select("l_suppkey", (F.col("l_partkey") % 40).alias("sheet"), (F.col("l_quantity") % 10 / 10).alias("x"),
                             (F.floor("l_extendedprice") % 12 * 0.03 + n % 3 * 0.002).alias("y"), text.alias("line"))


@demo("page_choices")
def _(t):
    return ch.page_choices(choice_lines(t), ["l_suppkey", "sheet"], "line", "x", "y")
