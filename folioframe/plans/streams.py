"""Batch twins of the streaming operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as ru
from ..streaming import journals, state
from .demo import demo


@demo("admission")
def _(t):
    # Four calls per ten minutes and user, so that some are rejected.
    return state.admission(t.events.withColumn("user", F.col("user_id") % 20), ["user"], "event_id", "ts", limit=4, window_ms=3_600_000)


@demo("activity_days", """
SELECT user_id, CAST(ts + INTERVAL 5 HOUR AS DATE) AS day, round(sum(value), 2) AS seconds, count(DISTINCT props) AS words FROM events GROUP BY ALL""", day="VARCHAR")
def _(t):
    return ru.daily_activity(t.events, ["user_id"], "ts", "value", "props").withColumns({"seconds": F.round("seconds", 2), "day": F.col("day").cast("string")})


@demo("feedback_rows", """
SELECT conv_id, turn, length(trim(text)) AS n, length(trim(text)) BETWEEN 1 AND 6000 AND turn % 4 <> 3 AS valid FROM conversations""")
def _(t):
    page = F.when(F.col("turn") % 4 == 3, F.repeat(F.lit("x"), F.lit(301))).otherwise(F.col("role"))
    rows = journals.feedback_rows(t.conversations.withColumn("page", page), "text", "page")
    return rows.select("conv_id", "turn", F.length("text").alias("n"), "valid")


@demo("journal_dedup", """
WITH RECURSIVE d AS (SELECT doc_id, sha1(text) AS h, CASE WHEN doc_id % 10 = 0 THEN 'k' || (doc_id % 50) ELSE '' END AS k FROM documents),
e AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM d WHERE k <> ''),
r(n, ks, hs) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT e.n, CASE WHEN list_contains(ks, k) OR list_contains(hs, h) THEN ks ELSE list_append(ks, k) END,
  CASE WHEN list_contains(ks, k) OR list_contains(hs, h) THEN hs ELSE list_append(hs, h) END FROM r JOIN e ON e.n = r.n + 1)
SELECT min(doc_id) AS doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM e JOIN r ON r.n = e.n - 1 WHERE list_contains(ks, k)) GROUP BY h""")
def _(t):
    i = F.col("doc_id")
    d = t.documents.select("doc_id", F.sha1("text").alias("digest"), F.when(i % 10 == 0, F.concat(F.lit("k"), i % 50)).otherwise("").alias("skey"), "lang")
    return ru.dedup_richest(d, "skey", "digest", ["doc_id"], ["lang"]).select("doc_id")
