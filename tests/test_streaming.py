"""Streaming forms against their batch twins, with availableNow triggers over several files."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.operators import rollups as ru
from folioframe.operators import sequences as sq
from folioframe.streaming import journals, state


@pytest.fixture
def source(spark, events, tmp_path):
    """The events as a stream of files in time order."""
    def make(df, order):
        path = str(tmp_path / "in")
        part = F.ntile(3).over(Window.orderBy(order))
        parts = df.withColumn("__p", part).cache()
        for n in (1, 2, 3):  # one after the other, since files are read by their time
            parts.filter(F.col("__p") == n).drop("__p").coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return make


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def naive_admission(calls, limit, window):
    out, times = {}, {}
    for user, ms, call in sorted(calls, key=lambda c: (c[1], c[2])):
        kept = [t for t in times.get(user, []) if ms - t <= window]
        out[call] = len(kept) < limit
        times[user] = kept + [ms] if out[call] else kept
    return out


def test_admission_stream_and_batch(spark, events, source, tmp_path):
    state.state_store(spark)
    df = events.withColumn("user", F.col("user_id") % 5)
    calls = [(r.user, r.ms, r.event_id) for r in df.select("user", sq.millis("ts").alias("ms"), "event_id").collect()]
    want = naive_admission(calls, 3, 3_600_000)
    assert 0 < sum(want.values()) < len(want)
    batch = {r.call: r.admitted for r in state.admission(df, ["user"], "event_id", "ts", 3, 3_600_000).collect()}
    assert batch == want
    stream = run(spark, state.admission_stream(source(df, "ts"), "user", "event_id", "ts", 3, 3_600_000), tmp_path, "admission")
    assert {c: a for _, c, a in stream} == want


def test_review_state_stream(spark, events, source, tmp_path):
    state.state_store(spark)
    ok = F.col("event_type") != "error"
    want = rows(sq.review_ladder(events, ["user_id"], ["ts", "event_id"], "ts", ok).select("user_id", "event_id", "attempts", "successes", "level", "due_ms"))
    got = run(spark, state.review_state_stream(source(events, "ts"), "user_id", "event_id", "ts", ok), tmp_path, "review")
    assert got == want


def test_queue_stream(spark, events, source, tmp_path):
    state.state_store(spark)
    request, finish = F.col("event_type").isin("click", "view"), F.col("event_type") == "purchase"
    want = rows(sq.idempotent_queue(events, ["user_id"], ["ts", "event_id"], request, finish).select("user_id", "event_id", "outcome"))
    got = run(spark, state.queue_stream(source(events, "ts"), "user_id", "event_id", "ts", request, finish), tmp_path, "queue")
    assert got == want


def test_activity_stream(spark, events, source, tmp_path):
    want = {(u, d): round(s, 4) for u, d, s in events.transform(lambda e: ru.daily_activity(e, ["user_id"], "ts", "value", "props")).select("user_id", "day", "seconds").collect()}
    got = {(u, d): round(s, 4) for u, d, s in run(spark, journals.activity_stream(source(events, "ts"), ["user_id"], "ts", "value"), tmp_path, "activity")}
    last = max(d for _, d in want)
    # The last day stays open until the watermark passes it.
    assert got == {k: v for k, v in want.items() if k[1] < last}


def test_activity_words_stream(spark, events, source, tmp_path):
    want = {(u, d): w for u, d, w in ru.daily_activity(events, ["user_id"], "ts", "value", "props").select("user_id", "day", "words").collect()}
    got = {(u, d): w for u, d, w in run(spark, journals.activity_words_stream(source(events, "ts"), ["user_id"], "ts", "props"), tmp_path, "words")}
    last = max(d for _, d in want)
    assert got == {k: v for k, v in want.items() if k[1] < last}


def test_debounce_stream(spark, events, source, tmp_path):
    want = {r.event_id for r in sq.debounce(events, ["user_id"], ["ts", "event_id"], "ts", 1_800_000).collect()}
    got = {r[2] for r in run(spark, journals.debounce_stream(source(events, "ts"), ["user_id"], "ts", ["event_id"], "30 minutes"), tmp_path, "debounce")}
    open_ = {r.event_id for r in events.filter(F.col("ts") > F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("interval 1 hour")).collect()}
    assert got <= want and want - got <= open_


def test_feedback_stream(spark, source, tmp_path):
    df = spark.createDataFrame([(1, " good ", "p1"), (2, "  ", "p"), (3, "x" * 6001, "p"), (4, "y" * 6000, "q" * 300), (5, "z", "q" * 301), (6, None, "p")], "id int, message string, page string")
    a, b = str(tmp_path / "ok"), str(tmp_path / "bad")
    q = journals.feedback_stream(source(df, "id"), "message", "page", a, b, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(a).collect()) == [1, 4]
    assert sorted(r.id for r in spark.read.parquet(b).collect()) == [2, 3, 5, 6]


def test_journal_dedup_stream(spark, source, tmp_path):
    rows_ = [(1, "a", "h1"), (2, "a", "h2"), (3, "", "h1"), (4, "", ""), (5, "", ""), (6, "b", "h3")]
    df = spark.createDataFrame(rows_, "id int, skey string, digest string").withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    got = run(spark, journals.journal_dedup_stream(source(df, "ts"), "ts", "skey", "digest"), tmp_path, "dedup")
    assert sorted(r[0] for r in got) == [1, 4, 5, 6]
