"""Streaming forms of the journals; event times without a zone are taken as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.rollups import LOCAL_ZONE

MESSAGE_LIMIT = 6000
PAGE_LIMIT = 300


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def debounce_stream(df: DataFrame, keys: list[str], ts: str, value: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Last change of every burst, sent once no later change can join it."""
    bursts = _timed(df, ts, delay).groupBy(*keys, F.session_window(ts, gap))
    return bursts.agg(F.max_by(F.struct(*value), F.struct(ts, *value)).alias("__v"), F.count(F.lit(1)).alias("changes")).select(
        *keys, F.col("session_window.start").alias("start"), "__v.*", "changes")


def _local_days(df: DataFrame, ts: str, delay: str, zone: str) -> DataFrame:
    local = df.withColumn("__local", F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    return local.withWatermark("__local", delay)


def activity_stream(df: DataFrame, keys: list[str], ts: str, seconds: str, *, zone: str = LOCAL_ZONE, delay: str = "1 hour") -> DataFrame:
    """Seconds per key and local day, sent when the day is closed."""
    days = _local_days(df, ts, delay, zone).groupBy(*keys, F.window("__local", "1 day"))
    total = F.sum(F.greatest(F.coalesce(F.col(seconds), F.lit(0)), F.lit(0)))
    return days.agg(total.alias("seconds")).select(*keys, F.to_date("window.start").alias("day"), "seconds")


def activity_words_stream(df: DataFrame, keys: list[str], ts: str, word: str, *, zone: str = LOCAL_ZONE, delay: str = "1 hour") -> DataFrame:
    """Distinct words per key and local day: the first sight of a word is kept in state, then counted."""
    day = _local_days(df.filter(F.col(word) != ""), ts, delay, zone).withColumn("__day", F.window("__local", "1 day"))
    once = day.dropDuplicates([*keys, "__day", word])
    return once.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("words")).select(*keys, F.to_date("__day.start").alias("day"), "words")


def feedback_rows(df: DataFrame, message: str, page: str) -> DataFrame:
    """Trimmed feedback with a flag: a message of 1 to 6000 characters, a page of at most 300."""
    m, p = F.trim(F.coalesce(F.col(message), F.lit(""))), F.trim(F.coalesce(F.col(page), F.lit("")))
    return df.withColumns({message: m, page: p, "valid": F.length(m).between(1, MESSAGE_LIMIT) & (F.length(p) <= PAGE_LIMIT)})


def feedback_stream(df: DataFrame, message: str, page: str, accepted_path: str, quarantine_path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends valid rows to one table and the others to a quarantine.

    Each micro-batch writes to folders named by its number and overwrites them, so a repeated batch
    leaves no duplicates.
    """
    def split(batch: DataFrame, number: int) -> None:
        for keep, path in ((F.col("valid"), accepted_path), (~F.col("valid"), quarantine_path)):
            batch.filter(keep).drop("valid").write.mode("overwrite").parquet(f"{path}/batch={number}")
    return feedback_rows(df, message, page).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def journal_dedup_stream(df: DataFrame, ts: str, source_key: str, digest: str, delay: str = "1 day") -> DataFrame:
    """First entry per source key, then per content hash, while it is within the watermark.

    Entries without a source key or without a hash are not compared by it.  Filling empty fields from later
    copies needs the whole journal and is done by ``dedup_richest``.
    """
    def once(rows: DataFrame, c: str) -> DataFrame:
        filled = F.coalesce(F.col(c), F.lit("")) != ""
        return rows.filter(filled).dropDuplicatesWithinWatermark([c]).unionByName(rows.filter(~filled))
    return once(once(_timed(df, ts, delay), source_key), digest)
