"""Keyed state over streams: admission limits, review progress, idempotent requests.

These need the RocksDB state store; ``state_store(spark)`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import null_safe
from ..operators.sequences import RETRY_MS, REVIEW_DAYS, millis, tag_runs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def admit(times: list[int], now: int, limit: int, window: int) -> bool:
    """One step of the sliding limit; ``times`` holds the admitted calls still in the window and is updated."""
    while times and now - times[0] > window:
        times.pop(0)
    if len(times) >= limit:
        return False
    times.append(now)
    return True


class _Admission(StatefulProcessor):
    def __init__(self, key: str, limit: int, window: int):
        self.key, self.limit, self.window = key, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("admitted", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.times.get() if self.times.exists() else None
        times = list(state[0]) if state else []
        # A key's rows of one batch arrive in parts; only their times and ids are held for sorting.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "call"])
        admitted = [admit(times, int(ms), self.limit, self.window) for ms in batch["ms"]]
        self.times.update((times,))
        yield pd.DataFrame({self.key: key[0], "call": batch["call"], "admitted": admitted})

    def close(self) -> None:
        pass


def admission_stream(df: DataFrame, key: str, call: str, ts: str, limit: int = 30, window_ms: int = 60_000) -> DataFrame:
    """Whether each call is admitted: fewer than ``limit`` admitted calls of its key in the last window.

    Rejected calls do not count, and a call leaves the window after strictly more than its length.  The
    state of a key is at most ``limit`` times.
    """
    rows = df.select(key, F.col(call).cast("long").alias("call"), millis(ts).alias("ms"))
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, call bigint, admitted boolean"
    return rows.groupBy(key).transformWithStateInPandas(_Admission(key, limit, window_ms), out, "Append", "None")


def admission(df: DataFrame, keys: list[str], call: str, ts: str, limit: int = 30, window_ms: int = 60_000) -> DataFrame:
    """Batch form of ``admission_stream``.

    A pause longer than the window empties it, so a key falls into independent runs; they spread over the
    tasks, and each run is followed in time order with a state of at most ``limit`` times.
    """
    rows = df.select(*keys, F.col(call).cast("long").alias("call"), millis(ts).alias("ms"))
    runs = tag_runs(rows, keys, ["ms", "call"], F.col("ms"), window_ms)
    # A run of up to ``limit`` calls admits all of them and needs no Python.
    sizes = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("__n"))
    sized = runs.alias("l").join(sizes.alias("r"), null_safe("l", "r", [*keys, "run"])).select("l.*", "r.__n")
    small = sized.filter(F.col("__n") <= limit).select(*keys, "call", F.lit(True).alias("admitted"))
    big = sized.filter(F.col("__n") > limit).select(*keys, "run", "ms", "call")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, times = None, []
        for pdf in batches:
            out = []
            for *group, ms in zip(*[pdf[k] for k in [*keys, "run"]], pdf["ms"]):
                if group != here:
                    here, times = group, []
                out.append(admit(times, int(ms), limit, window_ms))
            yield pdf[[*keys, "call"]].assign(admitted=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields)
    ordered = big.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "ms", "call")
    return small.unionByName(ordered.mapInPandas(follow, schema))


class _Review(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", "attempts bigint, successes bigint, level int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, successes, level = self.state.get() if self.state.exists() else (0, 0, 0)
        out = []
        for ms, attempt, ok in pd.concat(list(rows), ignore_index=True).sort_values(["ms", "attempt"])[["ms", "attempt", "passed"]].itertuples(index=False):
            attempts, successes, level = attempts + 1, successes + int(ok), min(level + 1, 5) if ok else 0
            out.append((key[0], attempt, attempts, successes, level, ms + (REVIEW_DAYS[level] * 86_400_000 if ok else RETRY_MS)))
        self.state.update((attempts, successes, level))
        yield pd.DataFrame(out, columns=[self.key, "attempt", "attempts", "successes", "level", "due_ms"])

    def close(self) -> None:
        pass


def review_state_stream(df: DataFrame, key: str, attempt: str, ts: str, passed: Column) -> DataFrame:
    """Review state after every attempt, kept per key; the batch form is ``review_ladder``."""
    rows = df.select(key, F.col(attempt).cast("long").alias("attempt"), millis(ts).alias("ms"), passed.alias("passed"))
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, attempt bigint, attempts bigint, successes bigint, level int, due_ms bigint"
    return rows.groupBy(key).transformWithStateInPandas(_Review(key), out, "Append", "None")


class _Queue(StatefulProcessor):
    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        busy = bool(self.state.get()[0]) if self.state.exists() else False
        out = []
        for ms, item, action in pd.concat(list(rows), ignore_index=True).sort_values(["ms", "item"])[["ms", "item", "action"]].itertuples(index=False):
            if action == "request":
                out.append((key[0], item, "absorbed" if busy else "accepted"))
                busy = True
            elif action == "finish":
                busy = False
        self.state.update((busy,))
        yield pd.DataFrame(out, columns=[self.key, "item", "outcome"])

    def close(self) -> None:
        pass


def queue_stream(df: DataFrame, key: str, item: str, ts: str, request: Column, finish: Column) -> DataFrame:
    """Requests accepted or absorbed by open work of their key; the batch form is ``idempotent_queue``."""
    action = F.when(request, "request").when(finish, "finish")
    rows = df.select(key, F.col(item).cast("long").alias("item"), millis(ts).alias("ms"), action.alias("action")).filter("action IS NOT NULL")
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, item bigint, outcome string"
    return rows.groupBy(key).transformWithStateInPandas(_Queue(key), out, "Append", "None")
