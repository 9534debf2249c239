"""Whole-table operators: catalogues, upserts, replacements, guarded exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


def ordered_catalog(df: DataFrame, sort_key: str, order: list[str]) -> DataFrame:
    """Rows with their position by sort key (missing ones first), then the other columns."""
    keyed = df.withColumn("__k", F.coalesce(F.col(sort_key), F.lit("")))
    return Ordered(keyed, [], ["__k", *order]).add(position=("row",)).done().drop("__k")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Source rows replace whole target rows with the same key; the last write wins."""
    rest = [c for c in target.columns if c not in keys]
    both = target.withColumn("__s", F.lit(0)).unionByName(source.withColumn("__s", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__s", *order)).alias("__r"))
    return last.select(*keys, "__r.*").select(*target.columns)


def replace_partition(target: DataFrame, source: DataFrame, part: list[str]) -> DataFrame:
    """All target rows of the partitions present in the source make way for the source rows.

    Partitions match by equality, never by a common prefix.
    """
    return target.join(source.select(*part).distinct(), part, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def overwrite_partitions(source: DataFrame, path: str, part: list[str]) -> None:
    """Write so that only the partitions present in ``source`` are replaced on disk."""
    source.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def manifest_upsert(manifest: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the entry of a page or append it; the result is in page order."""
    rest = [c for c in manifest.columns if c not in keys]
    both = manifest.select(*keys, F.struct(*rest).alias("__m")).join(pages.select(*keys, F.struct(*rest).alias("__p")), keys, "full")
    return both.withColumn("__r", F.coalesce("__p", "__m")).select(*keys, "__r.*").orderBy(*keys)


def allowlisted_export(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows and, per rule, of the rows that break it."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def refuse_unlisted(df: DataFrame, rules: dict[str, Column], must_be_empty: dict[str, DataFrame] | None = None) -> DataFrame:
    """``df`` itself when it has rows, no row breaks a rule and the other tables are empty; else an error."""
    summary = allowlisted_export(df, rules).first()
    broken = {k: v for k, v in summary.asDict().items() if k != "rows" and v}
    filled = [name for name, other in (must_be_empty or {}).items() if not other.isEmpty()]
    if broken or filled or not summary["rows"]:
        raise ValueError(f"export refused: rows={summary['rows']} broken rules={broken} unexpected tables={filled}")
    return df


def memo_join(work: DataFrame, cache: DataFrame, content: str, code: str, result: str, prompt: str) -> DataFrame:
    """Reuse a cached result when content and code hash agree; a changed prompt keeps it but asks for review.

    Of several cached rows of one key the one with the smallest prompt (then result) counts.
    """
    one = F.min(F.struct(F.col(prompt).alias("p"), F.col(result).alias("r")))
    c = (cache.groupBy(content, code).agg(one.alias("__c"))
         .select(content, code, F.col("__c.r").alias("__r"), F.col("__c.p").alias("__p"), F.lit(True).alias("__hit")))
    j = work.join(c, [content, code], "left")
    hit = F.col("__hit").isNotNull()
    return j.select(*work.columns, hit.alias("reused"), F.col("__r").alias(result),
                    (hit & ~F.col(prompt).eqNullSafe(F.col("__p"))).alias("review"))


def memo_misses(work: DataFrame, cache: DataFrame, content: str, code: str) -> DataFrame:
    """Work that has to be computed."""
    return work.join(cache.select(content, code).distinct(), [content, code], "left_anti")


def batch_status(items: DataFrame, done: DataFrame, keys: list[str], source_hash: str) -> DataFrame:
    """State of every item of a resumable run: queued, done, error, or skipped when its source changed.

    Of several rows of one key the one with the smallest state (then hash) counts.
    """
    one = F.min(F.struct(F.col("state").alias("s"), F.col(source_hash).alias("h")))
    d = done.groupBy(*keys).agg(one.alias("__d")).select(*keys, F.col("__d.h").alias("__h"), F.col("__d.s").alias("__s"))
    state = (F.when(F.col("__s").isNull(), "queued").when(~F.col("__h").eqNullSafe(F.col(source_hash)), "skipped").otherwise(F.col("__s")))
    return items.join(d, keys, "left").withColumn("state", state).drop("__h", "__s")


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
