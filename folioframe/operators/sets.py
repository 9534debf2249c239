"""Set comparisons of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


def expected_vs_returned(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """One row per problem: a missing, unexpected or repeated key."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    g = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    both = e.join(g, keys, "full")
    problems = F.array_compact(F.array(F.when(F.col("__n").isNull(), "missing"), F.when(F.col("__e").isNull(), "unexpected"),
                                       F.when(F.col("__n") > 1, "repeated")))
    return both.select(*keys, F.explode(problems).alias("problem"))


def ordered_union_distinct(first: DataFrame, second: DataFrame, value: str, order: str) -> DataFrame:
    """Values of both tables once, in order of first occurrence, the first table before the second."""
    both = first.select(value, F.lit(0).alias("__s"), F.col(order).alias("__o")).unionByName(
        second.select(value, F.lit(1).alias("__s"), F.col(order).alias("__o")))
    once = both.groupBy(value).agg(F.min(F.struct("__s", "__o")).alias("__at"))
    return Ordered(once, [], ["__at", value]).add(position=("row",)).done().drop("__at")


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
