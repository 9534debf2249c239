"""Tied values of the order: shared out over chunks, looked up once, and never all on the driver or in one task."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators.matching import next_larger
from folioframe.operators.ordered import _CHUNK, _PER_CHUNK, Ordered, _bounds
from folioframe.operators.sequences import as_of

N = 1_000_000


def chunk_sizes(ordered):
    return [r["count"] for r in ordered.df.groupBy(*ordered.keys, _CHUNK).count().collect()]


@pytest.mark.parametrize("value", ["id % 3", "0", "if(id % 2 = 0, 0, id)", "id"])
def test_no_chunk_has_more_than_twice_the_mean(spark, value):
    o = Ordered(spark.range(N).withColumn("v", F.expr(value)), [], ["v"])
    sizes = chunk_sizes(o)
    assert len(sizes) > 4 and max(sizes) <= 2 * N / 8
    got = o.add(i=("row",), s=("sum", "v"), before=("lag", "v")).done()
    assert got.agg(F.count_distinct("i"), F.min("i"), F.max("i"), F.max("s")).first()[:3] == (N, 1, N)
    assert got.filter("before > v").isEmpty()


def test_sample_is_bounded(spark):
    df = spark.range(N).select((F.col("id") % 3).alias("v"))
    points = Ordered(df, [], ["v"]).hot.collect()
    assert sum(len(r["__ord_bounds"]) for r in points) <= 24 and _PER_CHUNK == 24  # 8 shuffle partitions, 192 sampled rows


@pytest.mark.parametrize("rows", [20_000, N])
def test_next_larger_of_few_needs(spark, rows):
    needs = spark.range(rows).select((F.col("id") % 50).cast("double").alias("need"))
    steps = spark.createDataFrame([(float(i),) for i in range(0, 45, 7)], "step double")
    got = {r.need: (r.step, r["count"]) for r in next_larger(needs, steps, "need", "step").groupBy("need", "step").count().collect()}
    assert got == {float(n): (min((float(i) for i in range(0, 45, 7) if i >= n), default=42.0), rows // 50) for n in range(50)}


def test_as_of_ties_take_the_largest_value(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("a", 2.0, 2), ("b", 1.0, 3), (None, 1.0, 4), ("a", None, 5)], "k string, at double, n int")
    right = spark.createDataFrame([("a", 1.0, 5), ("a", 1.0, 9), ("a", 1.0, None), ("a", 0.0, 7), (None, 0.5, 3)], "k string, at double, v int")
    got = sorted(map(tuple, as_of(left, right, ["k"], F.col("at"), F.col("at"), F.col("v"), "hit").select("n", "hit").collect()))
    assert got == [(1, 9), (1, 9), (2, 9), (3, None), (4, 3), (5, None)]
    strict = sorted(map(tuple, as_of(left, right, ["k"], F.col("at"), F.col("at"), F.col("v"), "hit", strict=True).select("n", "hit").collect()))
    assert strict == [(1, 7), (1, 7), (2, 9), (3, None), (4, 3), (5, None)]


def test_bounds():
    many, few = _PER_CHUNK * 3, 5
    assert _bounds([(1,)] * few) == []
    assert _bounds([(1,)] * many) == [((1,), 1 / 3), ((1,), 2 / 3)]
    assert _bounds([(0,)] * few + [(1,)] * many + [(2,)] * few) == [((1,), 0.0), ((1,), 1 / 3), ((1,), 2 / 3), ((2,), 0.0)]
    assert [p for (p,), _ in _bounds([(i,) for i in range(100)])] == [24, 48, 72, 96]
