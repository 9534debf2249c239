"""Ordered per-key computations that stay balanced when one key, or one value of the order, is hot.

A plain window puts all rows of a key into one task.  ``Ordered`` looks at a sample of (keys, order), about ``_PER_CHUNK`` rows for
each of the session's shuffle partitions, and cuts every key that has more than a partition's share: into chunks of about that
share, at sampled places of its order.  A place that alone fills a chunk is shared out over several by a hash of the rows.  All
other keys stay whole.  A window runs inside each (key, chunk), and what a cut key's other chunks contribute is a carry taken from
one summary row per chunk.  There is one way for every size; without keys the whole table is one key.

The sample is one small job that reads keys and order columns only.  Split points, cut keys and carries are no more than the
sampled rows, so they are safe on the driver and in a broadcast.  Rows alike in all columns share a chunk.  The rows of cut
keys are read once more for the summaries; a caller with a costly input writes it first (``cut_lineage``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage

_PER_CHUNK = 24  # sampled rows per chunk used to place the split points
_SEED = 11
_CHUNK, _HOT = "__ord_chunk", "__ord_hot"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _nulls_first(v):
    """Sort key that orders values, and structs field by field, as Spark does."""
    if isinstance(v, (tuple, list)):
        return True, tuple(_nulls_first(x) for x in v)
    if isinstance(v, float):
        return True, (v != v, 0.0 if v != v else v)  # NaN is the largest number
    return v is not None, 0 if v is None else v


def _bounds(places: list[tuple]) -> list[tuple[tuple, float]]:
    """First (place, share of its rows) of every chunk after the first, from a key's sampled places in order."""
    out, filled = [], 0
    for place, same in itertools.groupby(places):
        n = len(list(same))
        if filled >= _PER_CHUNK or n >= _PER_CHUNK and filled:
            out.append((place, 0.0))
            filled = 0
        if n >= _PER_CHUNK:
            out += [(place, k / (n // _PER_CHUNK)) for k in range(1, n // _PER_CHUNK)]
            filled = _PER_CHUNK
        else:
            filled += n
    return out


class Ordered:
    """Adds ordered columns to ``df`` within ``keys`` (none = the whole table).

    ``order`` lists ascending columns (nulls first); rows that it leaves tied come in any order.  ``chunks`` is the number of parts the table
    is cut into, by default the session's number of shuffle partitions.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column], *, chunks: int | None = None):
        self.keys = list(keys)
        self.order = [_col(c) for c in order]
        self.hot, shared = self._split_points(df, chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if shared:
            self.order.append(F.xxhash64(*df.columns))
        self.df = df if self.hot is None else self._chunked(df)

    # -- choosing the chunks -------------------------------------------------

    def _split_points(self, df: DataFrame, chunks: int) -> tuple[DataFrame | None, bool]:
        """The cut keys with their split points (None where nothing is to be cut), and whether a place is shared out by a hash."""
        spark = df.sparkSession
        slim = df.select(*self.keys, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)]).alias("__ord_o"))
        wanted = F.lit(float(chunks * _PER_CHUNK)) / F.greatest(slim.agg(F.count(F.lit(1))).scalar(), F.lit(1))
        rows = [tuple(r) for r in slim.filter(F.rand(_SEED) < wanted).collect()]  # read once, so no later reading has to pick the same ones
        rows.sort(key=_nulls_first)
        table, shared = [], False
        for _, of_key in itertools.groupby(rows, key=lambda r: _nulls_first(r[:-1])):
            of_key = list(of_key)
            bounds = _bounds([tuple(r[-1]) for r in of_key])
            if bounds:
                shared |= any(share for _, share in bounds)
                # Two levels keep the search for a row's chunk near the square root of their number.
                width = max(1, int(len(bounds) ** 0.5))
                table.append([*of_key[0][:-1], bounds, width])
        if not table:
            return None, False
        least = -(1 << 63)
        for row in table:
            full = [(*at, least + int(share * 2.0 ** 64)) if shared else at for at, share in row[-2]]
            row[-2:] = [full, full[::row[-1]], row[-1]]
        order_type = T.StructType([*slim.schema["__ord_o"].dataType.fields, *[T.StructField(f"o{len(self.order)}", T.LongType())] * shared])
        return spark.createDataFrame(table, T.StructType([
            *[f for f in slim.schema.fields if f.name != "__ord_o"], T.StructField("__ord_bounds", T.ArrayType(order_type)),
            T.StructField("__ord_coarse", T.ArrayType(order_type)), T.StructField("__ord_width", T.IntegerType())])), shared

    def _chunked(self, df: DataFrame) -> DataFrame:
        order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        cols = df.columns
        joined = (df.withColumn("__ord_o", order).alias("l")
                  .join(F.broadcast(self.hot.alias("r")), null_safe("l", "r", self.keys), "left"))
        coarse = F.size(F.filter("__ord_coarse", lambda b: b <= F.col("__ord_o")))
        start = (coarse - 1) * F.col("__ord_width")
        fine = F.size(F.filter(F.slice("__ord_bounds", start + 1, F.col("__ord_width")), lambda b: b <= F.col("__ord_o")))
        chunk = F.when(F.col("__ord_bounds").isNull() | (coarse == 0), 0).otherwise(start + fine)
        return joined.select(*[F.col(f"l.{c}") for c in cols], chunk.cast("int").alias(_CHUNK),
                             F.col("__ord_bounds").isNotNull().alias(_HOT))

    # -- adding columns --------------------------------------------------------

    def add(self, **specs: tuple) -> "Ordered":
        """Add columns; each spec is ``(kind, column)`` with one of the kinds below.

        sum, max, min, last  running, up to and including the row (last = last non-null value)
        prior_max, prior_last  the same over the earlier rows only
        next                 first non-null value of the later rows
        lag, lead            the row directly before or after
        row                  1, 2, 3 ... in order (no column)
        total                sum over all rows of the key
        """
        specs = {n: (s if isinstance(s, tuple) else (s,)) for n, s in specs.items()}
        parts = self.keys + ([_CHUNK] if self.hot is not None else []) or [F.lit(0)]  # less than a chunk in all: one group
        inner = Window.partitionBy(*parts).orderBy(*self.order)
        back_order = [c.desc_nulls_last() for c in self.order]
        inner_back = Window.partitionBy(*parts).orderBy(*back_order)
        upto = inner.rowsBetween(Window.unboundedPreceding, 0)
        before = inner.rowsBetween(Window.unboundedPreceding, -1)
        after = inner_back.rowsBetween(Window.unboundedPreceding, -1)
        local = {}
        for name, (kind, *arg) in specs.items():
            c = _col(arg[0]) if arg else None
            if kind == "row":
                local[name] = F.row_number().over(inner).cast("long")
            elif kind == "total":
                local[name] = F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            elif kind in ("sum", "max", "min"):
                local[name] = getattr(F, kind)(c).over(upto)
            elif kind == "last":
                local[name] = F.last(c, True).over(upto)
            elif kind == "prior_max":
                local[name] = F.max(c).over(before)
            elif kind == "prior_last":
                local[name] = F.last(c, True).over(before)
            elif kind == "next":
                local[name] = F.last(c, True).over(after)
            elif kind in ("lag", "lead"):
                local[name] = getattr(F, kind)(c, 1).over(inner)
            else:
                raise ValueError(f"unknown ordered column kind: {kind}")
        if self.hot is None:
            self.df = self.df.withColumns(local)
            return self
        carries = self._carries(specs)
        edge = {}
        if any(k == "lag" for k, *_ in specs.values()):
            edge["__ord_head"] = F.row_number().over(inner) == 1
        if any(k == "lead" for k, *_ in specs.values()):
            edge["__ord_tail"] = F.row_number().over(inner_back) == 1
        df = self.df.withColumns({**local, **edge})
        cols = df.columns
        joined = df.alias("l").join(F.broadcast(carries.alias("r")),
                                    null_safe("l", "r", self.keys + [_CHUNK]), "left")
        out = []
        for c in cols:
            if c in ("__ord_head", "__ord_tail"):
                continue
            if c not in specs:
                out.append(F.col(f"l.{c}"))
                continue
            kind, mine, carry = specs[c][0], F.col(f"l.{c}"), F.col(f"r.{c}")
            if kind in ("sum", "row"):
                v = F.when(mine.isNull(), carry).otherwise(mine + F.coalesce(carry, F.lit(0)))
            elif kind in ("max", "prior_max"):
                v = F.greatest(mine, carry)
            elif kind == "min":
                v = F.least(mine, carry)
            elif kind in ("last", "prior_last", "next"):
                v = F.coalesce(mine, carry)
            elif kind == "total":  # the carry is that of all chunks
                v = F.coalesce(carry, mine)
            else:
                v = F.when(F.col("__ord_head" if kind == "lag" else "__ord_tail"), F.col(f"r.{c}.v")).otherwise(mine)
            out.append(v.alias(c))
        self.df = joined.select(*out)
        return self

    def _carries(self, specs: dict) -> DataFrame:
        """One row per hot (key, chunk) with what the other chunks contribute to it."""
        order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        aggs = []
        for name, (kind, *arg) in specs.items():
            c = _col(arg[0]) if arg else None
            if kind == "row":
                a = F.count(F.lit(1))
            elif kind in ("sum", "total"):
                a = F.sum(c)
            elif kind in ("max", "prior_max"):
                a = F.max(c)
            elif kind == "min":
                a = F.min(c)
            elif kind in ("last", "prior_last"):
                a = F.max_by(c, F.when(c.isNotNull(), order))
            elif kind == "next":
                a = F.min_by(c, F.when(c.isNotNull(), order))
            elif kind == "lag":
                a = F.max_by(F.struct(c.alias("v")), order)
            else:
                a = F.min_by(F.struct(c.alias("v")), order)
            aggs.append(a.alias(name))
        summary = self.df.filter(_HOT).groupBy(*self.keys, _CHUNK).agg(*aggs)
        w = (Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))).orderBy(_CHUNK)
        wb = (Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(_CHUNK))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        after = wb.rowsBetween(Window.unboundedPreceding, -1)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols = []
        for name, (kind, *_) in specs.items():
            c = F.col(name)
            if kind in ("sum", "row"):
                v = F.sum(c).over(before)
            elif kind == "total":
                v = F.sum(c).over(whole)
            elif kind in ("max", "prior_max"):
                v = F.max(c).over(before)
            elif kind == "min":
                v = F.min(c).over(before)
            elif kind in ("last", "prior_last"):
                v = F.last(c, True).over(before)
            elif kind == "next":
                v = F.last(c, True).over(after)
            else:
                v = F.lag(c, 1).over(w) if kind == "lag" else F.lag(c, 1).over(wb)
            cols.append(v.alias(name))
        return summary.select(*self.keys, _CHUNK, *cols)

    def with_columns(self, **cols: Column) -> "Ordered":
        self.df = self.df.withColumns(cols)
        return self

    def done(self) -> DataFrame:
        """The table without the helper columns."""
        return self.df.drop(_CHUNK, _HOT)


def weighted_rank_pick(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], size: str = "n") -> DataFrame:
    """Values at given ranks per key, without gathering a key's rows in one task.

    Equal values are counted first, so the shuffle carries one row per (key, value).  ``picks`` maps an
    output name to a rank (1-based) written in terms of the count column ``__n``.
    """
    counted = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")))
    sizes = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    run = Ordered(counted, keys, [value]).add(__upto=("sum", "__c")).done()
    joined = (run.alias("l").join(sizes.alias("r"), null_safe("l", "r", keys))
              .select("l.*", "r.__n"))
    def hit(rank: Column) -> Column:
        return (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank)
    return joined.groupBy(*keys).agg(
        F.max("__n").alias(size),
        *[F.max(F.when(hit(r), F.col(value))).alias(n) for n, r in picks.items()])
