"""Pages cut into islands of boxes that cannot meet, and exact work inside an island.

Boxes whose vertical distance is over a gap can only meet through boxes between them, so a page falls apart into bands of
rows, and each band, by the horizontal distance, into islands.  Both cuts are ordered passes that split a hot page.  Whatever joins or grows boxes
within the gap stays inside one island, since the union of boxes of an island lies between its sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage
from .ordered import Ordered

BAND, ISLAND = "__band", "__island"


def placed(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """Whether all four numbers of a box are there and finite."""
    ok = F.lit(True)
    for c in (x, y, w, h):
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return ok


def _cut(df: DataFrame, keys: list[str], start: str, size: str, gap: float, order: list[str], out: str) -> DataFrame:
    """Number the stretches of intervals that lie ``gap`` or more apart."""
    o = Ordered(df.withColumn("__end", F.col(start) + F.col(size)), keys, [start, "__end", *order]).add(__reach=("prior_max", "__end"))
    o.with_columns(__new=(F.col("__reach").isNull() | (F.col(start) - F.col("__reach") >= gap)).cast("long")).add(**{out: ("sum", "__new")})
    return cut_lineage(o.done().drop("__end", "__reach", "__new"))


def islands(boxes: DataFrame, page: list[str], order: list[str], gap_x: float, gap_y: float) -> DataFrame:
    """``boxes`` (all placed; columns x, y, w, h) with band and island; boxes of different islands are a gap apart in x or in y."""
    banded = _cut(boxes, page, "y", "h", gap_y, order, BAND)
    return _cut(banded, [*page, BAND], "x", "w", gap_x, order, ISLAND)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which a new combination of keys begins in sorted rows."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        same = np.ones(len(rows) - 1, bool)
        for k in keys:
            v = rows[k].combine_chunks()
            a, b = v.slice(0, len(v) - 1), v.slice(1)
            alike = pc.equal(a, b)
            if pa.types.is_floating(v.type):
                alike = pc.or_(alike, pc.and_(pc.is_nan(a), pc.is_nan(b)))
            same &= pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.and_(pc.is_null(a), pc.is_null(b)), alike).to_numpy(zero_copy_only=False)
        new[1:] = ~same
    return np.flatnonzero(new)


def _flat(table: pa.Table) -> pa.Table:
    """The table with a column for each field of its structs."""
    while any(pa.types.is_struct(f.type) for f in table.schema):
        table = table.flatten()
    return table.rename_columns([str(n) for n in range(table.num_columns)])


def each_group(df: DataFrame, whole: list[str], order: list[Column], work: Callable[[pa.Table, np.ndarray], pa.Table | Iterator[pa.Table]], schema: T.StructType,
               sent: list[str | Column] | None = None) -> DataFrame:
    """``work`` on sorted rows of whole groups and the places where they begin, as many groups at a time as come in one batch.

    ``sent`` tells the columns that ``work`` gets, by default all; others are there to sort by.
    """
    def done(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        tables = work(rows, starts)
        for table in [tables] if isinstance(tables, pa.Table) else tables:
            yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            starts = _starts(rows, whole)
            if starts[-1]:
                yield from done(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None:
            yield from done(held, np.zeros(1, int))

    rows = df.repartition(*whole).sortWithinPartitions(*whole, *order)
    return (rows if sent is None else rows.select(*sent)).mapInArrow(run, schema)


def _boxes(table: pa.Table) -> np.ndarray:
    return np.column_stack([table[c].to_numpy().astype(np.float64) for c in "xywh"])


def _apart(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
    """Distance of a box from each of some boxes along an axis; negative where they overlap."""
    return np.maximum(a[axis], b[:, axis]) - np.minimum(a[axis] + a[axis + 2], b[:, axis] + b[:, axis + 2])


def each_island(df: DataFrame, page: list[str], order: list[Column], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    return each_group(df, [*page, BAND, ISLAND], order, work, schema)


# -- clusters of one island ----------------------------------------------------------------

EDGES = 1 << 18  # close pairs that are held before they are joined


def chained(box: np.ndarray, of: np.ndarray, join: float) -> np.ndarray:
    """Of each box the place of the first one that a chain of gaps under ``join`` connects it to; boxes of different ``of`` (in order) stay apart.

    From left to right, each box is compared with the next one, the one after it and so on, as long as those begin within reach: all boxes at a time.
    """
    first = np.arange(len(box))
    if not len(box) or join <= 0:
        return first

    def joined(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal first
        while len(a):
            low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
            apart = low < high
            a, b = a[apart], b[apart]
            np.minimum.at(first, high[apart], low[apart])
            while True:
                up = first[first]
                if (up == first).all():
                    break
                first = up

    order = np.lexsort((box[:, 0], of))
    x0, y0, of = box[order, 0], box[order, 1], of[order]
    x1, y1 = x0 + box[order, 2], y0 + box[order, 3]
    open_, step, held, count = np.arange(len(box)), 0, [], 0
    while len(open_):
        step += 1
        open_ = open_[open_ + step < len(box)]
        other = open_ + step
        reach = (of[open_] == of[other]) & (x0[other] - x1[open_] < join)  # later boxes begin no farther left
        open_, other = open_[reach], other[reach]
        near = (x0[other] - x1[other] < join) & (np.maximum(y0[open_], y0[other]) - np.minimum(y1[open_], y1[other]) < join)
        a, b = order[open_[near]], order[other[near]]
        new = first[a] != first[b]
        held.append((a[new], b[new]))
        count += len(held[-1][0])
        if count > EDGES or not len(open_):
            joined(*(np.concatenate(side) for side in zip(*held)))
            held, count = [], 0
    if held:
        joined(*(np.concatenate(side) for side in zip(*held)))
    return first


def cluster_islands(cut: DataFrame, page: list[str], ident: str, join: float) -> DataFrame:
    """The rows of ``islands`` with ``cluster``, the smallest ident of those that a chain of gaps under ``join`` connects."""
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        first = chained(_boxes(table), np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)])), join)
        return table.append_column("cluster", table[ident].take(pa.array(first)))

    return each_island(cut, page, [F.col(ident)], work, T.StructType([*cut.schema.fields, T.StructField("cluster", cut.schema[ident].dataType)]))


def cluster_pages(boxes: DataFrame, page: list[str], ident: str, join: float) -> DataFrame:
    """``boxes`` with ``cluster``, as ``cluster_islands`` names it, many whole pages at a time; boxes without a place are clusters of their own.

    Rows of one page and ident get the clusters of all of them that have a place, one row each.
    """
    kept, sides = boxes.columns, [f"__{c}" for c in "xywh"]
    asked = boxes.withColumns({"__placed": placed(), **{f"__{c}": F.col(c).cast("double") for c in "xywh"}})

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = len(table)
        at = np.flatnonzero(table["__placed"].to_numpy())
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        box = np.column_stack([table[c].to_numpy().astype(np.float64) for c in sides])[at]
        named = np.arange(n)
        named[at] = at[chained(box, of[at], join)]
        keys = _flat(table.select([*page, ident]))
        begin = _starts(keys, keys.column_names)
        alike = np.repeat(np.arange(len(begin)), np.diff([*begin, n]))
        have = np.bincount(alike[at], minlength=len(begin))
        times = np.maximum(have, 1)[alike]
        row = np.repeat(np.arange(n), times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        among = (np.cumsum(have) - have)[alike[row]] + nth
        known = have[alike[row]] > 0
        source = row.copy()
        source[known] = named[at[among[known]]]
        empty = pc.is_null(table[ident]).to_numpy()
        source = np.where(empty[source], row, source)
        out = table.select(kept)
        out = out if len(row) == n else out.take(pa.array(row))
        return out.append_column("cluster", table[ident].take(pa.array(source)))

    schema = T.StructType([*boxes.schema.fields, T.StructField("cluster", boxes.schema[ident].dataType)])
    return each_group(asked, page, [F.col(ident)], work, schema)


# -- absorption inside one island ------------------------------------------------------------

# How near a piece lies, and how much of it has to stand beside a target.
SIDE, UNDER, BESIDE, TALL = 0.03, 0.012, 0.8, 0.04


def touches(target: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Which pieces stand along a side of the target, or under or over it and no wider."""
    dx, dy = _apart(target, pieces, 0), _apart(target, pieces, 1)
    along = (-dy >= BESIDE * pieces[:, 3]) & (pieces[:, 3] >= TALL * target[3])
    return (dx <= SIDE) & (along | (dy <= UNDER) & (pieces[:, 2] <= target[2]))


def absorb(targets: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grown targets, owner of each piece or -1), one piece at a time.

    Each time the first piece that touches any target goes to the first target it touches.  A piece's first target is kept up to date: only
    the target that has just grown is compared again, and pieces that it no longer touches ask all targets.
    """
    targets, none = targets.copy(), len(targets)
    first, owner = np.full(len(pieces), none), np.full(len(pieces), -1)
    for j in reversed(range(none)):
        first[touches(targets[j], pieces)] = j
    while (waiting := np.flatnonzero(first < none)).size:
        i = waiting[0]
        j = owner[i] = first[i]
        low = np.minimum(targets[j, :2], pieces[i, :2])
        targets[j, 2:] = np.maximum(targets[j, :2] + targets[j, 2:], pieces[i, :2] + pieces[i, 2:]) - low
        targets[j, :2] = low
        first[i] = none
        free = np.flatnonzero(owner < 0)
        now = touches(targets[j], pieces[free])
        lost = free[~now & (first[free] == j)]
        first[free[now]] = np.minimum(first[free[now]], j)
        for k in lost:
            first[k] = next((t for t in range(none) if touches(targets[t], pieces[k:k + 1])[0]), none)
    return targets, owner


def absorb_islands(cut: DataFrame, page: list[str], target: str, piece: str) -> DataFrame:
    """The rows of ``islands``, targets grown, and pieces with ``owner``, the target that took them; a row is a target or a piece."""
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        box, owner = _boxes(table), np.full(len(table), -1)
        counts = np.add.reduceat(pc.is_valid(table[target]).to_numpy().astype(int), starts)
        for a, b, n in zip(starts, [*starts[1:], len(table)], counts):
            if 0 < n < b - a:
                box[a:a + n], taken = absorb(box[a:a + n], box[a + n:b])
                owner[a + n:b] = np.where(taken >= 0, a + taken, -1)
        for k, c in enumerate("xywh"):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(box[:, k]))
        return table.append_column("owner", table[target].take(pa.array(owner, mask=owner < 0)))

    schema = T.StructType([*cut.schema.fields, T.StructField("owner", cut.schema[target].dataType)])
    return each_island(cut, page, [F.col(target).asc_nulls_last(), F.col(piece)], work, schema)


# -- labels of whole pages -------------------------------------------------------------------

def attach_pages(candidates: DataFrame, page: list[str], worst: float, margin: float) -> DataFrame:
    """(page, place, label, score) of the owners that get a label, many whole pages at a time; an owner's candidates come from the nearest on."""
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        keys = _flat(table.select([*page, "place"]))
        begin = _starts(keys, keys.column_names)
        label = table["label"].combine_chunks()
        if pa.types.is_nested(label.type):
            label = pa.array([repr(v) for v in label.to_pylist()])
        label = label.dictionary_encode().indices.to_numpy()
        name = (np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)])) * (int(label.max(initial=0)) + 1) + label).tolist()
        score, unknown = table["score"].to_numpy().tolist(), pc.is_null(table["score"]).to_pylist()
        taken, won = set(), []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(table)]):
            free = (k for k in range(a, b) if name[k] not in taken)
            best = next(free, None)
            if best is None or unknown[best] or not score[best] <= worst:
                continue
            second = next((k for k in free if name[k] != name[best]), None)
            if second is None or not score[second] - score[best] < margin:
                taken.add(name[best])
                won.append(best)
        return table.take(pa.array(won, pa.int64()))

    return each_group(candidates, page, [F.col("place"), F.col("score"), F.col("label")], work, candidates.schema)
