"""How much of a box the union of other boxes covers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .islands import _starts, each_group

SIDES = ("x0", "y0", "x1", "y1")


def union_area(box: np.ndarray) -> float:
    """Area of the union of boxes (rows x0, y0, x1, y1): a sweep from left to right over the covered length in y."""
    if not len(box):
        return 0.0
    ys = np.unique(box[:, [1, 3]])
    low, high = np.searchsorted(ys, box[:, 1]), np.searchsorted(ys, box[:, 3])
    height, deep = np.diff(ys), np.zeros(len(ys) - 1, np.int64)
    at = np.concatenate([box[:, 0], box[:, 2]])
    total, last, covered = 0.0, at.min(), 0.0
    for e in np.argsort(at, kind="stable"):
        total += covered * (at[e] - last)
        last, k = at[e], e % len(box)
        deep[low[k]:high[k]] += 1 if e < len(box) else -1
        covered = height[deep > 0].sum()
    return float(total)


GRID = 1 << 18  # places of the grid that the sides of a cell's boxes make; a cell of more is halved
OWN, REGION, COVER = 0, 1, 2


def _pieces(boxes: DataFrame, page: list[str], ident: Column, cell: float, what: int) -> DataFrame:
    """The part of each box in every cell of a grid that it reaches into, whole numbers of cells left out."""
    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.ceil(F.col(high) / cell) - 1))

    def side(c: str) -> Column:
        edge = F.col("__gx" if c[0] == "x" else "__gy")
        return F.greatest(F.col(c), edge * cell).alias(c) if c[1] == "0" else F.least(F.col(c), (edge + 1) * cell).alias(c)

    spread = boxes.withColumn("__gx", cells("x0", "x1")).withColumn("__gy", cells("y0", "y1"))
    parts = spread.select(*page, "__gx", "__gy", F.lit(what).alias("__what"), ident.alias("__id"), *[side(c) for c in SIDES])
    return parts.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def _clip(box: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lies inside ``to`` of those boxes that reach into it, and which ones those are."""
    inside = np.flatnonzero((box[:, 0] < to[2]) & (box[:, 2] > to[0]) & (box[:, 1] < to[3]) & (box[:, 3] > to[1]))
    return np.column_stack([np.maximum(box[inside, :2], to[:2]), np.minimum(box[inside, 2:], to[2:])]), inside


def _inside(box: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which places of the grid with sides xs and ys the boxes cover; their sides are among those."""
    deep = np.zeros((len(xs), len(ys)), np.int64)
    x0, y0, x1, y1 = (np.searchsorted(at, box[:, k]) for k, at in enumerate((xs, ys, xs, ys)))
    for x, y, n in ((x0, y0, 1), (x1, y1, 1), (x0, y1, -1), (x1, y0, -1)):
        np.add.at(deep, (x, y), n)
    return deep.cumsum(0).cumsum(1)[:-1, :-1] > 0


def _area_in(box: np.ndarray, held: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Area of the held places of a grid inside each box, by sums over the grid; exactly 0 where there is none."""
    place = np.pad(held.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    area = np.pad((held * np.diff(xs)[:, None] * np.diff(ys)).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    low = [np.clip(np.searchsorted(at, box[:, k], "right") - 1, 0, len(at) - 2) for k, at in enumerate((xs, ys))]
    high = [np.clip(np.searchsorted(at, box[:, k + 2], "left"), 1, len(at) - 1) for k, at in enumerate((xs, ys))]

    # Held length of each column of places up to a side in y, and of each row up to a side in x.
    down, along = np.pad((held * np.diff(ys)).cumsum(1), ((0, 0), (1, 0))), np.pad((held * np.diff(xs)[:, None]).cumsum(0), ((1, 0), (0, 0)))

    def upto(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Held area left of x and above y."""
        i, j = (np.clip(np.searchsorted(at, c, "right") - 1, 0, len(at) - 2) for at, c in ((xs, x), (ys, y)))
        u, v = x - xs[i], y - ys[j]
        return area[i, j] + u * down[i, j] + v * along[i, j] + u * v * held[i, j]

    some = place[high[0], high[1]] - place[low[0], high[1]] - place[high[0], low[1]] + place[low[0], low[1]] > 0
    x0, y0, x1, y1 = box.T
    return np.where(some, np.maximum(upto(x1, y1) - upto(x0, y1) - upto(x1, y0) + upto(x0, y0), 0), 0.0)


def covered_parts(own: np.ndarray, region: np.ndarray | None, cover: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area in the regions, area both in the regions and covered) of each own box, all within the box ``to``; no regions: everything counts.

    The sides of regions and cover make a grid, whose places are held or not.  A box over all of ``to`` stands for all others; where the grid is
    too fine, ``to`` is halved at the middle one of its sides.
    """
    def whole(box: np.ndarray) -> np.ndarray:
        full = (box[:, 0] <= to[0]) & (box[:, 1] <= to[1]) & (box[:, 2] >= to[2]) & (box[:, 3] >= to[3])
        return box[full.argmax()][None] if full.any() else box

    cover = whole(cover)
    boxes = cover if region is None else np.concatenate([cover, region := whole(region)])
    xs, ys = np.unique([*boxes[:, 0], *boxes[:, 2], to[0], to[2]]), np.unique([*boxes[:, 1], *boxes[:, 3], to[1], to[3]])
    if len(xs) * len(ys) <= GRID or len(xs) + len(ys) <= 5:
        taken = _inside(cover, xs, ys)
        if region is None:
            return (own[:, 2] - own[:, 0]) * (own[:, 3] - own[:, 1]), _area_in(own, taken, xs, ys)
        there = _inside(region, xs, ys)
        return _area_in(own, there, xs, ys), _area_in(own, there & taken, xs, ys)
    area, both = np.zeros(len(own)), np.zeros(len(own))
    axis, at = (0, xs) if len(xs) >= len(ys) else (1, ys)
    for k in (0, 2):
        half = to.copy()
        half[2 - k + axis] = at[len(at) // 2]
        mine, which = _clip(own, half)
        if len(mine):
            a, b = covered_parts(mine, None if region is None else _clip(region, half)[0], _clip(cover, half)[0], half)
            area[which] += a
            both[which] += b
    return area, both


def disjoint(box: np.ndarray) -> np.ndarray:
    """Boxes that do not overlap and take what the given ones take."""
    xs, ys = np.unique(box[:, [0, 2]]), np.unique(box[:, [1, 3]])
    i, j = np.nonzero(_inside(box, xs, ys))
    return np.column_stack([xs[i], ys[j], xs[i + 1], ys[j + 1]])


def uncovered_boxes(boxes: DataFrame, cover: DataFrame, page: list[str], ident: str, *, regions: DataFrame | None = None, threshold: float = 0.2, cell: float = 64.0) -> DataFrame:
    """(page, ident, area, share) of the boxes of which the union of ``cover`` takes less than ``threshold``.

    All tables have page and x0, y0, x1, y1 (the ends are not included).  With ``regions`` only what lies in their union counts, and boxes outside
    of them are left out; so are empty boxes and those with a null or non-finite side.  Boxes of one ``ident`` in a page count as their union.
    ``cell`` changes the cost only: about the size of a common box is best.

    All boxes are cut at the cells of a grid, equal parts of regions and cover count once, and each cell is measured by itself: no pairs are listed.
    """
    def sound(df: DataFrame) -> DataFrame:
        df = df.withColumns({c: F.col(c).cast("double") for c in SIDES})
        finite = (F.abs(F.col("x0")) < float("inf")) & (F.abs(F.col("y0")) < float("inf")) & (F.abs(F.col("x1")) < float("inf")) & (F.abs(F.col("y1")) < float("inf"))
        return df.filter(finite & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))

    none = F.lit(None).cast(boxes.schema[ident].dataType)
    parts = _pieces(sound(cover), page, none, cell, COVER).distinct()
    if regions is not None:
        parts = parts.unionByName(_pieces(sound(regions), page, none, cell, REGION).distinct())
    own = _pieces(sound(boxes), page, F.col(ident), cell, OWN)

    bounded = regions is not None

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        box, what = np.column_stack([table[c].to_numpy() for c in SIDES]), table["__what"].to_numpy()
        grid = np.column_stack([table["__gx"].to_numpy(), table["__gy"].to_numpy()]) * cell
        area, both = np.zeros(len(box)), np.zeros(len(box))
        first = _starts(table.select(["__id"]), ["__id"])
        for a, b in zip(starts, [*starts[1:], len(table)]):
            kind = what[a:b]
            region, over = box[a:b][kind == REGION] if bounded else None, box[a:b][kind == COVER]
            if kind[0] != OWN or bounded and not len(region):
                continue
            # Own boxes come first and by ident.
            own = a + np.arange(np.count_nonzero(kind == OWN))
            at = np.union1d(first[np.searchsorted(first, a):np.searchsorted(first, own[-1], "right")], [a])
            size = np.diff(np.append(at, own[-1] + 1))
            mine, of = box[at], at
            if len(at) < len(own):
                shared = [(k, disjoint(box[k:k + n])) for k, n in zip(at[size > 1], size[size > 1])]
                mine = np.concatenate([box[at[size == 1]], *[d for _, d in shared]])
                of = np.concatenate([at[size == 1], *[np.full(len(d), k) for k, d in shared]])
            here, taken = covered_parts(mine, region, over, np.append(grid[a], grid[a] + cell))
            np.add.at(area, of, here)
            np.add.at(both, of, taken)
        kept = pa.array(np.flatnonzero(area > 0))
        return pa.table({**{c: table[c].take(kept) for c in page}, ident: table["__id"].take(kept), "area": pa.array(area).take(kept), "__taken": pa.array(both).take(kept)})

    schema = T.StructType([*[boxes.schema[c] for c in page], T.StructField(ident, boxes.schema[ident].dataType), T.StructField("area", T.DoubleType()), T.StructField("__taken", T.DoubleType())])
    measured = each_group(parts.unionByName(own), [*page, "__gx", "__gy"], [F.col("__what"), F.col("__id")], work, schema)
    done = measured.groupBy(*page, ident).agg(F.sum("area").alias("area"), F.sum("__taken").alias("__taken"))
    done = done.filter("area > 0").withColumn("share", F.col("__taken") / F.col("area"))
    return done.filter(F.col("share") < threshold).drop("__taken")
