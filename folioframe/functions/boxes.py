"""Box arithmetic on struct(x, y, w, h) columns with page-relative numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

MIN_SIDE = 0.002


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _clip(v: Column, lo=0.0, hi=1.0) -> Column:
    lo, hi = (e if isinstance(e, Column) else F.lit(e) for e in (lo, hi))
    return F.greatest(lo, F.least(hi, v))


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def grow(a: Column, gx: float, gy: float) -> Column:
    return box(a["x"] - gx, a["y"] - gy, a["w"] + 2 * gx, a["h"] + 2 * gy)


def clamp(a: Column) -> Column:
    x, y = _clip(a["x"]), _clip(a["y"])
    return box(x, y, _clip(a["w"], MIN_SIDE, 1 - x), _clip(a["h"], MIN_SIDE, 1 - y))


def inside(a: Column, r: Column) -> Column:
    """The centre of ``a`` lies in ``r``."""
    cx, cy = a["x"] + a["w"] / 2, a["y"] + a["h"] / 2
    return cx.between(r["x"], r["x"] + r["w"]) & cy.between(r["y"], r["y"] + r["h"])


def overlap_share(a: Column, b: Column) -> Column:
    """Overlap area relative to the second box."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h / (b["w"] * b["h"])).otherwise(0.0)


def center_dist(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] + a["w"] / 2 - (b["x"] + b["w"] / 2), a["y"] + a["h"] / 2 - (b["y"] + b["h"] / 2))


def box_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0),
                      F.greatest(a["x"], b["x"]) - F.least(a["x"] + a["w"], b["x"] + b["w"]),
                      F.greatest(a["y"], b["y"]) - F.least(a["y"] + a["h"], b["y"] + b["h"]))


def valid_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def normalize_box(x: Column, y: Column, w: Column, h: Column, sx: Column, sy: Column) -> Column:
    """Page-relative box, or null when it cannot be one.

    On a page of fractions (both scales 1) a number above 1.05 lost its decimal point: it is divided by
    ten where that fits; a box that still leaves the page, and one with no area, is dropped.
    """
    fraction = (sx == 1) & (sy == 1)
    def repaired(v):
        return F.when(fraction & (v > 1.05) & (v / 10 <= 1.05), v / 10).otherwise(v)
    def placed(r):
        outside = fraction & ((r["x"] + r["w"] > 1.1) | (r["y"] + r["h"] > 1.1))
        ok = valid_number(r["x"]) & valid_number(r["y"]) & valid_number(r["w"]) & valid_number(r["h"]) & ~outside
        return F.when(ok, box(_clip(r["x"] * sx), _clip(r["y"] * sy), r["w"] * sx, r["h"] * sy))
    def sized(b):
        return F.when((b["w"] > MIN_SIDE) & (b["h"] > MIN_SIDE),
                      box(b["x"], b["y"], _clip(b["w"], MIN_SIDE, 1 - b["x"]), _clip(b["h"], MIN_SIDE, 1 - b["y"])))
    return let(let(box(*[repaired(v.cast("double")) for v in (x, y, w, h)]), placed), sized)


def polygon_to_box(xs: Column, ys: Column) -> Column:
    """Bounding box of a polygon given as two arrays; null when a point is missing, not finite, or there is no area."""
    bad = F.exists(F.concat(xs, ys), lambda v: ~valid_number(v.cast("double")))
    x, y, x1, y1 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    return F.when(~bad & (x1 > x) & (y1 > y), box(x, y, x1 - x, y1 - y))
