"""Covered shares of boxes against counted cells."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioframe.operators import coverage as cv

SCHEMA = "page int, {}x0 double, y0 double, x1 double, y1 double"


def cells(boxes):
    return {(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1)}


def test_union_area():
    rng = random.Random(1)
    for n in (0, 1, 2, 30):
        boxes = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randint(0, 20), rng.randint(0, 20)) for _ in range(n))]
        assert cv.union_area(np.array(boxes, float).reshape(-1, 4)) == len(cells(boxes))


def test_uncovered_boxes(spark):
    rng = random.Random(2)
    def some(n, most):
        return [(x, y, x + rng.randint(1, most), y + rng.randint(1, most)) for x, y in ((rng.randint(-20, 40), rng.randint(-20, 40)) for _ in range(n))]
    pages = {p: (some(20, 12), some(15, 15), some(4, 30)) for p in range(8)}
    own = spark.createDataFrame([(p, i, *map(float, b)) for p, (a, _, _) in pages.items() for i, b in enumerate(a)] + [(0, 90, None, 1.0, 2.0, 2.0), (0, 91, 3.0, 1.0, 3.0, 2.0)], SCHEMA.format("id int, "))
    cover = spark.createDataFrame([(p, *map(float, b)) for p, (_, c, _) in pages.items() for b in c + c[:3]], SCHEMA.format(""))
    regions = spark.createDataFrame([(p, *map(float, b)) for p, (_, _, r) in pages.items() for b in r], SCHEMA.format(""))
    for eligible in (None, regions):
        want = {}
        for p, (a, c, r) in pages.items():
            for i, b in enumerate(a):
                mine = cells([b]) & (cells(r) if eligible is not None else cells([b]))
                if mine and len(mine & cells(c)) / len(mine) < 0.5:
                    want[p, i] = (float(len(mine)), round(len(mine & cells(c)) / len(mine), 9))
        for cell in (7.0, 64.0):
            got = cv.uncovered_boxes(own, cover, ["page"], "id", regions=eligible, threshold=0.5, cell=cell).withColumn("share", F.round("share", 9)).collect()
            assert {(r.page, r.id): (r.area, r.share) for r in got} == want and len(got) == len(want)


def test_covered_parts_of_any_sides(monkeypatch):
    rng = np.random.default_rng(3)
    def some(n):
        low = rng.random((n, 2)) * 8 - 1
        return cv._clip(np.column_stack([low, low + rng.random((n, 2)) * 3]), to)[0]
    to = np.array([0.0, 0.0, 8.0, 8.0])
    own, region, cover = some(20), some(5), some(30)
    def shared(box, *others):
        """Area of the places that the box and some box of each of the others take, on the grid of all sides."""
        xs, ys = (np.unique(np.concatenate([b[:, [k, k + 2]].ravel() for b in (box[None], *others)])) for k in (0, 1))
        held = cv._inside(box[None], xs, ys)
        for o in others:
            held &= cv._inside(o, xs, ys)
        return (held * np.diff(xs)[:, None] * np.diff(ys)).sum()
    for grid in (1 << 18, 40):
        monkeypatch.setattr(cv, "GRID", grid)
        area, both = cv.covered_parts(own, region, cover, to)
        assert np.allclose(area, [shared(b, region) for b in own]) and np.allclose(both, [shared(b, region, cover) for b in own])
        assert np.allclose(cv.covered_parts(own, None, cover, to)[1], [shared(b, cover) for b in own])


def test_crowded_page_lists_no_pairs(spark):
    """2,000 boxes over one spot and as many covers: the rows stay those of the boxes, and boxes of one ident count as their union."""
    own = spark.range(2000).selectExpr("1 AS page", "id % 1000 AS id", "0.0 AS x0", "0.0 AS y0", "4.0 AS x1", "2.0 AS y1")
    cover = spark.range(2000).selectExpr("1 AS page", "0.0 AS x0", "0.0 AS y0", "1.0 AS x1", "2.0 - id / 2000 AS y1")
    done = cv.uncovered_boxes(own, cover, ["page"], "id", threshold=0.5)
    assert "Join" not in done._jdf.queryExecution().executedPlan().toString()
    assert {(r.area, r.share) for r in done.collect()} == {(8.0, 0.25)} and done.count() == 1000
