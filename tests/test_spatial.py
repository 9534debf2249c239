"""Spatial operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import spatial as sp
from folioframe.operators import strokes


def gap(a, b):
    return max(0, max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]), max(a[1], b[1]) - min(a[1] + a[3], b[1] + b[3]))


def components(ids, close):
    parent = {i: i for i in ids}
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in ids:
        for j in ids:
            if i < j and close(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed,join,size", [(1, 0.06, 0.02), (2, 0.09, 0.0), (3, 0.04, 0.1), (4, 0.12, 0.01)])
def test_cluster_by_gap(spark, seed, join, size):
    rnd = random.Random(seed)
    rows = [(p, p * 1000 + i, rnd.random() * 1.3, rnd.random(), rnd.random() * size, rnd.random() * size) for p in range(3) for i in range(70)]
    df = spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double")
    got = {r.id: r.cluster for r in sp.cluster_by_gap(df, ["page"], "id", join).collect()}
    want = {}
    for p in range(3):
        box = {r[1]: r[2:] for r in rows if r[0] == p}
        want |= components(list(box), lambda i, j: gap(box[i], box[j]) < join)
    assert got == want
    assert 1 < len(set(want.values())) < len(want)


def test_cluster_in_one_hot_cell(spark):
    df = spark.range(3000).select(F.lit(1).alias("page"), "id", (F.rand(1) * 0.01).alias("x"), (F.rand(2) * 0.01).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    assert sp.cluster_by_gap(df, ["page"], "id", 0.05).agg(F.countDistinct("cluster"), F.count("*")).first() == (1, 3000)


def test_connected_components_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.node: r.root for r in sp.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attach_nearest(spark, seed):
    rnd = random.Random(seed)
    owners = [(p, p * 100 + i, round(rnd.random(), 2), round(rnd.random(), 2), 0.2, 0.15) for p in range(4) for i in range(12)]
    labels = [(p, p * 100 + i, round(rnd.random(), 2), round(rnd.random(), 2), 0.06, 0.02) for p in range(4) for i in range(25)]
    o = spark.createDataFrame(owners, "page int, place int, x double, y double, w double, h double")
    l = spark.createDataFrame(labels, "page int, label int, x double, y double, w double, h double")
    got = {(r.page, r.place): r.label for r in sp.attach_nearest(sp.caption_candidates(o, l, ["page"]), ["page"]).collect()}
    want, used = {}, set()
    for p, place, x, y, w, h in owners:
        cx, bottom, found = x + w / 2, y + h, []
        for q, label, lx, ly, lw, lh in labels:
            if q != p or label in used:
                continue
            mx, my, dy, reach = lx + lw / 2, ly + lh / 2, ly - bottom, max(0.022, w * 0.34)
            over = y + h * 0.72 < my < bottom
            if (dy < -0.006 and not over) or dy > 0.055 or abs(mx - cx) > reach:
                continue
            found.append((abs(mx - cx) / reach + (0 if over else abs(dy) / 0.055), label))
        found.sort()
        if found and found[0][0] <= 1.25 and (len(found) < 2 or found[1][0] - found[0][0] >= 0.2):
            want[(p, place)] = found[0][1]
            used.add(found[0][1])
    assert got == want and want


def test_shuffled_labels_stay_unpaired(spark):
    o = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.3, 0.2)], "page int, place int, x double, y double, w double, h double")
    l = spark.createDataFrame([(1, 1, 0.2, 0.31, 0.04, 0.02), (1, 2, 0.26, 0.31, 0.04, 0.02)], "page int, label int, x double, y double, w double, h double")
    assert sp.attach_nearest(sp.caption_candidates(o, l, ["page"]), ["page"]).count() == 0


def test_absorb_adjacent(spark):
    t = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.3, 0.2)], "page int, id int, x double, y double, w double, h double")
    # beside, then beside the grown target, just below, and one far away
    p = spark.createDataFrame([(1, 1, 0.52, 0.22, 0.03, 0.15), (1, 2, 0.57, 0.25, 0.03, 0.1), (1, 3, 0.25, 0.405, 0.1, 0.05), (1, 4, 0.9, 0.9, 0.05, 0.05)],
                              "page int, piece int, x double, y double, w double, h double")
    grown, left = sp.absorb_adjacent(t, p, ["page"], "id", "piece")
    assert [r.piece for r in left.collect()] == [4]
    assert [round(v, 4) for v in grown.select("x", "y", "w", "h").first()] == [0.2, 0.2, 0.4, 0.255]


def absorbed(targets, pieces):
    """One page, one piece at a time: boxes by id."""
    t, left = {i: list(b) for i, b in sorted(targets)}, dict(sorted(pieces))
    def owner(d):
        for i, b in t.items():
            dx = max(b[0] - (d[0] + d[2]), d[0] - (b[0] + b[2]), 0)
            dy = max(b[1] - (d[1] + d[3]), d[1] - (b[1] + b[3]), 0)
            shared = min(b[1] + b[3], d[1] + d[3]) - max(b[1], d[1])
            if dx <= 0.03 and (shared >= d[3] * 0.8 and d[3] >= b[3] * 0.04 or dy <= 0.012 and d[2] <= b[2]):
                return i
    while (hit := next(((k, o) for k, d in left.items() if (o := owner(d)) is not None), None)):
        d, b = left.pop(hit[0]), t[hit[1]]
        x, y = min(b[0], d[0]), min(b[1], d[1])
        t[hit[1]] = [x, y, max(b[0] + b[2], d[0] + d[2]) - x, max(b[1] + b[3], d[1] + d[3]) - y]
    return t, left


def test_absorb_adjacent_one_at_a_time(spark):
    """Targets that compete, pieces that a target reaches only after growing, places on a coarse grid for ties."""
    rnd = random.Random(4)
    pages = {p: ([(i, (round(rnd.random(), 2), round(rnd.random(), 2), rnd.choice([0.1, 0.2]), rnd.choice([0.1, 0.9]))) for i in range(rnd.randint(0, 4))],
                 [(i, (round(rnd.random(), 2), round(rnd.random(), 2), 0.05, rnd.choice([0.02, 0.06]))) for i in range(rnd.randint(0, 25))]) for p in range(300)}
    pages[1000] = ([(1, (0.1, 0.1, 0.2, 0.2)), (2, (0.45, 0.1, 0.2, 0.2))], [(1, (0.31, 0.12, 0.07, 0.1)), (2, (0.40, 0.12, 0.03, 0.1))])
    schema = "page int, {} int, x double, y double, w double, h double"
    t = spark.createDataFrame([(p, i, *b) for p, (ts, _) in pages.items() for i, b in ts], schema.format("id"))
    d = spark.createDataFrame([(p, i, *b) for p, (_, ps) in pages.items() for i, b in ps] + [(7, 99, None, 0.1, 0.1, 0.1), (8, 99, float("nan"), 0.1, 0.1, 0.1)], schema.format("piece"))
    grown, left = sp.absorb_adjacent(t, d, ["page"], "id", "piece")
    got_t = {(r.page, r.id): [r.x, r.y, r.w, r.h] for r in grown.collect()}
    got_left = {(r.page, r.piece) for r in left.collect()}
    want = {p: absorbed(*both) for p, both in pages.items()}
    assert got_left == {(p, i) for p, (_, rest) in want.items() for i in rest} | {(7, 99), (8, 99)}
    assert got_t == {(p, i): b for p, (ts, _) in want.items() for i, b in ts.items()}
    assert got_t[1000, 1][2] > 0.3 and sum(len(ps) for _, ps in pages.values()) > len(got_left) + 500


def test_cluster_ways_agree(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(p, p * 1000 + i, rnd.random() * 4, rnd.random(), rnd.random() * 0.05, rnd.random() * 0.05) for p in range(3) for i in range(90)]
    rows += [(1, 5000, None, 0.1, 0.1, 0.1), (1, 5001, 0.1, float("inf"), 0.1, 0.1)]
    df = spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double")
    ways = []
    for most in (4096, 20, 0):
        monkeypatch.setattr(sp, "ISLAND_ROWS", most)
        ways.append(sorted((r.id, r.cluster) for r in sp.cluster_by_gap(df, ["page"], "id", 0.08).collect()))
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len(rows) and (5000, 5000) in ways[0]


def test_covering_intervals(spark):
    jobs = spark.createDataFrame([("a", 1, 9, False, 1), ("a", 4, 6, True, 2), ("a", 5, 20, False, 3), ("b", 1, 99, True, 4)], "engine string, lo int, hi int, active boolean, id int")
    points = spark.createDataFrame([("a", n) for n in range(0, 24)], "engine string, page int")
    got = {r.page: r.cover.id if r.cover else None for r in sp.covering_intervals(points, jobs, ["engine"], "page", "lo", "hi", [F.col("active"), F.col("id")], ["id"]).collect()}
    assert got == {n: 2 if 4 <= n <= 6 else 3 if 5 <= n <= 20 else 1 if 1 <= n <= 9 else None for n in range(0, 24)}


def test_trace_score(spark):
    line = [(float(i), 0.0) for i in range(0, 101, 10)]
    traces = [("a", 1, line), ("a", 2, [(x, y + 30) for x, y in line]), ("a", 3, line[::-1]), ("a", 4, [(0.0, 0.0), (100.0, 5.0)])]
    schema = "stroke string, n int, points array<struct<x:double,y:double>>"
    t, r = spark.createDataFrame(traces, schema), spark.createDataFrame([("a", line)], "stroke string, points array<struct<x:double,y:double>>")
    got = {x.n: (round(x.distance, 2), x.passed) for x in strokes.trace_score(t, r, ["stroke"], ["n"], 100.0).collect()}
    assert got == {1: (0.0, True), 2: (30.0, False), 3: (100.0, False), 4: (5.0, True)}


def test_clusters_of_whole_pages(spark, monkeypatch):
    """Pages of few boxes need no islands; rows without a place, without a name and given twice come out as by the islands of long pages."""
    rnd = random.Random(6)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, i, i]), rnd.choice([None, rnd.random(), rnd.random(), float("nan")]), rnd.random(), rnd.random() * 0.1, 0.02) for i in range(120)]
    df = spark.createDataFrame(rows + rows[::5], "page int, id int, x double, y double, w double, h double")
    take = lambda: sorted(map(repr, sp.cluster_by_gap(df, ["page"], "id", 0.08).collect()))
    monkeypatch.setattr(sp, "ISLAND_ROWS", 20)
    want = take()
    monkeypatch.undo()
    monkeypatch.setattr(sp, "islands", None)
    assert take() == want


def test_attach_ways_agree(spark, monkeypatch):
    """Whole pages come out as by cells and rounds, which short pages no longer need; candidates without a name or a score end no search."""
    rnd = random.Random(9)
    box = lambda: (round(rnd.random(), 2), round(rnd.random(), 2))
    o = spark.createDataFrame([(p, i, *box(), 0.3, 0.2) for p in range(5) for i in range(14)], "page int, place int, x double, y double, w double, h double")
    l = spark.createDataFrame([(p, f"l{i}", *box(), 0.06, 0.02) for p in range(5) for i in range(20)] + [(1, "l1", 0.3, 0.3, 0.06, 0.02)], "page int, label string, x double, y double, w double, h double")
    def take():
        near = sp.caption_candidates(o, l, ["page"])
        return sorted(map(repr, near.collect())), sorted(map(repr, sp.attach_nearest(near, ["page"], margin=0.05).collect()))
    monkeypatch.setattr(sp, "FEW_LABELS", 0)
    monkeypatch.setattr(sp, "LONG_PAGE", 0)
    want = take()
    monkeypatch.undo()
    monkeypatch.setattr(sp, "_candidates_by_cell", None)
    monkeypatch.setattr(sp, "_attach_rounds", None)
    monkeypatch.setattr(sp, "FEW_LABELS", 100)
    assert take() == want and len(want[1]) > 5
    odd = spark.createDataFrame([(1, 1, None, 0.1), (1, None, "a", 0.1), (None, 1, "a", 0.1), (1, 2, "b", None), (1, 3, "c", 0.2), (1, 3, "c", 0.25)], "page int, place int, label string, score double")
    assert [tuple(r) for r in sp.attach_nearest(odd, ["page"]).collect()] == [(1, 3, "c", 0.2)]


def test_regions_around_a_centre_are_not_held(spark):
    r = random.Random(8)
    some = lambda: round(r.uniform(0, 3), 1)
    regions = [(r.choice([1, 2, None]), r.choice([None, *range(5)]), n, x, y, x + some(), y + some()) for n in range(150) for x, y in [(some(), some())]]
    tokens = [(r.choice([1, 2, 3, None]), n, some(), some()) for n in range(120)]
    a = spark.createDataFrame(regions, "page int, o int, id int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame(tokens, "page int, t int, cx double, cy double")
    done = sp.assign_to_region(t, a, ["page"], F.col("cx"), F.col("cy"), ("x0", "y0", "x1", "y1"), "o", ["id"], 0.7)
    want = {}
    for page, n, x, y in tokens:
        fits = [(o is not None, o or 0, i) for p, o, i, x0, y0, x1, y1 in regions if p == page and p is not None and x0 <= x <= x1 and y0 <= y <= y1]
        want[n] = min(fits)[2] if fits else None
    assert {x.t: x.region and x.region.id for x in done.collect()} == want
    # The rows of the cells are many more than the regions, so they are never broadcast by the size of these.
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [page#") >= 2
