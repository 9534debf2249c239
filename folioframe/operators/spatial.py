"""Spatial operators: region lookup, covering intervals, overlap, clusters.

None of them lists all pairs of a page.  Intervals are cut into at most two nodes per level of a binary
tree and the best interval per node is kept, so a point meets one row per level.  Clusters and absorption work on
islands of boxes that cannot meet others; in a crowded island, boxes that share a small cell belong together, so only cells are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .islands import BAND, ISLAND, SIDE, UNDER, absorb_islands, attach_pages, cluster_islands, cluster_pages, islands, placed
from .lineage import cut_lineage
from .ordered import Ordered, null_safe
from .sequences import as_of, last_before, with_places

_NODES = "array<struct<l:int,i:bigint>>"


def interval_nodes(lo: Column, hi: Column, bits: int) -> Column:
    """Tree nodes (level, index) that exactly cover the integers lo..hi, for 0 <= lo, hi < 2^bits."""
    def node(level, i):
        return F.array(F.struct(level.cast("int").alias("l"), i.alias("i")))
    none = F.array().cast(_NODES)
    def step(acc, level):
        l, r = acc["l"], acc["r"]
        left = (l < r) & (l % 2 == 1)
        l2 = F.when(left, l + 1).otherwise(l)
        right = (l2 < r) & (r % 2 == 1)
        r2 = F.when(right, r - 1).otherwise(r)
        out = F.concat(acc["o"], F.when(left, node(level, l)).otherwise(none), F.when(right, node(level, r2)).otherwise(none))
        open_ = l2 < r2
        return F.struct(F.when(open_, F.shiftright(l2, 1)).otherwise(F.lit(0).cast("long")).alias("l"),
                        F.when(open_, F.shiftright(r2, 1)).otherwise(F.lit(0).cast("long")).alias("r"), out.alias("o"))
    start = F.struct(lo.cast("long").alias("l"), (hi.cast("long") + 1).alias("r"), none.alias("o"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda acc: acc["o"])


def _at_levels(p: Column, levels: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(n).cast("int").alias("l"), F.shiftright(p.cast("long"), n).alias("i")) for n in levels])


def covering_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str, priority: list[Column], value: list[str], out: str = "cover") -> DataFrame:
    """The covering interval with the highest priority for each point (integers, both ends included), or null."""
    low, high = intervals.agg(F.min(lo), F.max(hi)).first()
    if low is None:
        low, high = 0, 0
    bits = max(1, int(high - low).bit_length())
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)])
    nodes = (intervals.filter(F.col(lo) <= F.col(hi))
             .select(*keys, F.explode(interval_nodes(F.col(lo) - low, F.col(hi) - low, bits)).alias("__n"), rank.alias("__rank"), F.struct(*value).alias("__v"))
             .groupBy(*keys, "__n").agg(F.max(F.struct("__rank", "__v")).alias("__best")))
    levels = sorted(r[0] for r in nodes.select("__n.l").distinct().collect()) or [0]
    spots = points.select(*keys, at).distinct().filter(F.col(at).between(low, high))
    hits = (spots.withColumn("__n", F.explode(_at_levels(F.col(at) - low, levels))).join(nodes, [*keys, "__n"])
            .groupBy(*keys, at).agg(F.max("__best").alias("__best")))
    return points.join(hits, [*keys, at], "left").withColumn(out, F.col("__best.__v")).drop("__best")


def assign_to_region(tokens: DataFrame, regions: DataFrame, page: list[str], cx: Column, cy: Column, box: tuple[str, str, str, str], order: str,
                     value: list[str], cell: float, out: str = "region") -> DataFrame:
    """First region in order whose box (x0, y0, x1, y1; edges included) holds the token's centre; null for leftovers.

    Regions and centres meet in the cells of a grid and are then compared exactly, so edges may lie anywhere.  ``cell`` changes
    the cost only: about the size of a common region is best.  Equal centres of a page are looked up once.  ``order`` should be a number or a date.
    """
    def cells(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    x0, y0, x1, y1 = box
    r = (regions.select(*page, F.col(x0).alias("__x0"), F.col(y0).alias("__y0"), F.col(x1).alias("__x1"), F.col(y1).alias("__y1"), F.col(order).alias("__o"), F.struct(*value).alias("__v"))
         .filter((F.col("__x0") <= F.col("__x1")) & (F.col("__y0") <= F.col("__y1")))
         .withColumn("__gx", cells("__x0", "__x1")).withColumn("__gy", cells("__y0", "__y1")))
    placed = tokens.withColumns({"__px": cx.cast("double"), "__py": cy.cast("double")})
    spots = placed.select(*page, "__px", "__py").distinct().withColumns({"__gx": F.floor(F.col("__px") / cell), "__gy": F.floor(F.col("__py") / cell)})
    inside = F.col("__px").between(F.col("__x0"), F.col("__x1")) & F.col("__py").between(F.col("__y0"), F.col("__y1"))
    spot, met = [*page, "__gx", "__gy", "__px", "__py"], [*page, "__gx", "__gy"]
    # A file of regions is small beside the rows of their cells, so these are shuffled whatever its size.  The first place in order is found
    # alone, as a number that needs no sorting of the pairs; only regions of that place are compared by value.  Null comes first.
    least = spots.join(r.hint("merge"), met).filter(inside).groupBy(*spot).agg(F.max(F.col("__o").isNull()).alias("__null"), F.min("__o").alias("__least"))
    least = least.withColumn("__least", F.when(~F.col("__null"), F.col("__least")))
    hits = least.join(r.hint("merge"), met).filter(inside & F.col("__o").eqNullSafe(F.col("__least"))).groupBy(*page, "__px", "__py").agg(F.min("__v").alias("__first"))
    return placed.join(hits, [*page, "__px", "__py"], "left").withColumn(out, F.col("__first")).drop("__px", "__py", "__first")


def uncovered(components: DataFrame, cover: DataFrame, keys: list[str], comp: tuple[str, str], span: tuple[str, str], threshold: float = 0.2) -> DataFrame:
    """Components whose share covered by the union of the spans is under the threshold."""
    a, b = span
    o = Ordered(cover.select(*keys, a, b), keys, [a, b]).add(__reach=("prior_max", b))
    o.with_columns(__new=(F.col("__reach").isNull() | (F.col(a) > F.col("__reach"))).cast("long")).add(__island=("sum", "__new"))
    merged = o.done().groupBy(*keys, "__island").agg(F.min(a).alias("__a"), F.max(b).alias("__b"))
    merged = cut_lineage(merged.withColumn("__len", F.col("__b") - F.col("__a")))
    run = cut_lineage(Ordered(merged, keys, ["__a"]).add(__upto=("sum", "__len")).done())
    seg = F.struct("__a", "__b", "__upto")
    lo, hi = comp
    ends = components.select(*keys, F.explode(F.array(lo, hi)).alias("__at"))
    found = cut_lineage(last_before(ends, run, keys, F.col("__a"), seg))
    both = with_places(with_places(components, found, keys, F.col(lo), "__s0"), found, keys, F.col(hi), "__s1")
    def covered(s, t):
        s = F.col(s)
        return F.when(s.isNull(), 0.0).otherwise(s["__upto"] - (s["__b"] - s["__a"]) + F.least(t, s["__b"]) - s["__a"])
    share = (covered("__s1", F.col(hi)) - covered("__s0", F.col(lo))) / (F.col(hi) - F.col(lo))
    return both.withColumn("share", share).filter(F.col("share") < threshold).drop("__s0", "__s1")


def suppress_overlaps(primary: DataFrame, secondary: DataFrame, page: list[str], x: str, y: str, tolerance: int = 2) -> DataFrame:
    """Secondary boxes without a primary corner closer than the tolerance in both directions.

    Corners are whole pixels, so a cell of the grid holds at most tolerance^2 distinct ones.
    """
    tx, ty = F.floor(F.col(x) / tolerance), F.floor(F.col(y) / tolerance)
    corners = primary.select(*page, F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    cell = corners.withColumns({"__cx": F.floor(F.col("__x") / tolerance), "__cy": F.floor(F.col("__y") / tolerance)})
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = (cell.withColumn("__s", F.explode(shifts))
            .select(*page, "__x", "__y", (F.col("__cx") + F.col("__s.i")).alias("__cx"), (F.col("__cy") + F.col("__s.j")).alias("__cy")))
    s = secondary.withColumns({"__cx": tx, "__cy": ty}).alias("s")
    cond = (null_safe("s", "p", page + ["__cx", "__cy"]) & (F.abs(F.col(f"s.{x}") - F.col("p.__x")) < tolerance)
            & (F.abs(F.col(f"s.{y}") - F.col("p.__y")) < tolerance))
    return s.join(near.alias("p"), cond, "left_anti").drop("__cx", "__cy")


def drop_same_spot(df: DataFrame, page: list[str], text: str, x: str, y: str, order: list[str]) -> DataFrame:
    """First row per text and rounded corner."""
    keyed = df.withColumns({"__rx": F.floor(F.col(x) + 0.5), "__ry": F.floor(F.col(y) + 0.5)})
    rest = [c for c in df.columns if c not in (*page, text)]
    return (keyed.groupBy(*page, text, "__rx", "__ry").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
            .select(*page, text, "__r.*").select(*df.columns))


def reconcile_cells(cells: DataFrame, readings: DataFrame, keys: list[str], x: str, value: str, read: str, confidence: str, *, alphabet: str, tolerance: float, min_confidence: float = 0.8) -> DataFrame:
    """Take over the reading nearest to each cell when it is near, legal and confident; keep both values.

    ``keys`` name the row of the grid; the nearest reading is the one just before or just after the cell.
    """
    r = F.struct(F.col(x).alias("x"), F.col(read).alias("t"), F.col(confidence).alias("c"))
    before = cut_lineage(as_of(cells, readings, keys, F.col(x), F.col(x), r, "__b"))
    both = as_of(before, readings, keys, -F.col(x), -F.col(x), r, "__a", strict=True)
    db, da = F.col(x) - F.col("__b.x"), F.col("__a.x") - F.col(x)
    near = F.when(F.col("__b").isNotNull() & (F.col("__a").isNull() | (db <= da)), F.col("__b")).otherwise(F.col("__a"))
    j = both.withColumn("__n", near)
    ok = (F.abs(F.col("__n.x") - F.col(x)) < tolerance) & F.col("__n.t").rlike(alphabet) & (F.coalesce(F.col("__n.c"), F.lit(1.0)) >= min_confidence)
    after = F.when(F.coalesce(ok, F.lit(False)), F.col("__n.t")).otherwise(F.col(value))
    return j.withColumns({"after": after, "corrected": ~after.eqNullSafe(F.col(value))}).withColumnRenamed(value, "before").drop("__a", "__b", "__n")


# -- captions --------------------------------------------------------------------------

# How far a label's top may be above and below the owner's edge, where the owner's lowest part begins, how far aside a label may be.
ABOVE, BELOW, FOOT, ASIDE, ASIDE_SHARE = 0.006, 0.055, 0.72, 0.022, 0.34
FEW_LABELS = 16  # labels of a page that meet all its owners; about the cells that an owner's zones take
LONG_PAGE = 100_000  # candidates of a page that one task goes through; longer pages are settled in rounds


def caption_candidates(owners: DataFrame, labels: DataFrame, page: list[str]) -> DataFrame:
    """Label and owner pairs that are near enough, with a score (lower is nearer).

    Owners have page, place, x, y, w, h; labels have page, label, x, y, w, h.  An owner has two zones around its lower edge: labels whose
    middle lies in its lowest part cost nothing beyond their distance from the owner's middle line, others count by how far their top is
    from the edge.  On pages of over ``FEW_LABELS`` labels zones and labels meet by cells of the page.
    """
    crowded = cut_lineage(labels.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > FEW_LABELS))
    if crowded.isEmpty():
        return _candidates(owners, labels, page)
    part = lambda df, how: df.alias("l").join(crowded.alias("r"), null_safe("l", "r", page), how)
    few, many = ([part(df, how) for df in (owners, labels)] for how in ("left_anti", "left_semi"))
    return _candidates(*few, page).unionByName(_candidates_by_cell(*many, page))


def _candidates(owners: DataFrame, labels: DataFrame, page: list[str]) -> DataFrame:
    """``caption_candidates`` of pages with few labels: all of a page meet."""
    x, y, w, h = (F.col(c) for c in "xywh")
    edge, middle = y + h, x + w / 2
    o = owners.select(*page, "place", middle.alias("__middle"), edge.alias("__edge"), F.greatest(F.lit(ASIDE), w * ASIDE_SHARE).alias("__reach"), (y + h * FOOT).alias("__foot"))
    l = labels.select(*page, "label", middle.alias("__lx"), y.alias("__top"), (y + h / 2).alias("__ly"))
    aside = F.abs(F.col("__lx") - F.col("__middle"))
    in_foot = (F.col("__ly") > F.col("__foot")) & (F.col("__ly") < F.col("__edge"))
    near = (aside <= F.col("__reach")) & (in_foot | F.col("__top").between(F.col("__edge") - ABOVE, F.col("__edge") + BELOW))
    off = F.when(in_foot, 0.0).otherwise(F.abs(F.col("__top") - F.col("__edge")) / BELOW)
    return o.join(l, page).filter(near).select(*page, "place", "label", (aside / F.col("__reach") + off).alias("score"))


def _candidates_by_cell(owners: DataFrame, labels: DataFrame, page: list[str]) -> DataFrame:
    """``caption_candidates`` by cells of the page."""
    cell, x, y, w, h = 0.06, *(F.col(c) for c in "xywh")
    edge, middle = y + h, x + w / 2
    spots = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    zone = lambda name, lo, hi: F.struct(F.lit(name).alias("name"), lo.alias("lo"), hi.alias("hi"))
    zones = F.array(zone("edge", edge - ABOVE, edge + BELOW), zone("foot", y + h * FOOT, edge))
    o = owners.select(*page, "place", middle.alias("__middle"), edge.alias("__edge"), F.greatest(F.lit(ASIDE), w * ASIDE_SHARE).alias("__reach"), F.explode(zones).alias("__zone"), (y + h * FOOT).alias("__foot"))
    o = o.withColumn("__x", spots(F.col("__middle") - F.col("__reach"), F.col("__middle") + F.col("__reach"))).withColumn("__y", spots(F.col("__zone.lo"), F.col("__zone.hi")))
    points = F.array(F.struct(F.lit("edge").alias("name"), y.alias("at")), F.struct(F.lit("foot").alias("name"), (y + h / 2).alias("at")))
    l = labels.select(*page, "label", middle.alias("__lx"), y.alias("__top"), (y + h / 2).alias("__ly"), F.floor(middle / cell).alias("__x"), F.explode(points).alias("__point"))
    l = l.withColumn("__y", F.floor(F.col("__point.at") / cell))
    met = o.withColumn("__name", F.col("__zone.name")).join(l.withColumn("__name", F.col("__point.name")), [*page, "__name", "__x", "__y"])
    aside = F.abs(F.col("__lx") - F.col("__middle"))
    in_foot = (F.col("__ly") > F.col("__foot")) & (F.col("__ly") < F.col("__edge"))
    near = (aside <= F.col("__reach")) & F.col("__point.at").between(F.col("__zone.lo"), F.col("__zone.hi")) & (in_foot == (F.col("__name") == "foot"))
    off = F.when(in_foot, 0.0).otherwise(F.abs(F.col("__top") - F.col("__edge")) / BELOW)
    return met.filter(near).select(*page, "place", "label", (aside / F.col("__reach") + off).alias("score"))


def attach_nearest(candidates: DataFrame, page: list[str], *, worst: float = 1.25, margin: float = 0.2) -> DataFrame:
    """One label per owner, owners in order of place, each label used once.

    An owner takes its nearest free label if the score is good enough and the runner-up clearly worse.
    Pages of up to ``LONG_PAGE`` candidates are gone through whole.  Candidates without a page, an owner or a label count for nothing.
    """
    told = F.lit(True)
    for c in (*page, "place", "label"):
        told = told & F.col(c).isNotNull()
    open_ = cut_lineage(candidates.select(*page, "place", "label", "score").filter(told))
    long = cut_lineage(open_.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LONG_PAGE))
    if long.isEmpty():
        return attach_pages(open_, page, worst, margin)
    part = lambda how: open_.alias("l").join(long.alias("r"), null_safe("l", "r", page), how)
    return attach_pages(part("left_anti"), page, worst, margin).unionByName(_attach_rounds(cut_lineage(part("left_semi")), page, worst, margin))


def _attach_rounds(open_: DataFrame, page: list[str], worst: float, margin: float) -> DataFrame:
    """``attach_nearest`` without a task that holds a page.

    Every round settles all owners that share no candidate with an earlier open owner, so the result is
    that of going through the owners one by one.
    """
    taken = None
    while not open_.isEmpty():
        first = open_.groupBy(*page, "label").agg(F.min("place").alias("__first"))
        ready = (open_.join(first, [*page, "label"]).groupBy(*page, "place").agg(
            F.bool_and(F.col("place") == F.col("__first")).alias("__ready"),
            F.min(F.struct("score", "label")).alias("__best"))
            .filter("__ready"))
        best = ready.select(*page, "place", F.col("__best.label").alias("label"), F.col("__best.score").alias("score"))
        second = (open_.join(best.select(*page, "place", F.col("label").alias("__top")), [*page, "place"]).filter(F.col("label") != F.col("__top"))
                  .groupBy(*page, "place").agg(F.min("score").alias("__next")))
        won = (best.join(second, [*page, "place"], "left")
               .filter((F.col("score") <= worst) & (F.col("__next").isNull() | (F.col("__next") - F.col("score") >= margin)))
               .select(*page, "place", "label", "score"))
        won = cut_lineage(won)
        taken = won if taken is None else taken.unionByName(won)
        rest = open_.join(ready.select(*page, "place"), [*page, "place"], "left_anti").join(won.select(*page, "label"), [*page, "label"], "left_anti")
        open_ = cut_lineage(rest)
    return taken if taken is not None else open_


# -- clusters ------------------------------------------------------------------------------

def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node, for undirected edges (a, b) given once each.

    Alternating star contraction: every node links its larger neighbours to the smallest one it knows,
    then its smaller neighbours, until the edges form stars.
    """
    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = both.join(low, "a")
        if larger:
            out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = cut_lineage(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    before = mark(e)
    while True:
        e = cut_lineage(star(star(e, True), False))
        now = mark(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now


ISLAND_ROWS = 4096  # boxes of one island that a task compares; larger islands go through the cells of a grid


def cluster_by_gap(boxes: DataFrame, page: list[str], ident: str, join: float) -> DataFrame:
    """Cluster of every box (columns page, ident, x, y, w, h): boxes closer than ``join`` belong together.

    The cluster is named by its smallest ident; idents are unique in the table.  Pages of up to ``ISLAND_ROWS`` boxes are read whole, in one shuffle of
    the boxes.  Larger ones are cut into islands that lie at least ``join`` apart.  An island of up to ``ISLAND_ROWS`` boxes is one task's work, a larger
    one is spread over the cells of a grid; all ways are exact.  Boxes without a finite place and size are clusters of their own.
    """
    long = cut_lineage(boxes.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > ISLAND_ROWS))
    if long.isEmpty():
        return cluster_pages(boxes, page, ident, join)
    part = lambda how: boxes.alias("l").join(long.alias("r"), null_safe("l", "r", page), how)
    return cluster_pages(part("left_anti"), page, ident, join).unionByName(_cluster_long(part("left_semi"), page, ident, join))


def _cluster_long(boxes: DataFrame, page: list[str], ident: str, join: float) -> DataFrame:
    """``cluster_by_gap`` without a task that holds a page."""
    at = cut_lineage(boxes.select(*page, ident, *[F.col(c).cast("double").alias(c) for c in "xywh"]).filter(placed()))
    cut = islands(at, page, [ident], join, join)
    whole = [*page, BAND, ISLAND]
    big = cut_lineage(cut.groupBy(*whole).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > ISLAND_ROWS))
    found = cut
    if crowded := not big.isEmpty():
        found = cut.alias("l").join(big.alias("r"), null_safe("l", "r", whole), "left_anti")
    named = cluster_islands(found, page, ident, join).select(*page, ident, "cluster")
    if crowded:
        rest = cut.alias("l").join(big.alias("r"), null_safe("l", "r", whole), "left_semi").drop(BAND, ISLAND)
        named = named.unionByName(_cluster_cells(rest, page, ident, join).select(*page, ident, "cluster"))
    return (boxes.alias("l").join(named.alias("r"), null_safe("l", "r", [*page, ident]), "left")
            .select(*[F.col(f"l.`{c}`") for c in boxes.columns], F.coalesce("r.cluster", F.col(f"l.{ident}")).alias("cluster")))


def _cluster_cells(boxes: DataFrame, page: list[str], ident: str, join: float) -> DataFrame:
    """``cluster_by_gap`` without a task that holds an island.

    The grid cell is half the join distance wide, so boxes in the same or in touching cells are always
    close enough.  Cells two apart are compared by the edges of their contents, and cells two apart in
    both directions by one ordered pass over their boxes.
    """
    s = join / 2
    placed = boxes.select(*page, ident, "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    cells = (placed.withColumns({"cx": F.explode(F.sequence(F.floor(F.col("x") / s), F.floor(F.col("x1") / s)))})
             .withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / s), F.floor(F.col("y1") / s)))))
    parts = cut_lineage(cells.select(*page, ident, F.struct(*page, "cx", "cy").alias("node"), "cx", "cy",
                                     F.greatest("x", F.col("cx") * s).alias("x0"), F.least("x1", (F.col("cx") + 1) * s).alias("x1"),
                                     F.greatest("y", F.col("cy") * s).alias("y0"), F.least("y1", (F.col("cy") + 1) * s).alias("y1"),
                                     F.floor(F.col("x") / s).alias("fx"), F.floor(F.col("y") / s).alias("fy")))
    summary = parts.groupBy(*page, "cx", "cy").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))

    # A box that spans cells ties them to its first one.
    spans = parts.select(F.struct(*page, F.col("fx").alias("cx"), F.col("fy").alias("cy")).alias("a"), F.col("node").alias("b"))

    offsets = [(i, j) for i in range(0, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    shifted = summary.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])))
    left = shifted.select(*page, F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("cx") + F.col("__d.i")).alias("cx"), (F.col("cy") + F.col("__d.j")).alias("cy"),
                          F.col("__d.i").alias("i"), F.col("__d.j").alias("j"), F.col("x1").alias("a_x1"), F.col("y0").alias("a_y0"), F.col("y1").alias("a_y1"))
    pairs = left.join(summary, [*page, "cx", "cy"])
    near_x = F.col("x0") - F.col("a_x1") < join
    near_y = F.when(F.col("j") > 0, F.col("y0") - F.col("a_y1") < join).otherwise(F.col("a_y0") - F.col("y1") < join)
    far_x, far_y = F.col("i") == 2, F.abs("j") == 2
    close = pairs.filter((~far_x | near_x) & (~far_y | near_y))
    a_node, b_node = F.struct(*page, F.col("ax").alias("cx"), F.col("ay").alias("cy")), F.struct(*page, "cx", "cy")
    sure = close.filter(~(far_x & far_y)).select(a_node.alias("a"), b_node.alias("b"))

    corner = close.filter(far_x & far_y).select(a_node.alias("a"), b_node.alias("b"), "j")
    flip = F.when(F.col("j") > 0, 1).otherwise(-1)
    a_rows = corner.join(parts.select(F.col("node").alias("a"), "x1", "y0", "y1"), "a").select(
        "a", "b", (F.col("x1") + join).alias("k"), F.lit(0).alias("side"), (F.when(F.col("j") > 0, F.col("y1")).otherwise(-F.col("y0")) + join).alias("limit"), F.lit(None).cast("double").alias("v"))
    b_rows = corner.join(parts.select(F.col("node").alias("b"), "x0", "y0", "y1"), "b").select(
        "a", "b", F.col("x0").alias("k"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("limit"), F.when(F.col("j") > 0, F.col("y0")).otherwise(-F.col("y1")).alias("v"))
    swept = Ordered(cut_lineage(a_rows.unionByName(b_rows)), ["a", "b"], ["k", "side", "limit", "v"]).add(__low=("min", "v")).done()
    touching = swept.filter((F.col("side") == 0) & (F.col("__low") < F.col("limit"))).select("a", "b").distinct()

    groups = connected_components(reduce(DataFrame.unionByName, [spans, sure, touching]))
    home = parts.filter((F.col("cx") == F.col("fx")) & (F.col("cy") == F.col("fy"))).select(ident, *page, "node")
    rooted = home.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min(ident).alias("cluster"))
    return boxes.join(rooted.join(names, "root").select(*page, ident, "cluster"), [*page, ident])


def cluster_boxes(clustered: DataFrame, page: list[str]) -> DataFrame:
    """Union box and size of every cluster."""
    c = clustered.groupBy(*page, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"),
                                                 F.max(F.col("x") + F.col("w")).alias("__x1"), F.max(F.col("y") + F.col("h")).alias("__y1"))
    return c.select(*page, "cluster", "n", "x", "y", (F.col("__x1") - F.col("x")).alias("w"), (F.col("__y1") - F.col("y")).alias("h"))


def absorb_adjacent(targets: DataFrame, pieces: DataFrame, page: list[str], ident: str, piece: str) -> tuple[DataFrame, DataFrame]:
    """Grow targets over the pieces beside or just below them until nothing changes; the grown targets and the pieces left over.

    Pieces are taken one at a time: always the smallest ``piece`` that touches a target, by the target of the smallest ``ident`` that
    it touches as that has grown so far.  Pages are cut into islands that no growth can leave, and an island's order is followed in one
    task.  Boxes without a finite place and size stay as they are.
    """
    cols = ["x", "y", "w", "h"]
    box = [F.col(c).cast("double").alias(c) for c in cols]
    t, p = targets.select(*page, F.col(ident).alias("__t"), *box), pieces.select(*page, F.col(piece).alias("__p"), *box)
    both = cut_lineage(t.unionByName(p, allowMissingColumns=True))
    cut = islands(both.filter(placed()), page, ["__t", "__p"], SIDE + 1e-9, UNDER + 1e-9)
    done = cut_lineage(absorb_islands(cut, page, "__t", "__p").drop(BAND, ISLAND).unionByName(both.filter(~placed()), allowMissingColumns=True))
    grown = done.filter("__t IS NOT NULL").select(*page, F.col("__t").alias(ident), *cols)
    left = done.filter("__p IS NOT NULL AND owner IS NULL").select(*page, F.col("__p").alias(piece), *cols)
    return grown, left
