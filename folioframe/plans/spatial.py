"""Example queries for the spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as cv
from ..operators import spatial as sp
from .demo import demo

IDENT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
SQL_SPOT = f"concat_ws('-', {', '.join(IDENT[:4])}, CAST(round(l_extendedprice * 100) AS BIGINT))"


def _spot():
    """One name a line item."""
    return F.concat_ws("-", *IDENT[:4], F.round(F.col("l_extendedprice") * 100).cast("bigint"))


@demo("covering_intervals", """
WITH j AS (SELECT s_nationkey % 5 AS engine, CAST(s_acctbal / 250 AS INT) + 4 AS a, CAST(s_acctbal / 250 AS INT) + 4 + s_suppkey % 12 AS b, s_suppkey % 3 = 0 AS active, s_suppkey FROM supplier)
SELECT p_partkey, (SELECT s_suppkey FROM j WHERE engine = p_partkey % 5 AND p_size BETWEEN a AND b ORDER BY active DESC, s_suppkey DESC LIMIT 1) AS job FROM part""")
def _(t):
    start = (F.round(F.col("s_acctbal") / 250).cast("int") + 4)
    jobs = t.supplier.select((F.col("s_nationkey") % 5).cast("long").alias("engine"), start.alias("a"), (start + F.col("s_suppkey") % 12).alias("b"), (F.col("s_suppkey") % 3 == 0).alias("active"), "s_suppkey")
    points = t.part.select("p_partkey", (F.col("p_partkey") % 5).alias("engine"), "p_size")
    done = sp.covering_intervals(points, jobs, ["engine"], "p_size", "a", "b", [F.col("active"), F.col("s_suppkey")], ["s_suppkey"])
    return done.select("p_partkey", F.col("cover.s_suppkey").alias("job"))


@demo("assign_to_region", f"""
WITH b AS (SELECT p_size % 8 AS page, p_partkey, p_partkey % 45 + 3e-1 AS x0, p_partkey % 45 + p_size // 6 + 2e-1 AS x1, p_size % 9 AS y0, p_size % 9 + 2 AS y1 FROM part),
s AS (SELECT DISTINCT l_linenumber, l_quantity, l_discount FROM lineitem), h AS (SELECT s.*, min(p_partkey) AS region FROM s JOIN b ON page = l_linenumber AND l_quantity + .25 BETWEEN x0 AND x1 AND round(l_discount * 100, 6) BETWEEN y0 AND y1 GROUP BY ALL)
SELECT {', '.join('l.' + c for c in IDENT)}, region FROM lineitem l LEFT JOIN h ON h.l_linenumber = l.l_linenumber AND h.l_quantity = l.l_quantity AND h.l_discount = l.l_discount""")
def _(t):
    k, s = F.col("p_partkey") % 45, F.col("p_size")
    regions = t.part.select((s % 8).alias("l_linenumber"), "p_partkey", (k + F.lit(0.3)).alias("x0"), (k + F.floor(s / 6) + F.lit(0.2)).alias("x1"), (s % 9).alias("y0"), (s % 9 + 2).alias("y1"))
    done = sp.assign_to_region(t.lineitem.select(*IDENT, "l_quantity", "l_discount"), regions, ["l_linenumber"], F.col("l_quantity") + 0.25, F.round(F.col("l_discount") * 100, 6),
                               ("x0", "y0", "x1", "y1"), "p_partkey", ["p_partkey"], 4.0)
    return done.select(*IDENT, F.col("region.p_partkey").alias("region"))


@demo("uncovered", """
WITH c AS (SELECT o_custkey AS k, o_orderkey, epoch(o_orderdate) / 86400 AS a, epoch(o_orderdate) / 86400 + 30 AS b FROM orders WHERE o_orderstatus = 'F'),
v AS (SELECT o_custkey AS k, epoch(o_orderdate) / 86400 AS a, epoch(o_orderdate) / 86400 + 20 AS b FROM orders WHERE o_orderstatus <> 'F'),
m AS (SELECT k, a, b, sum(n) OVER (PARTITION BY k ORDER BY a, b) AS g FROM (SELECT *, (a > coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS n FROM v)),
u AS (SELECT k, min(a) AS a, max(b) AS b FROM m GROUP BY k, g)
SELECT o_orderkey, round(coalesce(sum(greatest(0, least(c.b, u.b) - greatest(c.a, u.a))) FILTER (u.k IS NOT NULL), 0) / 30, 6) AS share FROM c LEFT JOIN u ON u.k = c.k GROUP BY o_orderkey HAVING share < .2""")
def _(t):
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", day.alias("a"))
    comps = o.filter("o_orderstatus = 'F'").withColumn("b", F.col("a") + 30)
    cover = o.filter("o_orderstatus <> 'F'").withColumn("b", F.col("a") + 20)
    return sp.uncovered(comps, cover, ["k"], ("a", "b"), ("a", "b")).select("o_orderkey", F.round("share", 6).alias("share"))


@demo("suppress_overlaps", f"""
WITH b AS (SELECT {', '.join(IDENT)}, CAST(l_quantity AS INT) AS x, CAST(floor(l_extendedprice / 100) AS INT) AS y, l_returnflag FROM lineitem)
SELECT {', '.join(IDENT)} FROM b WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM b p WHERE p.l_returnflag = 'A' AND p.l_suppkey = b.l_suppkey AND abs(p.x - b.x) < 2 AND abs(p.y - b.y) < 2)""")
def _(t):
    b = t.lineitem.select(*IDENT, "l_returnflag", F.col("l_quantity").cast("int").alias("x"), F.floor(F.col("l_extendedprice") / 100).cast("int").alias("y"))
    return sp.suppress_overlaps(b.filter("l_returnflag = 'A'"), b.filter("l_returnflag = 'R'"), ["l_suppkey"], "x", "y").select(*IDENT)


@demo("drop_same_spot", """
SELECT l_suppkey, l_returnflag, floor(l_quantity / 4 + .5) AS x, floor(l_linenumber * .7::DOUBLE + .5) AS y, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL""", x="BIGINT", y="BIGINT")
def _(t):
    b = t.lineitem.select("l_suppkey", "l_returnflag", (F.col("l_quantity") / 4).alias("x"), (F.col("l_linenumber") * 0.7).alias("y"), "l_orderkey")
    done = sp.drop_same_spot(b, ["l_suppkey"], "l_returnflag", "x", "y", ["l_orderkey", "x", "y"])
    return done.select("l_suppkey", "l_returnflag", F.floor(F.col("x") + 0.5).alias("x"), F.floor(F.col("y") + 0.5).alias("y"), "l_orderkey")


@demo("reconcile_cells", """
WITH c AS (SELECT p_brand AS g, p_partkey, p_partkey AS x, left(p_type, 1) AS v FROM part WHERE p_size <= 25),
r AS (SELECT p_brand AS g, p_partkey, p_partkey + .01::DOUBLE AS x, lower(left(p_name, 1)) AS t, .6::DOUBLE + p_size % 5 / 10 AS c FROM part WHERE p_size > 25),
n AS (SELECT c.*, r.x AS rx, r.t, r.c, row_number() OVER (PARTITION BY c.p_partkey ORDER BY abs(r.x - c.x), r.x) AS k FROM c LEFT JOIN r ON r.g = c.g)
SELECT p_partkey, v AS before, CASE WHEN abs(rx - x) < 60 AND regexp_full_match(t, '[a-r]') AND c >= .8::DOUBLE THEN t ELSE v END AS after, coalesce(abs(rx - x) < 60 AND regexp_full_match(t, '[a-r]') AND c >= .8::DOUBLE AND t <> v, false) AS corrected FROM n WHERE k = 1""")
def _(t):
    p = t.part
    cells = p.filter("p_size <= 25").select(F.col("p_brand").alias("g"), "p_partkey", F.col("p_partkey").cast("double").alias("x"), F.substring("p_type", 1, 1).alias("v"))
    reads = p.filter("p_size > 25").select(F.col("p_brand").alias("g"), (F.col("p_partkey") + 0.01).alias("x"), F.lower(F.substring("p_name", 1, 1)).alias("t"),
                                           (0.6 + F.col("p_size") % 5 / 10).alias("c"))
    return sp.reconcile_cells(cells, reads, ["g"], "x", "v", "t", "c", alphabet="^[a-r]$", tolerance=60).select("p_partkey", "before", "after", "corrected")


def _captions(t):
    """Pictures and captions on the pages of the orders: one box per line item."""
    c = F.col
    spot = F.xxhash64(*IDENT)
    x, y = F.pmod(spot, F.lit(89)) / 100, F.pmod(spot, F.lit(83)) / 90
    items = t.lineitem.select(c("l_orderkey").alias("page"), spot.alias("id"), "l_returnflag", x.alias("x"), y.alias("y"))
    owners = items.filter("l_returnflag <> 'R'").select("page", c("id").alias("place"), "x", "y", F.lit(0.3).alias("w"), F.lit(0.2).alias("h"))
    labels = items.select("page", c("id").alias("label"), "x", F.col("y").alias("y"), F.lit(0.06).alias("w"), F.lit(0.02).alias("h"))
    return owners, labels


@demo("attach_nearest")
def _(t):
    owners, labels = _captions(t)
    done = sp.attach_nearest(sp.caption_candidates(owners, labels, ["page"]), ["page"])
    return done.select("page", "place", "label", F.round("score", 6).alias("score"))


def _parts(t):
    return t.lineitem.select("l_suppkey", _spot().alias("id"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"),
                             (F.col("l_discount") * 5).alias("w"), (F.col("l_tax") * 5).alias("h"))


@demo("cluster_by_gap", f"""
WITH RECURSIVE b AS (SELECT l_suppkey, {SQL_SPOT} AS id, l_extendedprice / 1000 AS x, CAST(l_quantity AS DOUBLE) AS y, l_discount * 5 AS w, l_tax * 5 AS h FROM lineitem),
near AS (SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON a.l_suppkey = c.l_suppkey AND a.id <> c.id
  AND greatest(0, greatest(a.x, c.x) - least(a.x + a.w, c.x + c.w), greatest(a.y, c.y) - least(a.y + a.h, c.y + c.h)) < 1.5),
low(id, step, root) AS (
  SELECT id, 0, id FROM b
  UNION ALL SELECT id, any_value(step) + 1, min(least(root, coalesce(other, root))) FROM (
    SELECT l.id, l.step, l.root, m.root AS other, bool_or(l.root > m.root) OVER () AS moving FROM low l LEFT JOIN near ON near.a = l.id LEFT JOIN low m ON m.id = near.b) WHERE moving GROUP BY id)
SELECT l_suppkey, root AS cluster, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h
FROM b JOIN (SELECT id, min(root) AS root FROM low GROUP BY id) USING (id) GROUP BY ALL""", n="BIGINT")
def _(t):
    done = sp.cluster_by_gap(_parts(t), ["l_suppkey"], "id", 1.5)
    return sp.cluster_boxes(done, ["l_suppkey"])


@demo("absorb_adjacent", f"""
WITH RECURSIVE b AS (SELECT l_orderkey AS page, {SQL_SPOT} AS id, l_linestatus, (l_partkey * 7 + l_suppkey * 3 + l_linenumber * 31) % 97 / 100 AS x, (l_partkey * 11 + l_suppkey + l_linenumber * 17) % 91 / 100 AS y FROM lineitem),
s(page, step, t, p) AS (
  SELECT page, 0, coalesce(list({{'id': id, 'x': x, 'y': y, 'w': .2::DOUBLE, 'h': .15::DOUBLE}} ORDER BY id) FILTER (l_linestatus = 'O'), []),
         coalesce(list({{'id': id, 'x': x, 'y': y, 'w': .05::DOUBLE, 'h': .04::DOUBLE}} ORDER BY id) FILTER (l_linestatus = 'F'), []) FROM b GROUP BY page
  UNION ALL
  SELECT page, step + 1, [CASE WHEN j = owners[i] THEN {{'id': t[j].id, 'x': least(t[j].x, p[i].x), 'y': least(t[j].y, p[i].y),
      'w': greatest(t[j].x + t[j].w, p[i].x + p[i].w) - least(t[j].x, p[i].x), 'h': greatest(t[j].y + t[j].h, p[i].y + p[i].h) - least(t[j].y, p[i].y)}} ELSE t[j] END FOR j IN range(1, len(t) + 1)],
      [p[k] FOR k IN range(1, len(p) + 1) IF k <> i]
  FROM (SELECT *, list_filter(range(1, len(p) + 1), lambda k: owners[k] IS NOT NULL)[1] AS i FROM (
    SELECT page, step, t, p, [list_filter(range(1, len(t) + 1), lambda j: greatest(t[j].x, q.x) - least(t[j].x + t[j].w, q.x + q.w) <= .03 AND (
        least(t[j].y + t[j].h, q.y + q.h) - greatest(t[j].y, q.y) >= .8 * q.h AND q.h >= .04 * t[j].h
        OR greatest(t[j].y, q.y) - least(t[j].y + t[j].h, q.y + q.h) <= .012 AND q.w <= t[j].w))[1] FOR q IN p] AS owners FROM s)) WHERE i IS NOT NULL)
SELECT page, u.id, round(u.x, 6) AS x, round(u.y, 6) AS y, round(u.w, 6) AS w, round(u.h, 6) AS h
FROM (SELECT page, unnest(arg_max(t, step)) AS u FROM s GROUP BY page)""")
def _(t):
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    b = t.lineitem.select(F.col("l_orderkey").alias("page"), _spot().alias("id"), "l_linestatus", ((k * 7 + s * 3 + n * 31) % 97 / 100).alias("x"), ((k * 11 + s + n * 17) % 91 / 100).alias("y"))
    targets = b.filter("l_linestatus = 'O'").select("page", "id", "x", "y", F.lit(0.2).alias("w"), F.lit(0.15).alias("h"))
    pieces = b.filter("l_linestatus = 'F'").select("page", F.col("id").alias("piece"), "x", "y", F.lit(0.05).alias("w"), F.lit(0.04).alias("h"))
    grown, left = sp.absorb_adjacent(targets, pieces, ["page"], "id", "piece")
    return grown.select("page", "id", *[F.round(c, 6).alias(c) for c in "xywh"])


_BOXES = f"""b AS (SELECT l_suppkey % 50 AS page, {SQL_SPOT} AS id, l_returnflag, l_linenumber, (l_partkey * 7 + l_orderkey) % 300 AS x0, (l_orderkey * 11 + l_partkey) % 200 AS y0, l_quantity::INT % 9 + 1 AS w, l_linenumber * 2 AS h FROM lineitem)"""


@demo("uncovered_boxes", f"""
WITH {_BOXES},
e AS (SELECT DISTINCT page, unnest(range(x0, x0 + w * 4)) AS x, y FROM (SELECT page, x0, w, unnest(range(y0, y0 + h * 6)) AS y FROM b WHERE l_returnflag = 'A' AND l_linenumber > 4)),
c AS (SELECT DISTINCT page, unnest(range(x0, x0 + w)) AS x, y FROM (SELECT page, x0, w, unnest(range(y0, y0 + h)) AS y FROM b WHERE l_returnflag = 'N')),
p AS (SELECT page, id, unnest(range(x0, x0 + w)) AS x, y FROM (SELECT page, id, x0, w, unnest(range(y0, y0 + h)) AS y FROM b WHERE l_returnflag = 'R'))
SELECT id, count(*)::DOUBLE AS area, round(count(c.x) / count(*), 6) AS share FROM p JOIN e USING (page, x, y) LEFT JOIN c USING (page, x, y) GROUP BY id HAVING share < .2""")
def _(t):
    k, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    x, y, w, h = (k * 7 + o) % 300, (o * 11 + k) % 200, F.col("l_quantity").cast("int") % 9 + 1, n * 2
    b = t.lineitem.select((F.col("l_suppkey") % 50).alias("page"), _spot().alias("id"), "l_returnflag", n, x.alias("x0"), y.alias("y0"), w.alias("w"), h.alias("h"))
    sized = lambda df, sx, sy: df.withColumns({"x1": F.col("x0") + F.col("w") * sx, "y1": F.col("y0") + F.col("h") * sy})
    regions = sized(b.filter("l_returnflag = 'A' AND l_linenumber > 4"), 4, 6)
    done = cv.uncovered_boxes(sized(b.filter("l_returnflag = 'R'"), 1, 1), sized(b.filter("l_returnflag = 'N'"), 1, 1), ["page"], "id", regions=regions, cell=16.0)
    return done.select("id", "area", F.round("share", 6).alias("share"))
