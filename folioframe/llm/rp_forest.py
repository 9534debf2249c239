"""Near-duplicate embeddings by a forest of random-projection trees.

Trees split at the median of a random projection; vectors near the split go to both sides.  Their upper levels are grown on a bounded
sample and every vector is put into its leaves; leaves that hold too many of all vectors are split again, each by a tree over a sample of
its own, until no leaf over the limit can be split.  Leaves are compared by themselves, in tiles of blocks if they are large, by cosine
in double precision.  Equal directions are one row before that.  A leaf sends on counts and a spanning forest, never its pairs:
a pair that meets in several leaves is counted in the first one only, which the leaf sees from the leaf lists of both rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.components import connected_components
from folioframe.functions.text import let
from folioframe.operators.lineage import cut_lineage

MIN_COSINE = 0.95
TREES, LEAF, SPILL, SAMPLE, TILE = 8, 64, 0.08, 50_000, 1024
SAMPLE_BYTES = 64 << 20  # of the sample's vectors, whatever its number of rows
CROWD = 4  # a leaf of more than this times ``LEAF`` vectors is split again
PART, BATCH = 2048, 4096  # vectors of a leaf that its own tree is grown on, and vectors sorted into leaves at once
REACH = 0.4  # of the spread that a random direction gives to two vectors at the least cosine
TRIES = 4  # directions tried before a node is left whole
DENSE = 0.6  # a split that would send more than this share to both sides is not made


@dataclass
class Tree:
    """Inner node k projects on directions[k] and goes left up to cut + spill, right from cut - spill; children < 0 are leaves."""

    directions: np.ndarray
    cuts: np.ndarray
    spills: np.ndarray
    children: np.ndarray
    n_leaves: int


def grow(x: np.ndarray, leaf: int, seed: int, reach: float) -> Tree:
    """A tree over a sample; ``reach`` is the least spill on each side of a cut, set by how far linked vectors lie apart."""
    rng = np.random.default_rng(seed)
    directions, cuts, spills, children = [], [], [], []
    n_leaves = 0

    def node(rows: np.ndarray) -> int:
        nonlocal n_leaves
        for _ in range(TRIES if len(rows) > leaf else 0):
            # Half differences of two random rows, half free directions: the first follow the data, the second never fail.
            d = x[rng.choice(rows)] - x[rng.choice(rows)] if rng.random() < 0.5 else rng.standard_normal(x.shape[1])
            norm = np.linalg.norm(d)
            p = x[rows] @ (d / norm) if norm > 1e-6 else np.zeros(len(rows))
            cut, spill = float(np.median(p)), max(reach, SPILL * float(p.std()))
            left, right = rows[p <= cut + spill], rows[p >= cut - spill]
            if len(left) + len(right) < (1 + DENSE) * len(rows) and len(left) < len(rows) and len(right) < len(rows):
                k = len(cuts)
                directions.append(d / norm)
                cuts.append(cut)
                spills.append(spill)
                children.append([0, 0])
                children[k][0], children[k][1] = node(left), node(right)
                return k
        n_leaves += 1
        return -n_leaves

    root = node(np.arange(len(x)))
    if root < 0:
        return Tree(np.zeros((0, x.shape[1] if x.ndim > 1 else 0)), np.zeros(0), np.zeros(0), np.zeros((0, 2), np.int64), 1)
    return Tree(np.array(directions), np.array(cuts), np.array(spills), np.array(children), n_leaves)


def leaves_of(tree: Tree, x: np.ndarray) -> list[np.ndarray]:
    """For each leaf of the tree the rows of ``x`` that come to it (leaf k at k - 1)."""
    out = [np.zeros(0, np.int64)] * tree.n_leaves
    todo = [(0 if len(tree.cuts) else -1, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if k < 0:
            out[-k - 1] = rows
        elif len(rows):
            p = x[rows] @ tree.directions[k]
            todo.append((tree.children[k][0], rows[p <= tree.cuts[k] + tree.spills[k]]))
            todo.append((tree.children[k][1], rows[p >= tree.cuts[k] - tree.spills[k]]))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _link_leaf(leaf: int, vec: np.ndarray, weight: np.ndarray, x: np.ndarray, member: list[np.ndarray], block: np.ndarray, tile: tuple[int, int],
               min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tile: per row its newly counted links (weighted) and the first row of its component in the tile."""
    n = len(vec)
    a, b = np.flatnonzero(block == tile[0]), np.flatnonzero(block == tile[1])
    i, j = np.nonzero(x[a] @ x[b].T >= min_cosine)
    i, j = a[i], b[j]
    keep = i < j if tile[0] == tile[1] else np.ones(len(i), bool)
    i, j = i[keep], j[keep]
    links, label = np.zeros(n, np.int64), np.arange(n)
    if not len(i):
        return links, label, np.zeros(0, np.int64)
    used = np.unique(np.concatenate([i, j]))
    earlier = {}
    for r in used:
        for k in member[r]:
            if k < leaf:
                earlier.setdefault(int(k), []).append(r)
    met = np.zeros((n, len(earlier)), np.float32)
    for c, rows in enumerate(earlier.values()):
        met[rows, c] = 1
    seen = (met[a] @ met[b].T) > 0 if earlier else np.zeros((len(a), len(b)), bool)
    place = np.zeros(n, np.int64)
    place[a] = np.arange(len(a))
    at_i = place[i].copy()
    place[b] = np.arange(len(b))
    new = ~seen[at_i, place[j]]
    np.add.at(links, i[new], weight[j[new]])
    np.add.at(links, j[new], weight[i[new]])
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return links, label, used


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, min_cosine: float = MIN_COSINE, trees: int = TREES,
                    leaf: int = LEAF, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept): every row with the rows linked to it directly and the smallest id that links reach.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different lengths
    never link.  Repeated ids are separate vectors.  Rows with a null id take part in links; kept is false for them unless their component has no other id.
    Other columns are not looked at.  An empty table gives an empty result.  Trees are grown on at most about ``sample`` distinct vectors
    (of ``SAMPLE_BYTES``) per length; all vectors are put into leaves, and crowded leaves are split again from samples of theirs.  A pair is found if it shares a leaf in any tree.
    """
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    # Divided by a power of two near its largest component first, a vector's squares neither overflow nor vanish; no digit of it changes.
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(v, F.abs)))))
    scaled = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(good, F.lit(False)), let(scale, lambda m: F.transform(v, lambda e: e / m))).alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, e: s + e * e))
    rows = cut_lineage(scaled.select("id", let(norm, lambda n: F.transform("u", lambda e: e / n)).alias("x")).withColumn("key", F.xxhash64("x")))
    # Equal vectors are one row; a vector's hash stands for it from here on (with its length and first value against chance).
    single = rows.filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    single = cut_lineage(single.withColumn("node", F.xxhash64("x", F.reverse("x"))))
    widths = [r["w"] for r in single.select(F.size("x").alias("w")).distinct().collect()]
    spark, found = vectors.sparkSession, None
    for width in sorted(widths):
        links = _links_of_width(single.filter(F.size("x") == width), width, min_cosine, trees, leaf, sample, tile)
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "node bigint, links bigint, root bigint")
    found = cut_lineage(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "node", "root").withColumnRenamed("component", "part")
    known = single.select("x", "node", "n", "low").join(counts, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    low = known.groupBy("part").agg(F.min("low").alias("component_id"))
    known = known.join(low, "part").select("x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
    out = rows.select("id", "x").join(known.withColumnRenamed("x", "y"), F.col("x") == F.col("y"), "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def _links_of_width(single: DataFrame, width: int, min_cosine: float, trees: int, leaf: int, sample: int, tile: int) -> DataFrame:
    """(node, links, root): newly counted links of each row of each tile, and a row that its links reach."""
    spark = single.sparkSession
    n = single.count()
    share = min(1.0, sample / n, SAMPLE_BYTES / (8 * width * n))
    picked = single.filter(F.pmod("node", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("x").toArrow()
    x = _matrix(picked["x"].combine_chunks(), width)
    reach = REACH * np.sqrt(2 * (1 - min_cosine) / width)
    forest = [grow(x, max(8, round(leaf * share)), seed, reach) for seed in range(trees)]
    first = np.cumsum([0, *(t.n_leaves for t in forest)])
    forest = spark.sparkContext.broadcast((forest, first))  # its size follows from the sample's bound

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, first = forest.value
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            leaf_of, row_of = [], []
            for tree, base in zip(grown, first):
                for k, rows in enumerate(leaves_of(tree, x)):
                    if len(rows):
                        leaf_of.append(np.full(len(rows), base + k))
                        row_of.append(rows)
            leaf_of, row_of = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (leaf_of, row_of))
            order = np.lexsort((leaf_of, row_of))
            cuts = np.searchsorted(row_of[order], np.arange(len(x) + 1)).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(cuts), pa.array(leaf_of[order].astype(np.int64)))
            yield pa.record_batch([batch.column("node"), batch.column("n"), batch.column("x"), leaves], names=["node", "n", "x", "leaves"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key = np.stack([table[c].to_numpy() for c in ("leaf", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            for a, b in zip(starts[:-1], starts[1:]):
                yield from one(table.slice(a, b - a))
            rest = table.slice(starts[-1])
        if rest is not None:
            yield from one(rest)

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        vec = table["node"].to_numpy()
        member = [np.asarray(m) for m in table["leaves"].to_pylist()]
        links, label, used = _link_leaf(table["leaf"][0].as_py(), vec, table["n"].to_numpy(), _matrix(table["x"].chunk(0), width), member,
                                        table["block"].to_numpy(), (table["i"][0].as_py(), table["j"][0].as_py()), min_cosine)
        if len(used):
            yield pa.record_batch([pa.array(vec[used]), pa.array(links[used]), pa.array(vec[label[used]])], names=["node", "links", "root"])

    placed = cut_lineage(single.select("node", "n", "x").mapInArrow(place, T.StructType([
        T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())),
        T.StructField("leaves", T.ArrayType(T.LongType()))])))
    placed = _split_crowds(placed, width, leaf, reach)
    spread = placed.withColumn("leaf", F.explode("leaves"))
    # Written, so that Spark knows how large they are and moves the vectors for them only where it has to.
    sizes = cut_lineage(spread.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    blocks = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    tiles = (spread.join(sizes, "leaf").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "leaf"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other", "m"))
    return tiles.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(link, "node bigint, links bigint, root bigint")


def _split_crowds(placed: DataFrame, width: int, leaf: int, reach: float) -> DataFrame:
    """``placed`` with crowded leaves replaced by the leaves of trees of their own, until no crowded leaf can be split.

    A leaf's tree is grown in one task on about ``PART`` of its vectors; its vectors are then sorted in by tasks of about ``BATCH``.
    New leaves are named by a hash; two of one name would be compared together, which loses no pair.
    """
    def tree(table: pa.Table) -> pa.Table:
        x = _matrix(table["x"].combine_chunks(), width)
        name, rows = table["leaf"][0].as_py(), table["m"][0].as_py()
        grown = grow(x, max(8, round(leaf * min(1.0, PART / rows))), name & 0xFFFFFFFF, reach)
        return pa.table({"leaf": [name], "m": [rows], "tree": pa.array([pickle.dumps(grown) if grown.n_leaves > 1 else None], pa.binary())})

    def sort_in(rows: pa.Table, trees: pa.Table) -> pa.Table:
        node, at, k = rows["node"].to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(rows) and len(trees):
            for number, found in enumerate(leaves_of(pickle.loads(trees["tree"][0].as_py()), _matrix(rows["x"].combine_chunks(), width))):
                at.append(found)
                k.append(np.full(len(found), number))
        at, k = np.concatenate(at), np.concatenate(k)
        return pa.table({"node": pa.array(node[at], pa.int64()), "leaf": rows["leaf"].take(pa.array(at)), "k": pa.array(k, pa.int64())})

    stuck = None  # crowded leaves that no direction divides: dense groups, which are compared in tiles
    while True:
        spread = placed.select("node", "x", F.explode("leaves").alias("leaf"))
        crowded = spread.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CROWD * leaf)
        crowded = cut_lineage(crowded if stuck is None else crowded.join(stuck, "leaf", "left_anti"))
        if crowded.isEmpty():
            return placed
        rows = spread.join(crowded, "leaf")
        picked = rows.filter(F.pmod(F.xxhash64("leaf", "node"), F.col("m")) < PART).select("leaf", "m", "x")
        trees = cut_lineage(picked.groupBy("leaf").applyInArrow(tree, "leaf bigint, m bigint, tree binary"))
        whole = trees.filter("tree IS NULL").select("leaf")
        stuck = whole if stuck is None else stuck.union(whole)
        trees = trees.filter("tree IS NOT NULL").withColumn("tasks", F.ceil(F.col("m") / BATCH))
        if trees.isEmpty():
            return placed
        split = cut_lineage(trees.select("leaf", "tasks"))
        dealt = spread.join(split, "leaf").withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks"))).select("leaf", "task", "node", "x")
        each = trees.withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1))).select("leaf", "task", "tree")
        new = dealt.groupBy("leaf", "task").cogroup(each.groupBy("leaf", "task")).applyInArrow(sort_in, "node bigint, leaf bigint, k bigint")
        kept = spread.select("node", "leaf").join(split, "leaf", "left_anti").select("node", "leaf")
        # The leaves of one vector: as many as the trees and their overlap give it.
        told = kept.union(new.select("node", F.xxhash64("leaf", "k").alias("leaf"))).groupBy("node").agg(F.collect_set("leaf").alias("leaves"))
        placed = cut_lineage(placed.drop("leaves").join(told, "node"))
