"""SimHash near-duplicates: fingerprints joined on a grid of per-segment bit counts.

A 64-bit fingerprint is embedded as the bit counts (0 to 2) of its 32 two-bit segments.  The Manhattan distance of two
embeddings is never larger than the Hamming distance of their fingerprints.  The 32 coordinates form six bands.  Within a
Manhattan distance of 4 at least two bands are equal, so a grid whose cells are (two bands, their coordinates) brings every
pair within reach together; in a cell the Manhattan bound is tested first and the fingerprints themselves decide.

Equal fingerprints are one row before anything is compared.  A cell sends on a spanning forest of its links, never its
pairs, and a cell over ``TILE`` rows is dealt to tiles of block against block, so that no task holds a whole hot cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.components import connected_components
from folioframe.operators.lineage import cut_lineage

SHINGLE, MAX_DISTANCE, TILE = 4, 4, 4096
BANDS = 6
_SLAB = 1 << 22  # pairs compared at once
_LOW = 0x5555555555555555


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Column function: a text's fingerprint as a signed long (null: that of an empty text)."""
    return pa.array(np.fromiter((fingerprint_of(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


def _coordinates(fp):
    """The 32 bit counts, each in two bits as 00, 01 or 11: differing bits then count Manhattan distance."""
    half = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(half).bitwiseAND(F.lit(_LOW))
    high = fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _masks() -> list[int]:
    """Two bands each, as signed 64-bit masks over the coordinates."""
    edges = [round(i * 32 / BANDS) * 2 for i in range(BANDS + 1)]
    bands = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [(m - (1 << 64)) if m >> 63 else m for m in (a | b for a, b in combinations(bands, 2))]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 linked by pairs: the smallest row of each row's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _near(fp: np.ndarray, grid: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are links: the lower bound first, then the fingerprints."""
    near = np.flatnonzero(np.bitwise_count(grid[i] ^ grid[j]) <= MAX_DISTANCE)
    return near[np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= MAX_DISTANCE]


def _link_cells(cell: np.ndarray, fp: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (fingerprint, smallest row's fingerprint of its component) for rows sorted by cell."""
    n = len(cell)
    last = np.searchsorted(cell, cell, "right") if n else cell
    ahead = last - np.arange(n) - 1  # partners after each row in its cell
    ends = np.cumsum(ahead)
    label = np.arange(n)
    at = 0
    while at < n:
        base = ends[at] - ahead[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SLAB, "right")))
        count = ahead[at:to]
        i = np.repeat(np.arange(at, to), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
        hit = _near(fp, grid, i, j)
        own = np.flatnonzero(label != np.arange(n)) if to < n or at else np.zeros(0, np.int64)
        label = _forest(n, np.concatenate([i[hit], own]), np.concatenate([j[hit], label[own]]))
        at = to
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in sorted order; the last cell of a batch waits for the rest of its rows."""
    rest = None

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, fp, grid = (table[c].to_numpy().view(np.uint64) for c in ("tile", "fp", "grid"))
        a, b = _link_cells(np.cumsum(np.concatenate([[0], tile[1:] != tile[:-1]])), fp, grid)
        yield pa.record_batch({"u": pa.array(a.view(np.int64)), "v": pa.array(b.view(np.int64))})

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        tile = table["tile"].to_numpy()
        cut = int(np.flatnonzero(tile == tile[-1])[0])
        if cut:
            yield from links(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield from links(rest)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) at most 4 bits apart: a forest of each cell's links."""
    grid = prints.select("fp", _coordinates(F.col("fp")).alias("grid"))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("grid").bitwiseAND(F.lit(m)).alias("at")) for k, m in enumerate(_masks())])
    cells = grid.select("fp", "grid", F.inline(keys))
    crowded = cells.groupBy("k", "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("long")
    block = F.pmod(F.xxhash64("fp"), blocks)
    tiles = (cells.join(crowded, ["k", "at"]).withColumn("blocks", blocks).withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(F.xxhash64("k", "at", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "fp", "grid"))
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_link_batches, "u bigint, v bigint")


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id): for each distinct value of column ``fp``, the smallest id that links reach from it."""
    prints = docs.groupBy("fp").agg(F.min(id_col).alias("id"))
    parts = connected_components(fingerprint_links(prints.select("fp"))).withColumnRenamed("node", "fp")
    rooted = prints.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = rooted.groupBy("component").agg(F.min("id").alias("component_id"))
    return rooted.join(lowest, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp, component_id) for every row of ``docs``; component_id is the smallest id of its group.

    Null and empty texts have fingerprint 0, which links like any other.  Rows with a null id take part, and a group
    that has no other ids gets a null component_id.  Repeated rows stay repeated.  Other columns are not looked at, so their
    names can't clash.  An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), fingerprint(F.col(text_col)).alias("fp"))
    slim = cut_lineage(slim)
    return slim.join(fingerprint_components(slim, "id"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` reduced to one row of each group: that of the smallest id (then of the smallest text hash).

    A group whose ids are all null keeps one row as well.  All columns pass unchanged.
    """
    groups = cut_lineage(near_duplicates(docs, id_col, text_col))
    # A null id loses against any other; the fingerprint names the group of a null component_id.
    first = (groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
             .agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "text_hash")).alias("first"))
             .select(F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash")))
    marked = docs.withColumn("__hash", F.xxhash64(F.col(text_col)))
    return (marked.alias("d").join(first.alias("f"), F.col(f"d.{id_col}").eqNullSafe(F.col("f.__id")) & (F.col("d.__hash") == F.col("f.__hash")), "left_semi")
            .dropDuplicates([id_col, "__hash"]).drop("__hash"))
