"""Hard negatives by integer inner product, with bounds from segment summaries before exact scores.

A vector is cut into segments, and each segment's mean and deviation are stored.  Of two vectors, a segment contributes its length
times (the product of the means, plus or minus at most the product of the deviations) to the inner product, so the sums over all
segments bound the score from both sides.  Segments are halved level by level, each level only for the pairs that the one before it
left in doubt, and only pairs that pass the last level get an exact score.  Anchors and rows meet in blocks of bounded size; what a
block gives is each anchor's best rows, and a window takes the best of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.lineage import cut_lineage

ROWS, ANCHORS, COMPONENTS = 8192, 2048, 1 << 22  # most rows, anchors and vector components of a block
TILE = 64  # anchors of a block that are scored at a time
SEGMENTS = (4, 8, 16)  # a level each; levels whose segments would have fewer than three components are left out
LARGEST = float(1 << 53)  # squared norms stay below it, so that doubles hold every score and longs a hundred times it
_PAIRS = 1 << 16  # scored at a time
_ROUNDING = 1e-9  # of a bound, relative to the product of the norms


# -- inside a block --------------------------------------------------------------------

class Block:
    """Vectors as rows of a matrix, with the weighted mean and deviation of every segment of every level."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        values = pa.concat_arrays([c.flatten() for c in table["v"].chunks]) if len(table) else pa.array([], pa.int32())
        self.x = values.to_numpy().astype(np.float64).reshape(len(table), -1 if len(values) else 0)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.levels = [self._summaries(n) for n in SEGMENTS if 3 * n <= self.x.shape[1]]

    def _summaries(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(n) * self.x.shape[1] // n
        size = np.diff(np.append(starts, self.x.shape[1]))
        mean = np.add.reduceat(self.x, starts, axis=1) / size
        off = self.x - np.repeat(mean, size, axis=1)
        return mean * np.sqrt(size), np.sqrt(np.add.reduceat(off * off, starts, axis=1))


def _dots(a: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``a`` with rows ``j`` of ``r``; as one product of the matrices where most pairs are asked for."""
    if 8 * len(i) > len(a) * len(r):
        return (a @ r.T)[i, j]
    parts = [np.einsum("ij,ij->i", a[i[s:s + _PAIRS]], r[j[s:s + _PAIRS]]) for s in range(0, len(i), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _kth(shape: tuple[int, int], i: np.ndarray, j: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Per row of the tile the k-th largest value, minus infinity where it has fewer."""
    if shape[1] < k:
        return np.full(shape[0], -np.inf)
    full = np.full(shape, -np.inf)
    full[i, j] = value
    return np.partition(full, shape[1] - k, axis=1)[:, shape[1] - k]


def best_in_windows(a: Block, at: slice, r: Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per window (a column of ``low`` and ``high``): rows of the tile, rows of ``r`` and scores of each tile row's ``k`` best within it.

    Ties go to the smaller id.  A pair is given up only if its bounds place it outside of every window or below ``k`` others of the window.
    """
    i, j = np.nonzero(allowed)
    least = low.copy()
    for (ma, da), (mr, dr) in zip(a.levels, r.levels):
        middle = _dots(ma[at], mr, i, j)
        spread = _dots(da[at], dr, i, j) + _ROUNDING * a.norm[at][i] * r.norm[j] + 1e-6
        lower, upper = middle - spread, middle + spread
        open_ = np.zeros(len(i), bool)
        for w in range(low.shape[1]):
            inside = (lower >= low[i, w]) & (upper <= high[i, w])
            least[:, w] = np.maximum(least[:, w], _kth(allowed.shape, i[inside], j[inside], lower[inside], k))
            open_ |= (upper >= least[i, w]) & (lower <= high[i, w])
        i, j = i[open_], j[open_]
    score = _dots(a.x[at], r.x, i, j)
    out = []
    for w in range(low.shape[1]):
        inside = (score >= low[i, w]) & (score <= high[i, w])
        wi, wj, ws = i[inside], j[inside], score[inside]
        near = ws >= _kth(allowed.shape, wi, wj, ws, k)[wi]
        wi, wj, ws = wi[near], wj[near], ws[near]
        order = np.lexsort((r.ids[wj], -ws, wi))
        wi, wj, ws = wi[order], wj[order], ws[order]
        first = np.arange(len(wi)) - np.searchsorted(wi, wi) < k
        out.append((wi[first], wj[first], ws[first].astype(np.int64)))
    return out


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each anchor's ``k`` best other rows of its label in the block."""
    rows, anchors = rows.sort_by("label"), anchors.sort_by("label")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(rows) and len(anchors):
        labels, mine = rows["label"].to_numpy(), anchors["label"].to_numpy()
        for label in np.unique(mine):
            (lo, hi), (s, e) = np.searchsorted(labels, [label, label + 1]), np.searchsorted(mine, [label, label + 1])
            if lo == hi:
                continue
            a, r = Block(anchors.slice(s, e - s)), Block(rows.slice(lo, hi - lo))
            for t in range(0, e - s, TILE):
                at = slice(t, min(t + TILE, e - s))
                allowed = a.ids[at][:, None] != r.ids[None, :]
                everything = np.full((len(allowed), 1), np.inf)
                (i, j, score), = best_in_windows(a, at, r, allowed, -everything, everything, k)
                found.append((a.ids[at][i], r.ids[j], score))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("anchor", "positive", "positive_score"), columns)))


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive the ``k`` best rows of other labels within ``low`` to ``high`` hundredths of the positive's score."""
    found: list[tuple[np.ndarray, ...]] = []
    if len(rows) and len(anchors):
        a, r = Block(anchors), Block(rows)
        partners = anchors["positives"].to_pylist()
        width = max(len(p) for p in partners)
        for t in range(0, len(partners), TILE):
            at = slice(t, min(t + TILE, len(partners)))
            lows, highs = np.full((at.stop - t, width), np.inf), np.full((at.stop - t, width), -np.inf)
            for n, row in enumerate(partners[at]):
                for w, p in enumerate(row):
                    lows[n, w], highs[n, w] = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
            allowed = a.labels[at][:, None] != r.labels[None, :]
            for w, (i, j, score) in enumerate(best_in_windows(a, at, r, allowed, lows, highs, k)):
                of = [partners[t + n][w] for n in i]
                found.append((a.ids[at][i], np.array([p["positive"] for p in of], np.int64), np.array([p["positive_score"] for p in of], np.int64), r.ids[j], score))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
    return pa.table(dict(zip(("anchor", "positive", "positive_score", "negative", "negative_score"), columns)))


# -- the search --------------------------------------------------------------------------

def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v, dim): the rows that take part, with whole components floor(256 * x)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                          F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v")).filter("id is not null and label is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > float(1 << 26))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("long")))
    rows = rows.filter(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < LARGEST)
    one = rows.groupBy("id").agg(F.min(F.struct("label", F.transform("v", lambda x: x.cast("int")).alias("v"))).alias("r"))
    return one.select("id", "r.label", "r.v", F.size("r.v").alias("dim"))


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step`` of every block of anchors with every block of rows."""
    na, nr = blocks
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = anchors.withColumn("a_block", place(na, 1)).withColumn("r_block", each(nr)).groupBy("dim", "a_block", "r_block")
    right = rows.withColumn("r_block", place(nr, 2)).withColumn("a_block", each(na)).groupBy("dim", "a_block", "r_block")
    return left.cogroup(right).applyInArrow(step, schema)


def _ranked(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, block_rows: int = ROWS) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score): hard negatives of each anchor and positive.

    Scores are inner products of the components floor(256 * x).  ``anchor`` says of the column ``id`` which rows are anchors;
    ``label`` is a column of the input.  An anchor's positives are its ``positives`` best other rows of the same label; a negative has
    another label and a score between ``low`` and ``high`` hundredths of the positive's, both included; the ``negatives`` best are
    returned.  Ties go to the smaller id.  Rows with a null id, label, vector or component, with a non-finite component or a squared norm
    (of whole components) of 2**53 or more take no part; of rows with one id the one of the smallest label, then vector, does.  Vectors
    are compared with those of their own length.  Other columns are ignored; an empty table gives no rows.
    """
    rows = cut_lineage(prepared(vectors, id_col, vector_col, label))
    n, chosen, longest = rows.agg(F.count(F.lit(1)), F.count_if(anchor), F.max("dim")).first()
    most = max(64, COMPONENTS // max(1, longest or 1))
    blocks = max(1, -(-chosen // min(ANCHORS, most))), max(1, -(-n // min(block_rows, most)))
    anchors = rows.filter(anchor)
    near = _met(anchors, rows, blocks, lambda a, r: _positives(a, r, positives), "anchor long, positive long, positive_score long")
    pairs = _ranked(near, ["anchor"], "positive_score", "positive", positives)
    listed = pairs.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))).alias("positives"))
    known = cut_lineage(anchors.join(listed, "id"))
    schema = "anchor long, positive long, positive_score long, negative long, negative_score long"
    far = _met(known, rows, blocks, lambda a, r: _negatives(a, r, negatives, low, high), schema)
    return _ranked(far, ["anchor", "positive"], "negative_score", "negative", negatives).select(
        "anchor", "positive", "rank", "negative", "positive_score", "negative_score")
