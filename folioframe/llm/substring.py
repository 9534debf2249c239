"""Removal of word windows that an earlier document already has, with a count-min prefilter.

The count-min sketch is cut into slices, and both it and its windows grow with the corpus:

1. each chunk of documents sketches its windows: per slice the sorted counters that it raises (gap-coded, a counter
   raised by two or more documents twice);
2. one task a slice adds the chunks' counters up.  Counters may be shared by different windows, so counts are never too
   low; what comes back to a chunk is one bit per counter that it raised: is its total two or more?
3. the chunks hash their windows again and send on only those whose counter says "repeated": 96-bit hash and smallest
   doc_id, once per chunk, so that a window found in a third of all documents is one entry a chunk;
4. one task a slice groups equal windows and answers one bit per entry: has another chunk a smaller doc_id?
5. the chunks remove the words.

Documents are dealt to chunks once (the exchange is used three times); only bits travel back to them.  A slice holds as
many windows as a chunk, whatever their frequency.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.words import slabs

WINDOW = 13
CHUNK_BYTES = 8 << 20
CELLS = 64  # counters of the sketch for each byte / 6 of text, about one word: one window in 64 is passed on needlessly
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ESCAPE = 0xFFFF
_ROW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8")])
_PIECE = "chunk int, slice int, body binary"


def gap_code(cells: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit gaps; an escape stands for 65,535 and goes on."""
    gaps = np.diff(cells, prepend=cells.dtype.type(0))
    over = (gaps // _ESCAPE).astype(np.int64)
    ends = np.cumsum(over + 1)
    out = np.full(ends[-1] if len(ends) else 0, _ESCAPE, "<u2")
    out[ends - 1] = gaps % _ESCAPE
    return out.tobytes()


def gap_decode(body: bytes) -> np.ndarray:
    gaps = np.frombuffer(body, "<u2")
    return np.cumsum(gaps, dtype=np.uint64)[gaps != _ESCAPE]


class Chunk:
    """The windows of one chunk's documents; the same each time it is built from the same rows."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int, slices: int, cells: int):
        self.slabs = list(slabs(table[text_col]))
        ids = table[id_col].combine_chunks().cast(pa.int64())
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        first, doc, at, where = [], [], [], []
        for k, (row, words) in enumerate(self.slabs):
            h = words.window_hashes(window, _FIRST)
            start = np.flatnonzero(words.windows(window))
            text = row + words.text[start]
            use = known[text]
            first.append(h[use])
            doc.append(ids[text[use]])
            at.append(start[use])
            where.append(np.full(use.sum(), k, np.int32))
        self.h1, self.doc, self.at, self.slab = (np.concatenate(x) if x else np.zeros(0, t) for x, t in
                                                 ((first, np.uint64), (doc, np.int64), (at, np.int64), (where, np.int32)))
        self.slice = (self.h1 >> np.uint64(40)).astype(np.int64) % slices
        # The counter, unique over all slices so that one sort orders them by slice.
        self.cell = self.slice.astype(np.uint64) * np.uint64(cells) + self.h1 % np.uint64(cells)
        self.cells, self.slices, self.window = cells, slices, window

    def counters(self) -> tuple[np.ndarray, np.ndarray]:
        """The counters raised, and for each whether two or more documents raise it."""
        order = np.argsort(self.cell, kind="stable")
        cell, doc = self.cell[order], self.doc[order]
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            return cell, np.zeros(0, bool)
        twice = np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts)
        return cell[starts], twice

    def repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """The windows whose counter the slices found raised more than once."""
        cells, _ = self.counters()
        flag = _flags(cells // np.uint64(self.cells), bits, self.slices)
        return np.flatnonzero(flag[np.searchsorted(cells, self.cell)]) if len(cells) else np.zeros(0, np.int64)

    def second_hash(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chosen), np.uint32)
        for k, (_, words) in enumerate(self.slabs):
            mine = self.slab[chosen] == k
            if mine.any():
                h = words.window_hashes(self.window, _SECOND)
                rank = np.cumsum(words.windows(self.window)) - 1
                out[mine] = h[rank[self.at[chosen[mine]]]] >> np.uint64(32)
        return out

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct chosen windows ordered by slice and hash, their slices, and each chosen window's entry."""
        rows = np.empty(len(chosen), _ROW)
        rows["h1"], rows["h2"], rows["doc"] = self.h1[chosen], self.second_hash(chosen), self.doc[chosen]
        slices = self.slice[chosen]
        order = np.lexsort((rows["doc"], rows["h2"], rows["h1"], slices))
        rows, slices = rows[order], slices[order]
        new = _changes(rows)
        entry = np.empty(len(chosen), np.int64)
        entry[order] = np.cumsum(new) - 1
        return rows[new], slices[new], entry


def _changes(rows: np.ndarray) -> np.ndarray:
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
    return new


def _split(slices: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The stretch of each slice that occurs, in sorted ``slices``."""
    bounds = np.searchsorted(slices, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        yield int(k), slice(int(bounds[k]), int(bounds[k + 1]))


def _flags(slices: np.ndarray, bits: dict[int, bytes], n: int) -> np.ndarray:
    out = np.zeros(len(slices), bool)
    for k, part in _split(slices, n):
        out[part] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=part.stop - part.start)
    return out


def _pieces(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, part, body = zip(*rows) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "slice": pa.array(part, pa.int32()), "body": pa.array(body, pa.binary())})


def _add_up(pieces: pa.Table) -> pa.Table:
    """One slice of the sketch: which counters have a total of two or more."""
    chunks, (part, *_) = pieces["chunk"].to_pylist(), pieces["slice"].to_pylist()
    raised = [gap_decode(x) for x in pieces["body"].to_pylist()]
    cells, counts = np.unique(np.concatenate(raised), return_counts=True)
    many = cells[counts > 1]
    out = []
    for chunk, own in zip(chunks, raised):
        own = np.unique(own)
        out.append((chunk, part, np.packbits(np.isin(own, many, assume_unique=True)).tobytes()))
    return _pieces(out)


def _group(pieces: pa.Table) -> pa.Table:
    """Equal windows of one slice: which chunks' entries have a smaller doc_id elsewhere."""
    chunks, (part, *_) = pieces["chunk"].to_pylist(), pieces["slice"].to_pylist()
    sent = [np.frombuffer(x, _ROW) for x in pieces["body"].to_pylist()]
    rows = np.concatenate(sent)
    order = np.lexsort((rows["h2"], rows["h1"]))
    new = _changes(rows[order])
    lowest = np.minimum.reduceat(rows["doc"][order], np.flatnonzero(new))[np.cumsum(new) - 1]
    smaller = np.empty(len(rows), bool)
    smaller[order] = lowest < rows["doc"][order]
    ends = np.cumsum([len(x) for x in sent])
    return _pieces([(c, part, np.packbits(smaller[e - len(x):e]).tobytes()) for c, x, e in zip(chunks, sent, ends)])


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW,
                  chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one blank).

    A word (bytes other than blanks) goes if a window of ``window`` words covers it whose word sequence also starts in
    a document of smaller id.  Windows are judged on the input, so chains of copies keep exactly the first one.

    Null, empty and shorter texts have no windows and lose nothing (``kept_text`` of a null text is empty).  A row with a
    null id loses nothing and takes nothing from others.  Rows with the same id never take from each other.  Input columns of
    the result's names are replaced; other columns pass unchanged.  An empty table gives an empty result.  Windows are
    compared by 96 hash bits, whole texts are read.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "__chunk")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    chunks = slices = max(1, math.ceil(size / chunk_bytes))
    cells = max(1 << 10, CELLS * size // 6 // slices)
    dealt = docs.withColumn("__chunk", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int")).repartition(chunks, "__chunk")

    def number(table: pa.Table) -> int:
        return table["__chunk"][0].as_py()

    def build(table: pa.Table) -> Chunk:
        return Chunk(table, id_col, text_col, window, slices, cells)

    def sketch(table: pa.Table) -> pa.Table:
        chunk = build(table)
        cell, twice = chunk.counters()
        cell, part = np.repeat(cell, twice + 1), np.repeat(cell // np.uint64(cells), twice + 1)
        return _pieces([(number(table), k, gap_code(cell[s] - np.uint64(k * cells))) for k, s in _split(part, slices)])

    def answers(table: pa.Table, step: int) -> dict[int, bytes]:
        return {k: b for k, b, s in zip(table["slice"].to_pylist(), table["body"].to_pylist(), table["step"].to_pylist()) if s == step}

    def candidates(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _pieces([])
        chunk = build(table)
        rows, part, _ = chunk.entries(chunk.repeated(answers(back, 1)))
        return _pieces([(number(table), k, rows[s].tobytes()) for k, s in _split(part, slices)])

    def removed(table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = build(table)
        chosen = chunk.repeated(answers(back, 1))
        rows, part, entry = chunk.entries(chosen)
        smaller = _flags(part, answers(back, 2), slices)
        gone = chosen[smaller[entry] | (chunk.doc[chosen] > rows["doc"][entry])]
        n_words, n_removed, kept = [], [], []
        for k, (_, words) in enumerate(chunk.slabs):
            change = np.zeros(len(words.start) + 1, np.int32)
            at = chunk.at[gone[chunk.slab[gone] == k]]
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            stays = np.cumsum(change)[:-1] == 0
            lost = np.concatenate([[0], np.cumsum(~stays)])
            n_words.append(np.diff(words.bounds))
            n_removed.append(np.diff(lost[words.bounds]))
            kept.append(words.joined(stays))
        out = table.drop_columns(["__chunk"])
        return (out.append_column("n_words", pa.array(np.concatenate(n_words).astype(np.int64)) if n_words else pa.array([], pa.int64()))
                .append_column("n_removed", pa.array(np.concatenate(n_removed).astype(np.int64)) if n_removed else pa.array([], pa.int64()))
                .append_column("kept_text", pa.chunked_array(kept, pa.string())))

    by_chunk = dealt.groupBy("__chunk")
    raised = by_chunk.applyInArrow(sketch, _PIECE).repartition(slices, "slice")
    repeated = raised.groupBy("slice").applyInArrow(_add_up, _PIECE).withColumn("step", F.lit(1)).repartition(chunks, "chunk")
    sent = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(candidates, _PIECE).repartition(slices, "slice")
    smaller = sent.groupBy("slice").applyInArrow(_group, _PIECE).withColumn("step", F.lit(2)).repartition(chunks, "chunk")
    result = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])
    return by_chunk.cogroup(repeated.union(smaller).groupBy("chunk")).applyInArrow(removed, result)
