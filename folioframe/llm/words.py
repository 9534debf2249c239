"""Words of Arrow text batches as numpy arrays: bounds and hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SLAB = 1 << 20  # bytes of text handled at once; a longer text is a slab of its own
LONG = 64  # a word of more bytes is hashed by xxhash; a shorter one as a polynomial over its bytes

_U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


class Words:
    """Bounds of the words of some texts that lie one after another in ``data``; ``between`` marks the bytes between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK):
        self.data, self.offsets, self._totals = data, offsets, {}
        blank = np.concatenate([[True], between[data], [True]])
        first = blank[:-1].copy()
        first[offsets[:-1]] = True  # a text's first byte starts a word though the byte before it belongs to another
        last = blank[2:].copy()
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start = np.flatnonzero(first[:-1] & ~blank[1:-1])
        self.end = np.flatnonzero(last & ~blank[1:-1]) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # of each text's words
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self, base: int, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of every word, or of its ``first`` bytes; ``base`` (odd) chooses the function."""
        up, down = _powers(base, len(self.data) + 1)
        if base not in self._totals:
            self._totals[base] = np.zeros(len(self.data) + 1, _U)
            np.cumsum((self.data.astype(_U) + _U(1)) * up[:len(self.data)], out=self._totals[base][1:])
        total, end = self._totals[base], self.end if first is None else np.minimum(self.end, self.start + first)
        size = (end - self.start).astype(_U)
        out = mix((total[end] - total[self.start]) * down[self.start] + size * _U(base ^ 0x9E3779B97F4A7C14))
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i]:end[i]].tobytes(), seed=base & 0xFFFFFFFF)
        return out

    def per_text(self, x: np.ndarray) -> np.ndarray:
        """Sums of a word's values over each text."""
        total = np.concatenate([[0], np.cumsum(x)])[self.bounds]
        return total[1:] - total[:-1]

    def windows(self, n: int) -> np.ndarray:
        """Whether ``n`` words of one text start at each word."""
        return np.arange(len(self.start)) + n <= self.bounds[self.text + 1]

    def window_hashes(self, n: int, base: int) -> np.ndarray:
        """A hash of each window of ``n`` words, in the order of their first words (only those of ``windows``)."""
        h, ok = self.hashes(base), self.windows(n)
        if not ok.any():
            return np.zeros(0, _U)
        out = np.zeros(len(h) - n + 1, _U)
        for k in range(n):
            out = out * _U(base) + h[k:len(h) - n + 1 + k]
        self._totals.clear()  # a caller that keeps the words needs room rather than speed
        return mix(out[ok[:len(out)]])

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Per text, its kept words joined by one blank."""
        size = np.where(kept, self.end - self.start + 1, 0)  # each with the blank after it
        ends = np.cumsum(size)
        whole = ends[-1] if len(ends) else 0
        at = np.arange(whole) + np.repeat(self.start - (ends - size), size)
        out = np.full(whole + 1, 0x20, np.uint8)
        inside = np.ones(whole, bool)
        inside[ends[kept] - 1] = False
        out[:whole][inside] = self.data[at[inside]]
        cuts = np.concatenate([[0], ends])[self.bounds]
        body = out.tobytes()
        return pa.array([body[a:max(a, b - 1)].decode("utf-8") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())


def slabs(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, Words]]:
    """The texts (null: empty) in stretches of at most ``SLAB`` bytes, each with the number of its first text."""
    if isinstance(texts, pa.ChunkedArray):
        done = 0
        for chunk in texts.chunks:
            for at, words in slabs(chunk):
                yield done + at, words
            done += len(chunk)
        return
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLAB, "right")) - 1)
        yield at, Words(data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
        at = to
