"""Edit-distance helpers that need a full table: shared runs, common characters, line boundaries.

Each works on one pair of texts; Spark decides which pairs get here.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise, repeat
from operator import contains, length_hint

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _longest_run(a: str, b: str, least: int = 1) -> int:
    """Length of the longest common run, by halving over the length; 0 when it is under ``least``."""
    def shares(n: int) -> bool:
        grams = {b[i:i + n] for i in range(len(b) - n + 1)}
        return any(a[i:i + n] in grams for i in range(len(a) - n + 1))
    lo, hi = least, min(len(a), len(b))
    # A run of over half of a text covers its middle.
    if lo > hi or 2 * lo > len(a) and a[len(a) - lo:lo] not in b or not shares(lo):
        return 0
    while lo < hi:
        n = (lo + hi + 1) // 2
        if shares(n):
            lo = n
        else:
            hi = n - 1
    return lo


def _common(a: str, b: str) -> int:
    """Number of characters two texts share in order, one bit per character of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


TOGETHER, FEW_WORDS, ROOM = 512, 16, 32 << 20  # pairs that go through their letters together, 64-bit words of their texts, bytes of the places of their letters


def _commons(pairs: list[tuple[str, str]]) -> list[int]:
    """``_common`` of many pairs, those of like length together; long texts go one by one."""
    found = [0] * len(pairs)
    size = [max(len(a), len(b)) for a, b in pairs]
    order = sorted(range(len(pairs)), key=size.__getitem__)
    while order:
        group = [k for k in order[:TOGETHER] if size[k] <= size[order[0]] * 1.5 + 64]
        order = order[len(group):]
        words = max(len(pairs[k][1]) for k in group) + 63 >> 6
        some = _side_by_side([pairs[k] for k in group], words) if 0 < words <= FEW_WORDS and len(group) >= FEW else [_common(*pairs[k]) for k in group]
        for k, n in zip(group, some):
            found[k] = n
    return found


def _side_by_side(pairs: list[tuple[str, str]], words: int) -> list[int]:
    """``_common`` of pairs whose second texts take at most ``words`` words of bits each: a letter of all first texts at a time."""
    count = len(pairs)
    size_a, size_b = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    a, b = (_letters("".join(p[side] for p in pairs)) for side in (0, 1))
    known = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, bool)
    known[b] = True
    kinds = int(known.sum())
    if max(kinds, int(size_a.max(initial=0))) * count * words * 8 > ROOM and count > 1:
        half = count // 2
        return _side_by_side(pairs[:half], words) + _side_by_side(pairs[half:], words)
    number = np.where(known, np.cumsum(known) - 1, kinds)  # letters that no second text has share the last number
    def spots(sizes):
        of = np.repeat(np.arange(count), sizes)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of, column = spots(size_b)
    # Sums of different bits of half a word are exact.
    halves = np.bincount(((number[b] * count + of) * words * 2 + (column >> 5)), np.exp2(column & 31), (kinds + 1) * count * words * 2)
    places = halves.astype("<u4").view("<u8").reshape(-1, words)
    of, step = spots(size_a)
    letters = np.full((int(size_a.max(initial=0)), count), kinds)
    letters[step, of] = number[a]
    row = np.full((words, count), ~np.uint64(0))
    for mask in places[letters * count + np.arange(count)].transpose(0, 2, 1).copy():
        hit = row & mask
        total = row + hit
        carry = (total < hit)[:-1]
        while carry.any():
            total[1:] += carry
            carry &= total[1:] == 0
            carry = np.concatenate([np.zeros((1, count), bool), carry[:-1]])
        row = total | (row ^ hit)
    return np.bitwise_count(~row).sum(0, dtype=np.int64).tolist()


def match_share(line: str, text: str, floor: float = 0.0, common: int | None = None) -> float:
    """Share of ``line`` found in ``text``: its longest common run, or for long lines .9 of all characters in order.

    A share under ``floor`` may come back as 0.  ``common`` is the number of characters in order, where it is known.
    """
    if not line or not text:
        return 0.0
    if line in text:
        return 1.0
    common = (_common(line, text) if common is None else common) / len(line)
    if common < floor:  # a run is never longer than the characters in order
        return 0.0
    if len(line) < 12:
        return _longest_run(line, text) / len(line)
    # A run only counts from .6 on, or when it is longer than .9 of the characters in order.
    least = max(1, min(math.ceil(0.6 * len(line)), math.floor(0.9 * common * len(line))))
    run = _longest_run(line, text, least) / len(line)
    return run if run >= 0.6 else max(run, common * 0.9)


def match_score(line: Column, text: Column, floor: float = 0.0) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(lines: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([match_share(a, b, floor) for a, b in zip(lines, texts)], dtype="float64")
    # Not to be repeated by a filter on its result.
    return score.asNondeterministic()(line, text)


def match_scores(whose: pd.Series, lines: pd.Series, texts: pd.Series, lifts: pd.Series, floor: float = 0.0) -> pd.Series:
    """``match_share`` of some pairs, with 0 for those that cannot be the best of their owner (equal names in ``whose``).

    A pair's rank is its share plus its lift.  A null text is one that holds the line as it is.  Pairs of an owner are taken by falling lift, first one, then
    twice as many each time, so one that even a share of 1 would leave behind a pair seen before is not compared.
    """
    owner, lift = pd.factorize(whose)[0], lifts.to_numpy(dtype="float64")
    found = np.where(texts.isna(), 1.0, 0.0)
    best = np.full(owner.max(initial=-1) + 1, -np.inf)
    if 1.0 >= floor:
        np.fmax.at(best, owner[found > 0], 1.0 + lift[found > 0])
    left = np.flatnonzero(found == 0)
    left = left[np.lexsort((-lift[left], owner[left]))]
    many = 1
    while len(left := left[~(1.0 + lift[left] < best[owner[left]])]):
        first = np.flatnonzero(np.append(True, owner[left][1:] != owner[left][:-1]))
        nth = np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))
        now, left, many = left[nth < many], left[nth >= many], many * 2
        pairs = [(lines.iat[k], texts.iat[k]) for k in now.tolist()]
        found[now] = [match_share(*pair, floor, common) for pair, common in zip(pairs, _commons(pairs))]
        good = now[found[now] >= floor]
        np.fmax.at(best, owner[good], found[good] + lift[good])
    return pd.Series(found)


def best_match_score(whose: Column, line: Column, text: Column, lift: Column, floor: float = 0.0) -> Column:
    """``match_scores`` of the pairs of a batch; a pair that loses within its batch may come back as 0."""
    @F.pandas_udf(T.DoubleType())
    def score(owners: pd.Series, lines: pd.Series, texts: pd.Series, lifts: pd.Series) -> pd.Series:
        return match_scores(owners, lines, texts, lifts, floor)
    # Not to be repeated by a filter on its result.
    return score.asNondeterministic()(whose, line, text, lift)


BAND, KEPT = 64, 1024  # edits that the first band allows, and rows of the table that are held at once (more for very long texts)


def _table_rows(a: str, places: dict[str, int], n: int, band: int, state: tuple[int, int, int, int], start: int) -> Iterator[tuple]:
    """Rows of the edit table from ``a[start]`` on, each within ``band`` of its diagonal.

    A row is (first column, rises and falls of the row above, rises and falls against it, state); differences between neighbouring
    cells are bits.  What lies outside the band counts as one edit more than its neighbour, which is never too little.
    """
    low, base, up, down = state  # the row above: column before its first bit, value there, where it rises and falls
    for i in range(start + 1, len(a) + 1):
        width = min(n, i - 1 + band) - low
        if i - band > low:
            base += (up & 1) - (down & 1)
            up, down, low, width = up >> 1, down >> 1, low + 1, width - 1
        if i + band <= n:
            up, width = up | 1 << width, width + 1
        full = (1 << width) - 1
        hit = (places.get(a[i - 1], 0) >> low) & full
        flat = ((((hit & up) + up) ^ up) | hit | down) & full
        more, less = (down | ~(flat | up)) & full, flat & up
        above = up, down
        rise, fall = (more << 1 | 1) & full, less << 1 & full
        up, down = (fall | ~(flat | rise)) & full, rise & flat
        base += 1
        yield low, *above, more, less, (low, base, up, down)


def _banded_path(a: str, z: str, places: dict[str, int], band: int) -> dict[int, int] | None:
    """``edit_path`` if fewer than ``band`` edits are enough, else None.

    The way back needs every row once.  Rows are kept at even distances only and those between are made again, so memory
    grows with the square root of the text's length times the band.
    """
    m, n = len(a), len(z)
    if abs(m - n) >= band:
        return None
    step = max(KEPT, math.isqrt(m))
    state = 0, 0, (1 << min(n, band)) - 1, 0
    marks, held = [], []
    for i, row in enumerate(_table_rows(a, places, n, band, state, 0)):
        if i % step == 0:
            marks.append(state)
            held = []
        held.append(row)
        state = row[-1]
    low, base, up, down = state
    if base + up.bit_count() - down.bit_count() >= band:
        return None
    i, j = m, n
    ends = {i: j}
    while i:
        first = (i - 1) // step * step
        if i < m and i == first + step:  # the rows before a mark, from the mark before it
            held = list(_table_rows(a[:i], places, n, band, marks[first // step], first))
        while i > first:
            low, above_up, above_down, more, less, (_, _, up, _) = held[i - 1 - first]
            if j:
                bit = 1 << (j - 1 - low)
                change = bool(more & bit) - bool(less & bit) + bool(above_up & bit) - bool(above_down & bit)
                if change == (a[i - 1] != z[j - 1]):
                    i, j = i - 1, j - 1
                elif up & bit:
                    j -= 1
                else:
                    i -= 1
            else:
                i -= 1
            ends[i] = j
    ends[0] = 0
    return ends


def edit_path(a: str, z: str, most: float = math.inf) -> dict[int, int] | None:
    """For every prefix length of ``a`` the prefix length of ``z`` it is aligned with; None beyond ``most`` edits.

    Bands around the diagonal are widened until the least number of edits fits; the path inside such a band is that of the whole table.
    """
    places: dict[str, int] = {}
    for j, c in enumerate(z):
        places[c] = places.get(c, 0) | 1 << j
    most = math.floor(min(most, max(len(a), len(z))))
    # Every letter that one text has more often than the other is an edit: no fewer edits are possible.
    here, there = Counter(a), Counter(z)
    least = max((here - there).total(), (there - here).total())
    if least > most:
        return None
    band = max(BAND, least + 1)
    while True:
        ends = _banded_path(a, z, places, min(band, most + 1))
        if ends is not None or band > most:
            return ends
        band *= 2


GROUP, FEW, WIDE = 48 << 20, 10, 512  # bytes that a group's tables may take, texts that make a group worth it, columns that make counting worth it


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window(a: str, z: str, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of the table of a pair the 64-bit words (the first, and the one after the last) that hold all paths of fewer than ``band`` edits.

    Such a path leaves the diagonals of its ends by half of what the difference in length leaves over, at most.  Where that is wide, letters are counted
    at the corners of a grid: those that one side has more often before a corner, and after it, are edits of every path through it.  A step
    changes that number by two at most, so what lies around a corner of too many such edits is left out.
    """
    m, n = len(a), len(z)
    words, apart = max(1, -(-n // 64)), n - m
    slack = max(0, band - 1 - abs(apart)) // 2
    left, right = slack + max(0, -apart), slack + max(0, apart)
    rows = np.arange(1, m + 1)
    first, last = (rows - left - 1) // 64, (rows + right - 1) // 64 + 1
    if m and left + right > WIDE:
        codes = [_letters(t) for t in (a, z)]
        kinds = np.unique(np.concatenate(codes))
        at = [np.minimum(np.arange(len(c) // 64 + 2) * 64, len(c)) for c in codes]
        here = np.arange(len(at[0]))[:, None]
        there = np.clip(here + np.arange(-left // 64 - 1, right // 64 + 2), 0, len(at[1]) - 1)
        before, after = np.zeros(there.shape, np.int32), np.zeros(there.shape, np.int32)
        classes = [np.searchsorted(kinds, c) % 64 for c in codes]
        for k in range(min(64, len(kinds))):
            upto = [np.concatenate([[0], np.cumsum(c == k, dtype=np.int32)]) for c in classes]
            more = upto[0][at[0]][:, None] - upto[1][at[1]][there]
            before += np.maximum(more, 0)
            after += np.maximum(upto[0][-1] - upto[1][-1] - more, 0)
        column = at[1][there]
        shift = column - at[0][:, None]
        likely = before + np.maximum(shift, 0) + after + np.maximum(apart - shift, 0) - 128 < band
        low, high = np.where(likely, column, n + 1).min(1) - 32, np.where(likely, column, -1).max(1) + 32
        first = np.maximum(first, (np.minimum(low[rows // 64], low[rows // 64 + 1]) - 1) // 64)
        last = np.minimum(last, (np.maximum(high[rows // 64], high[rows // 64 + 1]) - 1) // 64 + 1)
    first = np.minimum.accumulate(np.clip(first, 0, words - 1)[::-1])[::-1]
    last = np.maximum.accumulate(np.maximum(np.clip(last, 1, words), first + 1))
    return first, last


def _group_rows(pairs: list[tuple[str, str]], windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edit tables of some pairs, row by row for all of them at once.

    A row has the words that any pair's window has.  Returned are the first of them and the one after the last,
    and by row, word and pair the bits of the cells that equal the one before them on their diagonal, and of those one more than the cell to their left.
    As in ``_table_rows``, what lies outside counts as one edit more than its neighbour.
    """
    count, m = len(pairs), max(len(a) for a, _ in pairs)
    words = max(1, -(-max(len(z) for _, z in pairs) // 64))
    # Which columns hold a letter, a word for each pair, letter of the pair and 64 columns; the last letter of each pair is one that it lacks.
    places, at, offset = [], np.empty((m, count), np.int64), 0
    for k, (a, z) in enumerate(pairs):
        z_codes, a_codes = _letters(z), _letters(a)
        letters, ids = np.unique(z_codes, return_inverse=True)
        table = np.zeros((len(letters) + 1) * words, np.uint64)
        column = np.arange(len(z_codes))
        place = ids * words + column // 64
        order = np.argsort(place, kind="stable")
        bits = np.left_shift(np.uint64(1), (column % 64).astype(np.uint64))[order]
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        if len(starts):
            table[place[order][starts]] = np.bitwise_or.reduceat(bits, starts)
        spot = np.searchsorted(letters, a_codes)
        known = np.append(letters, np.uint32(0))[spot] == a_codes
        at[:, k] = offset + len(letters) * words
        at[:len(a), k] = offset + np.where(known & (spot < len(letters)), spot, len(letters)) * words
        places.append(table)
        offset += len(table)
    places = np.concatenate(places)
    # After its last row a pair asks for nothing more, and the windows of all only move on.
    first, last = np.full(m, words - 1), np.ones(m, np.int64)
    for low, high in windows:
        first[:len(low)] = np.minimum(first[:len(low)], low)
        last[:len(high)] = np.maximum(last[:len(high)], high)
    first, last = np.minimum.accumulate(first[::-1])[::-1], np.maximum.accumulate(last)
    width = int((last - first).max(initial=1))
    flats, ups = np.zeros((m, width, count), np.uint64), np.zeros((m, width, count), np.uint64)
    one, top, every = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)
    low, high = 0, int(last[0]) if m else 1
    up, down = np.full((high, count), every), np.zeros((high, count), np.uint64)
    for i in range(m):
        if last[i] > high or first[i] > low:
            grown, skipped = int(last[i]) - high, int(first[i]) - low
            up = np.concatenate([up[skipped:], np.full((grown, count), every)])
            down = np.concatenate([down[skipped:], np.zeros((grown, count), np.uint64)])
            low, high = int(first[i]), int(last[i])
        hit = places[at[i] + np.arange(low, high)[:, None]]
        part = hit & up
        total = part + up
        carry = (total < part)[:-1]
        while carry.any():
            total[1:] += carry
            carry &= total[1:] == 0
            carry = np.concatenate([np.zeros((1, count), bool), carry[:-1]])
        flat = (total ^ up) | hit | down
        more, less = down | ~(flat | up), flat & up
        rise, fall = more << one, less << one
        rise[1:] |= more[:-1] >> top
        fall[1:] |= less[:-1] >> top
        rise[0] |= one
        up, down = fall | ~(flat | rise), rise & flat
        flats[i, :high - low], ups[i, :high - low] = flat, up
    return first, last, flats, ups


def _pair_rows(a: str, z: str, window: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], list[int], list[int], list[int]]:
    """``_group_rows`` of one pair, where a row is one number."""
    places: dict[str, int] = {}
    for j, c in enumerate(z):
        places[c] = places.get(c, 0) | 1 << j
    first, last = window[0].tolist(), window[1].tolist()
    low, high = 0, last[0] if a else 1
    up, down, full = (1 << 64 * high) - 1, 0, (1 << 64 * high) - 1
    hits = {c: places[c] & full for c in places}
    flats, ups = [], []
    for c, begin, end in zip(a, first, last):
        if begin > low or end > high:
            up = (up | (1 << 64 * (end - low)) - (1 << 64 * (high - low))) >> 64 * (begin - low)
            down >>= 64 * (begin - low)
            low, high = begin, end
            full = (1 << 64 * (high - low)) - 1
            hits = {x: places[x] >> 64 * low & full for x in places}
        hit = hits.get(c, 0)
        flat = ((((hit & up) + up) ^ up) | hit | down) & full
        more, less = down | full & ~(flat | up), flat & up
        rise, fall = more << 1 | 1, less << 1
        up, down = (fall | ~(flat | rise)) & full, rise & flat
        flats.append(flat)
        ups.append(up)
    return first, last, flats, ups


def _way_back(a: str, z: str, first: list[int], last: list[int], flat: Callable[[int, int], int], up: Callable[[int, int], int], band: int) -> dict[int, int] | None:
    """The path of one pair through its rows, as ``edit_path`` has it; None if it takes ``band`` edits or leaves the rows, as then no path takes fewer.

    ``flat`` and ``up`` give the bits of a row from a place on, counted from the row's first word.
    """
    i, j, edits, ends = len(a), len(z), 0, {len(a): len(z)}
    while i:
        while i and j and a[i - 1] == z[j - 1]:
            i, j = i - 1, j - 1
            ends[i] = j
        if not i:
            break
        edits += 1
        if edits >= band:
            return None
        if j:
            if not first[i - 1] <= j - 1 >> 6 < last[i - 1]:
                return None
            place = j - 1 - 64 * first[i - 1]
            if not flat(i - 1, place) & 1:
                i, j = i - 1, j - 1
            elif up(i - 1, place) & 1:
                j -= 1
            else:
                i -= 1
        else:
            i -= 1
        ends[i] = j
    ends[0] = 0
    return ends if edits + j < band else None


def edit_paths(pairs: list[tuple[str, str]], most: list[float]) -> list[dict[int, int] | None]:
    """``edit_path`` of many pairs: those of like length and window go through their tables together, a row of all of them at a time.

    Small groups go through them one by one, and pairs whose rows ask for too much room leave the rest to ``edit_path``.
    """
    found: list[dict[int, int] | None] = [None] * len(pairs)
    open_ = []
    for k, ((a, z), limit) in enumerate(zip(pairs, most)):
        limit = math.floor(min(limit, max(len(a), len(z))))
        here, there = Counter(a), Counter(z)
        least = max((here - there).total(), (there - here).total())
        if least <= limit:
            open_.append((k, max(BAND, least + 1), limit))

    while open_:
        sized = []
        for k, band, limit in open_:
            a, z = pairs[k]
            window = _window(a, z, band := min(band, limit + 1))
            width = int((window[1] - window[0]).max(initial=1))
            # Room for the rows, for the places of the letters, and to name them.
            room = len(a) * (width * 16 + 8) + (len(z) // 64 + 1) * 8 * (len(set(z)) + 1)
            sized.append((width, len(a), k, band, limit, room, window))
        # Wide and narrow windows apart, then by length.
        sized.sort(key=lambda x: (x[0].bit_length(), x[1], x[2]))
        groups: list[list] = []
        for x in sized:
            group = groups[-1] if groups else None
            near = group and x[0].bit_length() == group[0][0].bit_length() and x[1] <= group[0][1] * 1.25 + 64
            if near and max(x[5], group[-1][5]) * (len(group) + 1) <= GROUP:
                group.append(x)
            else:
                groups.append([x])
        open_ = []
        for group in groups:
            if group[0][5] > 4 * GROUP:
                for x in group:
                    found[x[2]] = edit_path(*pairs[x[2]], x[4])
                continue
            if many := len(group) >= FEW:
                first, last, flats, ups = _group_rows([pairs[x[2]] for x in group], [x[6] for x in group])
                first, last = first.tolist(), last.tolist()
            for n, (_, _, k, band, limit, _, window) in enumerate(group):
                if many:
                    flat, up = (lambda i, p, t=t, n=n: int(t[i, p >> 6, n]) >> (p & 63) for t in (flats, ups))
                else:
                    first, last, *tables = _pair_rows(*pairs[k], window)
                    flat, up = (lambda i, p, t=t: t[i] >> p for t in tables)
                found[k] = _way_back(*pairs[k], first, last, flat, up, band)
                if found[k] is None and band <= limit:
                    open_.append((k, band * 2, limit))
    return found


def _left_out(read: list[str], z: str) -> list[int] | None:
    """``line_ends`` of a reading that leaves out letters and does nothing else; None for any other.

    It takes as many edits as the lengths are apart, so on the way back letters of ``z`` are passed over until one is the next of the reading.
    """
    rest, ends, same = iter(z[::-1]), [], 0
    for line in reversed(read):
        same += 1
        if line:
            if line[-1] not in rest:
                return None
            ends += [length_hint(rest) + 1] * same
            same = 0
            if not all(map(contains, repeat(rest), line[-2::-1])):
                return None
    return [*[0] * same, *ends[::-1]][:-1]


def _by_counts(a: str, z: str, borders: list[int], more: dict[str, int], over: int, under: int) -> list[int] | None:
    """Where ``edit_path`` has the prefix lengths ``borders`` of ``a``, if no more edits are needed than letter counts ask for; None if more are.

    ``more`` tells how much more often ``a`` has a letter than ``z``, ``over`` and ``under`` are the sums of what is above and below 0.
    Of the steps of the way back, in their order, the first is taken that leaves prefixes whose counts do not ask for more edits than are left.
    If that comes to the start with as many edits as the counts of the whole texts ask for, no path is shorter, so each step was that of ``edit_path``.
    """
    here, there = iter(a[::-1]), iter(z[::-1])
    left, shift = max(over, under), len(z) - len(a)
    turns, shifts = [-len(a)], [shift]  # from these lengths of ``a`` (negative) down, those of ``z`` are longer by so much
    for x, y in zip(here, there):
        while x != y:
            left -= 1
            this, that = more.get(x, 0), more.get(y, 0)
            over_x, under_x = (over - 1, under) if this > 0 else (over, under + 1)
            over_y, under_y = (over, under - 1) if that < 0 else (over + 1, under)
            if over_x + over_y - over <= left and under_x + under_y - under <= left:
                more[x], more[y] = this - 1, that + 1
                over, under = over_x + over_y - over, under_x + under_y - under
                break
            if over_y <= left and under_y <= left:
                more[y], over, under, shift = that + 1, over_y, under_y, shift - 1
                turns.append(-1 - length_hint(here))
                y = next(there, None)
            elif over_x <= left and under_x <= left:
                more[x], over, under, shift = this - 1, over_x, under_x, shift + 1
                turns.append(-length_hint(here))
                x = next(here, None)
            else:
                return None
            shifts.append(shift)
            if x is None or y is None:
                break
    if left != abs(shift):  # what one text has left when the other is at its start
        return None
    return [k and max(0, k + shifts[bisect.bisect_right(turns, -k) - 1]) for k in borders]


def line_ends(reads: list[list[str]], cleans: list[str], ratio: float = math.inf) -> list[list[int] | None]:
    """For the end of every line but the last how many letters of the clean text are before it, by ``edit_path``; None if more than ``ratio`` of the longer text differs.

    Texts have no blanks.  Only where neither omissions nor letter counts tell the path are tables of edits made.
    """
    found: list[list[int] | None] = [None] * len(reads)
    open_ = []
    for n, (read, z) in enumerate(zip(reads, cleans)):
        a, borders = "".join(read), [*accumulate(map(len, read))][:-1]
        longest = max(len(a), len(z))
        most = longest and ratio * longest
        if 0 <= len(z) - len(a) <= most and (ends := _left_out(read, z)) is not None:
            found[n] = ends
            continue
        here, there = Counter(a), Counter(z)
        over, under = (here - there).total(), (there - here).total()
        if max(over, under) <= most:
            here.subtract(there)
            found[n] = _by_counts(a, z, borders, here, over, under)
            if found[n] is None:
                open_.append((n, a, z, most, borders))
    paths = edit_paths([(a, z) for _, a, z, _, _ in open_], [most for _, _, _, most, _ in open_])
    for (n, _, _, _, borders), path in zip(open_, paths):
        found[n] = path and [path[k] for k in borders]
    return found


BLANKS = np.array([chr(c).isspace() for c in range(0x3002)])  # the last one stands for all letters from there on


def cut_texts(cleans: list[str], readings: list[list[str]], ratio: float = math.inf) -> list[list[str] | None]:
    """Clean texts cut at the line boundaries of noisy readings of them; None where they are too far apart.

    Each boundary is taken to the place among the clean text's letters that the alignment gives it; blanks stay with the line before.
    """
    texts = [clean.replace("\n", "") for clean in cleans]
    bare = ["".join(text.split()) for text in texts]
    out = []
    for ends, text, letters in zip(line_ends([["".join(line.split()) for line in lines] for lines in readings], bare, ratio), texts, bare):
        if ends and len(letters) < len(text):
            places = np.append(np.flatnonzero(~BLANKS[np.minimum(_letters(text), len(BLANKS) - 1)]), len(text))
            ends = places[ends].tolist()
        out.append(None if ends is None else [text[i:j] for i, j in pairwise([0, *ends, len(text)])])
    return out


def cut_lines(clean: str, lines: list[str], ratio: float = math.inf) -> list[str] | None:
    """``cut_texts`` for one text."""
    return cut_texts([clean], [lines], ratio)[0]


def line_texts(clean: Column, lines: Column, ratio: float) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series, readings: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        asked = [k for k, (c, l) in enumerate(zip(texts, readings)) if c is not None and l is not None]
        for some in range(0, len(asked), 1000):
            at = asked[some:some + 1000]
            for k, cut in zip(at, cut_texts([texts[k] for k in at], [list(readings[k]) for k in at], ratio)):
                out[k] = cut
        return out
    # Not to be repeated by a filter on its result.
    return cut.asNondeterministic()(clean, lines)


def reading_gate(clean: Column, joined: Column, ratio: float, limit: int | None) -> Column:
    """Why a noisy reading cannot be aligned, by the lengths alone (both without blanks); null where it may be."""
    longest = F.greatest(F.length(clean), F.length(joined))
    apart = F.abs(F.length(clean) - F.length(joined)) > longest * ratio
    return F.when(clean.isNull() | joined.isNull() | (longest == 0), "empty").when(F.lit(False) if limit is None else longest > limit, "long").when(apart, "far")
