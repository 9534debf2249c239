"""Answer choices of exercise pages, read by the layout of the page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .islands import BAND, ISLAND, _cut, each_group, each_island
from .lineage import cut_lineage
from .ordered import Ordered, null_safe

# Height of a row, letters that make a row of choices, blanks, and what numbers and letters look like.
ROW, ACROSS = 0.007, 3
_BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]*"
_NUMBER = rf"^{_BLANK}(\d+){_BLANK}[.．]{_BLANK}"
ANCHOR, LETTER, HEADER, DASH = rf"{_NUMBER}A", rf"^{_BLANK}(?:\d+{_BLANK}[.．]{_BLANK})?([ABCD]){_BLANK}", rf"^{_BLANK}(\d+)[.．]{_BLANK}(?![ABCD])", "^[一_—-]$"


def _found(text: Column, pattern: str) -> Column:
    """The first group where the pattern matches, else null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with (band, row): from the top, a line joins a row whose first line is less than ``ROW`` above it."""
    banded = _cut(lines.withColumn("__size", F.lit(0.0)), keys, "__y", "__size", ROW, ["__x", "__t"], BAND).withColumn(ISLAND, F.lit(0))

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        y, row = table["__y"].to_numpy(), np.zeros(len(table), np.int64)
        for a, b in zip(starts, [*starts[1:], len(table)]):
            first, n = y[a], 0
            for i in range(a, b):
                if y[i] - first >= ROW:
                    first, n = y[i], n + 1
                row[i] = n
        return table.append_column("__row", pa.array(row))

    schema = T.StructType([*banded.schema.fields, T.StructField("__row", T.LongType())])
    return cut_lineage(each_island(banded, keys, [F.col("__y"), F.col("__x"), F.col("__t")], work, schema))


def _parts(lines: DataFrame, row: list[str], part: list[str]) -> DataFrame:
    """In each row, from left to right: a letter opens an answer and the lines after it join it; lines before the first letter are left out."""
    w = Window.partitionBy(*row).orderBy("__x", "__y", "__t").rowsBetween(Window.unboundedPreceding, 0)
    opened = lines.withColumn("__n", F.sum(F.col("__letter").isNotNull().cast("int")).over(w)).filter("__n > 0")
    return _joined(opened, [*row, "__n"], part)


def _joined(lines: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """One answer per ``keys``: its only line with a letter gives the letter."""
    pieces = F.array_sort(F.collect_list(F.struct("__x", "__y", "__t", F.coalesce("__rest", "__t").alias("p"))))
    done = lines.groupBy(*dict.fromkeys([*part, *keys]), "__q").agg(F.min("__letter").alias("letter"), F.array_join(F.transform(pieces, lambda p: p["p"]), "").alias("answer"),
                                                                   F.count(F.lit(1)).alias("pieces"))
    return done.select(*part, F.col("__q").alias("question"), "letter", "answer", "pieces")


LONG_PAGE = 4_096  # lines of a page that one task reads; lines of longer pages meet by rows
PAIRS = 1 << 18  # lines beside anchors that are put together at a time, one answer at least


def page_choices(lines: DataFrame, part: list[str], text: str, x: str, y: str) -> DataFrame:
    """Question, letter, answer and number of pieces of the choices of each page (``part``).

    A line ``1. A ...`` is an anchor.  Without anchors, a row with a numbered line that goes on without a letter sets the question of the rows below
    it.  If ``ACROSS`` letters stand beside an anchor, the answers of a question run across the anchor's row.  Otherwise they run down one or two
    columns, divided in the middle between the outermost anchors, one answer a row, and an anchor sets the question of the rows below it.
    A question can have several answers of one letter.  Lines without a text or a finite place are left out.
    Pages of up to ``LONG_PAGE`` lines are read whole, in one shuffle of the lines.
    """
    lines = lines.filter(F.col(text).isNotNull() & (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))).select(
        *part, F.col(text).alias("__t"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    long = cut_lineage(lines.groupBy(*part).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LONG_PAGE))
    if long.isEmpty():
        return _short_page_choices(lines, part)
    of = lambda how: lines.alias("l").join(long.alias("r"), null_safe("l", "r", part), how)
    return _short_page_choices(of("left_anti"), part).unionByName(_long_page_choices(of("left_semi"), part))


def _marks() -> list[Column]:
    """Of each line its letter, the text after the letter, and its number as an anchor and as a header."""
    t = F.col("__t")
    letter = _found(t, LETTER)
    return [letter.alias("__letter"), F.when(letter.isNotNull(), F.regexp_replace(t, LETTER, "")).alias("__rest"),
            _found(t, ANCHOR).cast("long").alias("__anchor"), _found(t, HEADER).cast("long").alias("__header")]


def _search(low: np.ndarray, high: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """In each range of places the first one for which ``holds(range, place)`` is true, else its end; after a true one all are."""
    low, high = low.copy(), high.copy()
    while (k := np.flatnonzero(low < high)).size:
        middle = (low[k] + high[k]) // 2
        yes = holds(k, middle)
        high[k[yes]] = middle[yes]
        low[k[~yes]] = middle[~yes] + 1
    return low


def _short_page_choices(lines: DataFrame, part: list[str]) -> DataFrame:
    """``page_choices`` of whole pages, many pages at a time."""
    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        n, pages = len(table), len(starts)
        stops = np.append(starts[1:], n)
        of = np.repeat(np.arange(pages), stops - starts)
        x, y, dash = (table[c].to_numpy() for c in ("__x", "__y", "__dash"))
        t, rest = (table[c].combine_chunks() for c in ("__t", "__rest"))
        texts = pa.concat_arrays([pc.coalesce(rest, t), t])  # of each line, as a letter's and as it is
        lettered, anchored, headed = (pc.is_valid(table[c]).to_numpy() for c in ("__letter", "__anchor", "__header"))
        anchor, header = (pc.fill_null(table[c], 0).to_numpy() for c in ("__anchor", "__header"))

        def answers(line: np.ndarray, begin: np.ndarray, question: np.ndarray, opening: np.ndarray, plain: np.ndarray | int = 0) -> pa.Table:
            """Answers that begin at places of ``line``, with the letters of the lines ``opening``."""
            pieces = pa.ListArray.from_arrays(pa.array(np.append(begin, len(line)), pa.int32()), texts.take(pa.array(line + n * plain)))
            at = pa.array(opening)
            return pa.table({**{c: table[c].take(at) for c in part}, "question": pa.array(question, pa.int64()), "letter": table["__letter"].take(at),
                             "answer": pc.binary_join(pieces, ""), "pieces": pa.array(np.diff(np.append(begin, len(line))), pa.int64())})

        # Anchors alike in place and text are one, which meets each line as often as it comes.
        a = np.flatnonzero(anchored)
        fresh = np.ones(len(a), bool)
        if len(a) > 1:
            b, c = a[:-1], a[1:]
            fresh[1:] = (of[b] != of[c]) | (x[b] != x[c]) | (y[b] != y[c]) | ~pc.equal(t.take(pa.array(b)), t.take(pa.array(c))).to_numpy(zero_copy_only=False)
        times = np.diff(np.append(np.flatnonzero(fresh), len(a)))
        a = a[fresh]
        page = of[a]
        low = _search(starts[page], a, lambda k, m: y[a[k]] - y[m] < ROW)
        high = _search(a + 1, stops[page], lambda k, m: y[m] - y[a[k]] >= ROW)
        letters = np.append(0, np.cumsum(lettered))
        across, listed = np.zeros(pages, bool), np.zeros(pages, bool)
        listed[page] = True
        across[page[(letters[high] - letters[low]) * times >= ACROSS]] = True

        k = np.flatnonzero(across[page])
        weight = 1 + pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64) // 256
        filled = np.append(0, np.cumsum(weight))
        filled = np.cumsum(filled[high[k]] - filled[low[k]]) // PAIRS
        for k in np.split(k, np.flatnonzero(np.diff(filled)) + 1) if len(k) else []:
            count = high[k] - low[k]
            first = np.cumsum(count) - count
            which = np.repeat(np.arange(len(k)), count)
            line = np.arange(len(which)) + (low[k] - first)[which]
            line = line[np.lexsort((line, x[line], which))]  # lines come by y, x and text
            seen = np.cumsum(lettered[line])
            kept = seen > (seen[first] - lettered[line[first]])[which]
            line, which = line[kept], which[kept]
            begin = np.flatnonzero(lettered[line])
            cut = begin[1:][np.diff(np.cumsum(weight[line] * times[k][which])[begin] // PAIRS) > 0]
            for line, which in zip(np.split(line, cut), np.split(which, cut)):
                line, which = (np.repeat(v, times[k][which]) for v in (line, which))
                begin = np.flatnonzero(lettered[line])
                yield answers(line, begin, anchor[a[k]][which[begin]], line[begin])

        line = np.flatnonzero(~across[of])
        if not len(line):
            return
        tenth = np.clip(np.floor(x[a] * 10 + 0.5), -2.0 ** 63, 2.0 ** 63) / 10
        left, right = np.full(pages, np.inf), np.full(pages, -np.inf)
        np.minimum.at(left, page, tenth)
        np.maximum.at(right, page, tenth)
        middle = np.ones(pages)
        two = right > left
        middle[two] = (left[two] + right[two]) / 2
        side = np.where(listed[of[line]], np.where(x[line] < middle[of[line]], 1, 2), 0)
        order = np.lexsort((side, of[line]))
        line, side = line[order], side[order]
        new = np.append(True, (np.diff(of[line]) != 0) | (np.diff(side) != 0))
        column, stop = np.cumsum(new) - 1, np.append(np.flatnonzero(new)[1:], len(line))
        end, down = stop[column], y[line]
        below = _search(np.arange(1, len(line) + 1), end, lambda k, m: down[m] - down[k] >= ROW)
        tops, at = np.zeros(len(line), bool), np.flatnonzero(new)
        while len(at):
            tops[at] = True
            at = below[at][below[at] < end[at]]
        top, row = np.flatnonzero(tops), np.cumsum(tops) - 1
        column, side = column[top], side[top]
        line = line[np.lexsort((line, x[line], row))]
        place = np.arange(len(line))
        head, start = (np.minimum.reduceat(np.where(has[line], place, len(line)), top) for has in (headed, lettered))
        has_head, has_start = head < len(line), start < len(line)
        opening = line[np.where(has_start, start, 0)]
        sets = np.where(side == 0, has_head, has_start & anchored[opening])
        number = np.where(side == 0, header[line[np.where(has_head, head, 0)]], anchor[opening])
        last = np.maximum.accumulate(np.where(sets, np.arange(len(top)), -1))
        asked = last >= np.searchsorted(column, column)
        question = number[last]

        under = np.flatnonzero((asked & (side == 0) & ~has_head)[row] & (place >= start[row]))
        begin = under[lettered[line[under]]]
        if len(under):
            yield answers(line[under], np.flatnonzero(lettered[line[under]]), question[row[begin]], line[begin])
        taken = np.flatnonzero((asked & (side > 0) & has_start)[row] & (x[line] >= x[opening][row]) & ~dash[line])
        if len(taken):
            row, line = row[taken], line[taken]
            begin = np.flatnonzero(np.append(True, np.diff(row) != 0))
            # Only the row's first letter counts; a later one is text of the same answer.
            first = lettered[line] & (x[line] == x[opening[row]]) & (y[line] == y[opening[row]])
            first[first] = pc.equal(t.take(pa.array(line[first])), t.take(pa.array(opening[row[first]]))).to_numpy(zero_copy_only=False)
            yield answers(line, begin, question[row[begin]], opening[row[begin]], ~first)

    schema = T.StructType([*[lines.schema[c] for c in part], T.StructField("question", T.LongType()), T.StructField("letter", T.StringType()),
                           T.StructField("answer", T.StringType()), T.StructField("pieces", T.LongType())])
    sent = [*part, "__t", "__x", "__y", *_marks(), F.col("__t").rlike(DASH).alias("__dash")]
    return each_group(lines, part, [F.col("__y"), F.col("__x"), F.col("__t")], work, schema, sent)


def _long_page_choices(lines: DataFrame, part: list[str]) -> DataFrame:
    """``page_choices`` without a task that holds a page."""
    marked = lines.select(*part, "__t", "__x", "__y", *_marks())
    marked = cut_lineage(marked.withColumn("__cell", F.floor(F.col("__y") / ROW)))

    anchors = marked.filter("__anchor IS NOT NULL").withColumn("__id", F.struct("__x", "__y", "__t"))
    beside = (anchors.select(*part, F.col("__id"), F.col("__y").alias("__ay"), F.col("__anchor").alias("__q"), F.explode(F.array(*[F.col("__cell") + i for i in (-1, 0, 1)])).alias("__cell"))
              .alias("a").join(marked.alias("l"), null_safe("a", "l", [*part, "__cell"]))
              .filter(F.abs(F.col("__y") - F.col("__ay")) < ROW).select("l.*", "a.__id", "a.__q"))
    across = beside.filter("__letter IS NOT NULL").groupBy(*part, "__id").agg(F.count(F.lit(1)).alias("__n"))
    tenth = F.floor(F.col("__x") * 10 + 0.5) / 10
    layout = (anchors.groupBy(*part).agg(F.min(tenth).alias("__lo"), F.max(tenth).alias("__hi")).alias("l")
              .join(across.groupBy(*part).agg(F.max("__n").alias("__n")).alias("r"), null_safe("l", "r", part), "left")
              .select("l.*", (F.coalesce("r.__n", F.lit(0)) >= ACROSS).alias("__across")))
    layout = cut_lineage(layout.withColumn("__mid", F.when(F.col("__hi") > F.col("__lo"), (F.col("__lo") + F.col("__hi")) / 2).otherwise(1.0)))
    placed = marked.alias("l").join(layout.alias("r"), null_safe("l", "r", part), "left").select("l.*", "r.__across", "r.__mid")

    rows_across = beside.alias("l").join(layout.filter("__across").alias("r"), null_safe("l", "r", part), "left_semi")
    side_by_side = _parts(rows_across, [*part, "__id"], part)

    down = placed.filter("__across IS NULL OR NOT __across").withColumn("__col", F.when(F.col("__mid").isNull(), 0).when(F.col("__x") < F.col("__mid"), 1).otherwise(2))
    column = [*part, "__col"]
    row = [*column, BAND, "__row"]
    lined = _rows(down, column)
    at = F.struct("__x", "__y", "__t")
    heads = lined.groupBy(*row).agg(F.min_by("__header", F.when(F.col("__header").isNotNull(), at)).alias("__head"),
                                    F.min(F.when(F.col("__letter").isNotNull(), at)).alias("__start"),
                                    F.min_by("__anchor", F.when(F.col("__letter").isNotNull(), at)).alias("__number"))
    heads = cut_lineage(heads.withColumn("__sets", F.when(F.col("__col") == 0, F.col("__head")).otherwise(F.col("__number"))))
    asked = Ordered(heads, column, [BAND, "__row"]).add(__q=("last", "__sets")).done()
    told = (lined.alias("l").join(asked.alias("r"), null_safe("l", "r", row)).select("l.*", "r.__head", "r.__start", "r.__q").filter("__q IS NOT NULL"))
    under = _parts(told.filter("__col = 0 AND __head IS NULL"), row, part)
    first = F.struct("__x", "__y", "__t") == F.col("__start")
    listed = told.filter("__col > 0 AND __start IS NOT NULL").filter((F.col("__x") >= F.col("__start.__x")) & ~F.col("__t").rlike(DASH))
    # Only the row's first letter counts; a later one is text of the same answer.
    listed = listed.withColumns({"__letter": F.when(first, F.col("__letter")), "__rest": F.when(first, F.col("__rest"))})
    return side_by_side.unionByName(under).unionByName(_joined(listed, row, part))
