"""Text recognised on a page: words to lines, lines to blocks, noisy to clean text, tiers of evidence."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from itertools import accumulate, groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes
from ..functions.alignment import best_match_score, line_texts, match_score, match_share, reading_gate
from ..functions.text import HAN_RANGE, plain_key
from .islands import each_group
from .lineage import cut_lineage
from .ordered import Ordered, null_safe
from .sequences import tag_runs


class _Rows:
    """Rows of a band, as its words come from the top down."""

    def __init__(self):
        self.rows = []  # [row number, centre, count, heights in order]

    def place(self, cy: float, h: float) -> int:
        """Number of the row that a word joins: the nearest within reach, else a new one."""
        best, gap = None, None
        for r in self.rows:
            hs = r[3]
            m = len(hs) // 2
            height = hs[m] if len(hs) % 2 else (hs[m - 1] + hs[m]) / 2
            d = abs(cy - r[1])
            if d <= max(h, height) * 0.6 and (gap is None or d < gap):
                best, gap = r, d
        if best is None:
            best = [len(self.rows), cy, 1, [h]]
            self.rows.append(best)
        else:
            best[1] = (best[1] * best[2] + cy) / (best[2] + 1)
            best[2] += 1
            bisect.insort(best[3], h)
        return best[0]


LONG_PAGE = 200_000  # words of a page that one task reads; longer pages are cut into bands by ordered passes


def group_words_to_lines(df: DataFrame, page: list[str], ident: str) -> DataFrame:
    """Word boxes (text, x, y, w, h) as lines in reading order: id, text and box.

    A word joins the nearest row within .6 of the larger height; the centre and median height of a row
    follow its words.  A row is split at gaps over max(3 heights, .025).  Words farther apart than any
    row can reach never meet, so each page is first cut into independent bands; only the bands that may
    hold several rows are followed in order.  Pages of up to ``LONG_PAGE`` words are read whole, in one shuffle of the words.
    """
    words = df.filter((F.trim("text") != "") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull())
    words = words.select(*page, ident, "text", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    long = cut_lineage(words.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LONG_PAGE))
    if long.isEmpty():
        return _page_lines(words, page, ident)
    part = lambda how: words.alias("l").join(long.alias("r"), null_safe("l", "r", page), how)
    return _page_lines(part("left_anti"), page, ident).unionByName(_long_page_lines(part("left_semi"), page, ident))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b as Spark has it: not-a-number is the largest number."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _page_lines(words: DataFrame, page: list[str], ident: str) -> DataFrame:
    """``group_words_to_lines`` of whole pages, many pages at a time."""
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        count = np.diff([*starts, len(table)])
        x, y, w, h = (table[c].to_numpy() for c in "xywh")
        cy, of = y + h / 2, np.repeat(np.arange(len(starts)), count)
        order = np.lexsort((x, cy, of))  # rows come by ident, and the sort keeps that
        x, y, w, h, cy, of = (v[order] for v in (x, y, w, h, cy, of))
        tallest = np.maximum.reduceat(h, starts)[of]
        first = np.zeros(len(of), bool)
        first[starts] = True
        with np.errstate(invalid="ignore"):
            first[1:] |= _over(np.diff(cy), tallest[1:] * 0.6)
            begin = np.flatnonzero(first)
            # Where the centres of a band span no more than .6 of its smallest height, every word is within reach of the first row.
            several = _over(np.maximum.reduceat(cy, begin) - np.fmin.reduceat(cy, begin), np.fmin.reduceat(h, begin) * 0.6)
        band, row = np.cumsum(first), np.zeros(len(of), np.int64)
        ends = np.append(begin[1:], len(of))
        for a, b in zip(begin[several].tolist(), ends[several].tolist()):
            rows = _Rows()
            row[a:b] = [rows.place(*word) for word in zip(cy[a:b].tolist(), h[a:b].tolist())]

        # Bands count on over the pages, so a band and a row tell the page.
        def row_starts(order: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.append(True, (np.diff(band[order]) != 0) | (np.diff(row[order]) != 0)))

        by_height = np.lexsort((h, row, band))
        at = row_starts(by_height)
        size = np.diff(np.append(at, len(of)))
        height = (h[by_height[at + (size - 1) // 2]] + h[by_height[at + size // 2]]) / 2
        centre = np.add.reduceat(cy[by_height], at) / size
        sort = np.lexsort((order, x, row, band))  # in a row by x, then by ident
        at = row_starts(sort)
        x, y, w, h, of, place = (v[sort] for v in (x, y, w, h, of, order))
        of_row = np.repeat(np.arange(len(at)), size)
        cut = np.zeros(len(of), bool)
        with np.errstate(invalid="ignore"):
            cut[1:] = _over(x[1:] - (x + w)[:-1], np.maximum(height[of_row] * 3, 0.025)[1:])
        cut[at] = True
        line = np.flatnonzero(cut)
        x1, y1 = np.maximum.reduceat(x + w, line), np.maximum.reduceat(y + h, line)
        x0, y0 = np.fmin.reduceat(x, line), np.fmin.reduceat(y, line)
        pieces = pa.ListArray.from_arrays(pa.array(np.append(line, len(of)), pa.int32()), table["text"].combine_chunks().take(pa.array(place)))
        text = pc.binary_join(pieces, " ")
        han = pc.match_substring_regex(text, f"[{HAN_RANGE}]")
        text = pc.if_else(han, pc.binary_join(pieces, ""), text)
        of = of[line]
        reading = np.lexsort((np.arange(len(line)), centre[of_row[line]], of))
        number = np.arange(len(line)) - np.searchsorted(of, of) + 1
        here = pa.array(starts[of])
        return pa.table({**{c: table[c].take(here) for c in page}, "id": pc.binary_join_element_wise("line", pa.array(number).cast(pa.string()), "-"),
                          "text": text.take(pa.array(reading)), **{c: pa.array(v[reading]) for c, v in (("x", x0), ("y", y0), ("w", x1 - x0), ("h", y1 - y0))}})

    schema = T.StructType([*[words.schema[c] for c in page], T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in "xywh"]])
    return each_group(words, page, [F.col(ident)], work, schema, [*page, "text", *"xywh"])


def _long_page_lines(words: DataFrame, page: list[str], ident: str) -> DataFrame:
    """``group_words_to_lines`` without a task that holds a page."""
    words = words.withColumn("cy", F.col("y") + F.col("h") / 2)
    tallest = words.groupBy(*page).agg(F.max("h").alias("__tall"))
    reach = cut_lineage(words.alias("l").join(tallest.alias("r"), null_safe("l", "r", page)).select("l.*", "r.__tall"))
    banded = tag_runs(reach, page, ["cy", "x", ident], F.col("cy"), F.col("__tall") * 0.6, out="band").drop("__tall")
    key = [*page, "band"]
    keys = len(key)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band, rows = None, _Rows()
        for pdf in batches:
            out = []
            for rec in zip(*[pdf[c] for c in key], pdf["cy"], pdf["h"]):
                here = [None if v != v else v for v in rec[:keys]]  # a null number of a page is not-a-number here
                if here != band:
                    band, rows = here, _Rows()
                out.append(rows.place(*rec[keys:]))
            yield pdf.assign(row=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in banded.schema.fields) + ", row bigint"
    # Where the centres of a band span no more than .6 of its smallest height, every word is within reach of the first row.
    banded = cut_lineage(banded)
    spread = banded.groupBy(*key).agg(((F.max("cy") - F.min("cy")) <= F.min("h") * 0.6).alias("__one"))
    told = banded.alias("l").join(spread.alias("r"), null_safe("l", "r", key)).select("l.*", "r.__one")
    one_row = told.filter("__one").drop("__one").withColumn("row", F.lit(0).cast("long"))
    several = told.filter("NOT __one").drop("__one").repartition(*key).sortWithinPartitions(*key, "cy", "x", ident)
    placed = cut_lineage(one_row.unionByName(several.mapInPandas(follow, schema)))
    row = [*key, "row"]
    shape = placed.groupBy(*row).agg(F.median("h").alias("__height"), F.avg("cy").alias("__centre"))
    o = Ordered(placed, row, ["x", ident]).add(__end=("lag", F.col("x") + F.col("w")))
    o.df = o.df.alias("l").join(shape.alias("r"), null_safe("l", "r", row)).select("l.*", "r.__height", "r.__centre")
    split = F.col("__end").isNotNull() & (F.col("x") - F.col("__end") > F.greatest(F.col("__height") * 3, F.lit(0.025)))
    o.with_columns(__cut=split.cast("long")).add(seg=("sum", "__cut"), __i=("row",))
    # The text of one line is the value of the output row.
    text = F.transform(F.array_sort(F.collect_list(F.struct("__i", "text"))), lambda p: p["text"])
    han = F.bool_or(F.col("text").rlike(f"[{HAN_RANGE}]"))
    lines = o.done().groupBy(*row, "seg").agg(
        F.when(han, F.array_join(text, "")).otherwise(F.array_join(text, " ")).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("__x1"), F.max(F.col("y") + F.col("h")).alias("__y1"), F.max("__centre").alias("__centre"))
    done = Ordered(cut_lineage(lines), page, ["__centre", "band", "row", "seg"]).add(__n=("row",)).done()
    return done.select(*page, F.concat(F.lit("line-"), F.col("__n")).alias("id"), "text", "x", "y", (F.col("__x1") - F.col("x")).alias("w"), (F.col("__y1") - F.col("y")).alias("h"))


def fuzzy_assign(lines: DataFrame, blocks: DataFrame, page: list[str], accept: float = 0.6) -> DataFrame:
    """Block of every recognised line: the best match of its text among the blocks near it.

    Lines have page, line, text and box; blocks have page, block, text and box (struct x, y, w, h).  A
    block counts when the line's centre lies in its grown box and at least ``accept`` of the line's text
    is found in it; nearness, a line of its own and the original box raise its rank.  Lines and blocks
    meet by page and strip of the page height, and the alignment runs only where the text is not
    contained as it is.
    """
    strip = 0.1
    l = lines.withColumns({"__key": plain_key(F.col("text")), "__cx": F.col("box.x") + F.col("box.w") / 2, "__cy": F.col("box.y") + F.col("box.h") / 2})
    l = l.withColumn("__key", F.explode(F.array("__key")))  # so that the filter does not make the key again
    l = l.filter(F.length("__key") >= 2).select(*page, "line", "__key", "__cx", "__cy", F.col("box").alias("__lb"), F.floor(F.col("__cy") / strip).alias("__s"))
    own = F.when(F.contains("text", F.lit("\n")), F.transform(F.split("text", "\n"), plain_key))  # a single line is the text itself
    b = blocks.withColumns({"__text": plain_key(F.col("text")), "__own": own, "__g": boxes.grow(F.col("box"), 0.15, 0.1)})
    b = b.select(*page, "block", "__text", "__own", F.col("box").alias("__bb"), "__g",
                 F.explode(F.sequence(F.floor(F.col("__g.y") / strip), F.floor((F.col("__g.y") + F.col("__g.h")) / strip))).alias("__s"))
    near = l.join(b, [*page, "__s"]).filter(F.col("__cx").between(F.col("__g.x"), F.col("__g.x") + F.col("__g.w")) & F.col("__cy").between(F.col("__g.y"), F.col("__g.y") + F.col("__g.h")))
    whole = F.when(F.col("__own").isNull(), F.col("__text") == F.col("__key")).otherwise(F.array_contains("__own", F.col("__key")))
    dist = boxes.center_dist(F.col("__lb"), F.col("__bb"))
    bonus = F.when(whole, 0.5).otherwise(0.0) + F.when(F.col("__cx").between(F.col("__bb.x"), F.col("__bb.x") + F.col("__bb.w"))
                                                       & F.col("__cy").between(F.col("__bb.y"), F.col("__bb.y") + F.col("__bb.h")), 0.75).otherwise(0.0)
    near = near.select(*page, "line", "block", "__key", "__text", (bonus - dist * 1.5).alias("__lift"), F.contains("__text", F.col("__key")).alias("__in"))
    # A line's candidates come one after the other, and a candidate whose lift leaves it behind another one is not compared.
    asked = F.when(~F.col("__in"), F.col("__text"))
    near = near.filter(F.col("__in") | (F.length("__text") > 0))
    near = near.select(*page, "line", "block", "__lift", best_match_score(F.to_json(F.struct(*page, "line")), F.when(~F.col("__in"), F.col("__key")), asked, F.col("__lift"), accept).alias("score"))
    scored = near.filter(F.col("score") >= accept).withColumn("rank", F.col("score") + F.col("__lift"))
    first = F.struct(-F.col("rank"), -F.col("score"), F.col("block"))  # of equal blocks the first
    best = scored.groupBy(*page, "line").agg(F.min_by(F.struct("block", "score", "rank"), first).alias("__b"))
    return best.select(*page, "line", "__b.*")


LARGE_PAGE = 20_000  # lines and labels of a page that one task compares; on larger pages they meet by letters


def claim_rest(lines: DataFrame, blocks: DataFrame, claimed: DataFrame, page: list[str], accept: float = 0.8) -> DataFrame:
    """Lines that no block has claimed, for the blocks that claimed none: (page, line, block, score).

    Looks at the whole page, as such a block's box may be far off.  ``blocks`` have page, block and text (short labels only: the caller
    leaves others out); ``claimed`` has page, line and block.  At least ``accept`` of the block's text has to be found in the line; a line
    goes to the first such block.  Texts under two letters take no part.  Pages of up to ``LARGE_PAGE`` rows are read whole, in one shuffle.
    """
    free = lines.select(*page, "line", plain_key(F.col("text")).alias("__key"), F.lit(2).alias("__kind"))
    open_ = blocks.select(*page, "block", plain_key(F.col("text")).alias("__key"), F.lit(1).alias("__kind"))
    free, open_ = (x.withColumn("__key", F.explode(F.array("__key"))).filter(F.length("__key") >= 2) for x in (free, open_))  # the filter does not make the key again
    rows = cut_lineage(claimed.select(*page, "line", "block", F.lit(0).alias("__kind"), F.lit("").alias("__key")).unionByName(open_, allowMissingColumns=True)
                       .unionByName(free, allowMissingColumns=True))
    large = cut_lineage(rows.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LARGE_PAGE))
    done = _claim_pages(rows, page, accept) if large.isEmpty() else None
    if done is None:
        part = lambda how: rows.alias("l").join(large.alias("r"), null_safe("l", "r", page), how)
        done = _claim_pages(part("left_anti"), page, accept).unionByName(_claim_by_letters(part("left_semi"), page, accept))
    return done.select(*page, *[F.col(c).cast(of.schema[c].dataType) for c, of in (("line", lines), ("block", blocks))], "score")


def _claim_pages(rows: DataFrame, page: list[str], accept: float) -> DataFrame:
    """``claim_rest`` of whole pages: rows are claims (kind 0), labels (1) and lines (2)."""
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        kind, key, line, block = (table[c].to_pylist() for c in ("__kind", "__key", "line", "block"))
        line, block = ([repr(v) for v in x] if pa.types.is_nested(table[c].type) else x for c, x in (("line", line), ("block", block)))
        where, owner, score = [], [], []
        for a, b in pairwise([*starts.tolist(), len(table)]):
            kinds = kind[a:b]
            labels, texts = a + bisect.bisect_left(kinds, 1), a + bisect.bisect_left(kinds, 2)
            claimed_lines, claimed_blocks = set(line[a:labels]), set(block[a:labels])
            first: dict[str, int] = {}  # the first block of each label
            for k in range(labels, texts):
                if block[k] not in claimed_blocks:
                    first.setdefault(key[k], k)
            left = [k for k in range(texts, b) if line[k] not in claimed_lines]
            for k, label, share in _first_labels([key[k] for k in left], [(label, block[k]) for label, k in first.items()], accept):
                where.append(left[k])
                owner.append(first[label])
                score.append(share)
        found = pa.array(where, pa.int64())
        return pa.table({**{c: table[c].take(found) for c in (*page, "line")}, "block": table["block"].take(pa.array(owner, pa.int64())), "score": pa.array(score, pa.float64())})

    schema = T.StructType([*[rows.schema[c] for c in (*page, "line", "block")], T.StructField("score", T.DoubleType())])
    found = each_group(rows, page, [F.col("__kind"), F.col("block")], work, schema, [*page, "line", "block", "__kind", "__key"])
    # A line may come with several texts.
    return _first_blocks(found, page)


def _first_labels(texts: list[str], labels: list[tuple[str, object]], accept: float) -> Iterator[tuple[int, str, float]]:
    """(place of a text, label, share) of the first block whose label the text holds ``accept`` of; labels come with their blocks, in order of these."""
    joined, begin = "\n".join(texts), [0, *accumulate(len(t) + 1 for t in texts)]  # keys have no line breaks
    open_ = np.ones(len(texts), bool)
    for _, of_block in groupby(labels, key=lambda l: l[1]):
        found: dict[int, tuple[float, str]] = {}
        for label, _ in of_block:
            run = math.ceil(len(label) * accept - 1e-9)
            # A run of that share covers the label's middle; long labels may also share letters in order.
            middle = label[len(label) - run:run]
            if len(label) >= 12 or not middle:
                places = np.flatnonzero(open_).tolist()
            else:
                places, at = [], joined.find(middle)
                while at >= 0:
                    k = bisect.bisect_right(begin, at) - 1
                    if open_[k]:
                        places.append(k)
                    at = joined.find(middle, begin[k + 1])
            for k in places:
                if len(texts[k]) >= run and (share := match_share(label, texts[k], accept)) >= accept - 1e-9:
                    found[k] = max(found.get(k, (0.0, "")), (share, label))
        open_[[*found]] = False
        yield from ((k, label, share) for k, (share, label) in found.items())


def _first_blocks(scored: DataFrame, page: list[str]) -> DataFrame:
    best = scored.groupBy(*page, "line").agg(F.min(F.struct("block", (-F.col("score")).alias("s"))).alias("__b"))
    return best.select(*page, "line", F.col("__b.block").alias("block"), (-F.col("__b.s")).alias("score"))


def _claim_by_letters(rows: DataFrame, page: list[str], accept: float) -> DataFrame:
    """``claim_rest`` without a task that holds a page.

    Lines and blocks meet by letters: a block's text may lack only some of its letters in a line, so one of one more of its rarest letters has to be there.
    """
    claimed = rows.filter("__kind = 0")
    free = rows.filter("__kind = 2").select(*page, "line", F.col("__key").alias("__line"))
    free = cut_lineage(free.alias("l").join(claimed.alias("r"), null_safe("l", "r", [*page, "line"]), "left_anti"))
    open_ = rows.filter("__kind = 1").select(*page, "block", "__key")
    open_ = open_.alias("l").join(claimed.alias("r"), null_safe("l", "r", [*page, "block"]), "left_anti")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    places = free.select(*page, "line", F.explode(letters(F.col("__line"))).alias("__c"))
    often = places.groupBy(*page, "__c").agg(F.count(F.lit(1)).alias("__often"))
    asked = open_.withColumn("__c", F.explode(letters(F.col("__key")))).alias("l")
    asked = asked.join(often.alias("r"), null_safe("l", "r", [*page, "__c"]), "left").select("l.*", F.coalesce("r.__often", F.lit(0)).alias("__often"))
    # One letter of a text at most is one row here, so the list is no longer than the text.
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("__often", "__c"))), F.lit(1), F.floor(F.length("__key") * (1 - accept) + 1e-9).cast("int") + 1)
    asked = asked.groupBy(*page, "block", "__key").agg(F.filter(rarest, lambda r: r["__often"] > 0).alias("__r")).withColumn("__r", F.explode("__r"))
    asked = asked.select(*page, "block", "__key", F.col("__r.__c").alias("__c"))
    met = asked.alias("l").join(places.alias("r"), null_safe("l", "r", [*page, "__c"])).select("l.*", "r.line").drop("__c").distinct()
    met = met.alias("l").join(free.alias("r"), null_safe("l", "r", [*page, "line"])).select("l.*", "r.__line")
    # A run of that share covers the text's middle; long texts may also share letters in order.
    run = F.ceil(F.length("__key") * accept - 1e-9).cast("int")
    middle = F.substring(F.col("__key"), F.length("__key") - run + 1, 2 * run - F.length("__key"))
    likely = met.filter((F.length("__line") >= run) & ((F.length("__key") >= 12) | F.contains("__line", middle)))
    scored = likely.select(*page, "line", "block", match_score(F.col("__key"), F.col("__line"), accept).alias("score")).filter(F.col("score") >= accept - 1e-9)
    return _first_blocks(scored, page)


def align_lines(df: DataFrame, clean: str, lines: str, *, ratio: float = 0.3, limit: int | None = None, out: str = "aligned") -> DataFrame:
    """Cut the clean text at the line breaks of a noisy reading (an array of lines).

    Every row stays.  One that cannot be cut has null, with the reason in ``<out>_reason``: ``empty`` (no text on either
    side, or a null), ``far`` (more than ``ratio`` of it differs) or, only if a ``limit`` is given, ``long`` (over that many
    characters without blanks).  The lengths are tested first, and what passes is aligned whole: in one
    pass if the reading only leaves out letters or letter counts tell the way, else in a band as wide as its edits ask for.
    """
    bare = lambda c: F.regexp_replace(c, "\\s+", "")
    early = reading_gate(bare(F.col(clean)), bare(F.array_join(lines, "")), ratio, limit)
    reason = f"{out}_reason"
    asked = df.withColumn(reason, early)
    open_ = F.col(reason).isNull()
    cut = asked.withColumn(out, line_texts(F.when(open_, F.col(clean)), F.when(open_, F.col(lines)), ratio))
    return cut.withColumn(reason, F.when(F.col(reason).isNull() & F.col(out).isNull(), "far").otherwise(F.col(reason)))


def tiered_match(values: DataFrame, lines: DataFrame, page: list[str], order: list[str], tiers: list[tuple[Column, Column, Column]], *, accept: float = 0.7) -> DataFrame:
    """Pair expected values with recognised lines in tiers; each line is used once.

    ``tiers`` lists (key of the value, key of the line, condition on the line).  Within a tier equal keys
    pair up in order.  ``page_ok`` tells whether enough of the page was matched.
    """
    vid, lid = [c for c in values.columns if c not in page], [c for c in lines.columns if c not in page]
    v = values.withColumn("__v", F.struct(*vid))
    l = lines.withColumn("__l", F.struct(*lid))
    done = None
    for n, (vk, lk, ok) in enumerate(tiers, 1):
        a = Ordered(v.withColumn("__k", vk).filter(F.col("__k").isNotNull()), [*page, "__k"], order).add(__i=("row",)).done().select(*page, "__k", "__i", "__v")
        b = Ordered(l.withColumn("__k", lk).filter(ok & F.col("__k").isNotNull()), [*page, "__k"], order).add(__i=("row",)).done().select(*page, "__k", "__i", "__l")
        hit = cut_lineage(a.join(b, [*page, "__k", "__i"]).select(*page, "__v", "__l", F.lit(n).alias("tier")))
        done = hit if done is None else done.unionByName(hit)
        if n < len(tiers):
            v = v.join(hit.select(*page, "__v"), [*page, "__v"], "left_anti")
            l = l.join(hit.select(*page, "__l"), [*page, "__l"], "left_anti")
    full = values.withColumn("__v", F.struct(*vid)).join(done, [*page, "__v"], "left")
    pages = full.groupBy(*page).agg((F.count("tier") >= F.count(F.lit(1)) * accept).alias("page_ok"))
    return full.join(pages, page).select(*values.columns, "tier", F.col("__l").alias("matched"), "page_ok")


# -- evidence rules --------------------------------------------------------------------

def quality_issues(segments: DataFrame, report: list[str], text: str, confidence: str, threshold: float = 0.9) -> DataFrame:
    """Issue rows of re-read segments: low confidence, and no text at all."""
    kinds = F.array_compact(F.array(F.when(F.col(confidence) < threshold, "low-confidence"), F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty-recognition")))
    return segments.select(*report, F.explode(kinds).alias("kind"))


def flag_low_confidence(segments: DataFrame, confidence: str, threshold: float = 0.9) -> DataFrame:
    return segments.withColumn("review_required", F.col(confidence) < threshold)


def arbitrate(df: DataFrame, text: str, confidence: str, second_text: str, second_confidence: str) -> DataFrame:
    """Take the second reading when it is confident, clearly better and different; the first one is kept aside.

    Only doubtful readings without letters beyond ASCII are checked.
    """
    t, c, t2, c2 = (F.col(x) for x in (text, confidence, second_text, second_confidence))
    checked = (c < 0.95) & (t != "") & ~t.rlike("[\\p{L}&&[^\\x00-\\x7f]]")
    take = checked & (t2 != "") & (t2 != t) & (c2 >= 0.9) & (c2 > c + 0.1)
    return df.withColumns({"checked": checked, "previous_text": F.when(take, t), text: F.when(take, t2).otherwise(t), confidence: F.when(take, c2).otherwise(c),
                           "issue": F.when(take, "engine-disagreement")})


def agreeing_reads(reads: DataFrame, keys: list[str], text: str, confidence: str, *, rule: str = "quoted") -> DataFrame:
    """Accept a text when both readings are equal and fit the rule; else an unresolved issue.

    quoted: in quotation marks around 1 to 4 characters, both at least .7 sure.  han: one Han character,
    both at least .9 sure.
    """
    r = reads.groupBy(*keys).agg(F.min(text).alias("__a"), F.max(text).alias("__b"), F.min(confidence).alias("confidence"), F.count(F.lit(1)).alias("__n"))
    same = (F.col("__n") >= 2) & (F.col("__a") == F.col("__b"))
    if rule == "quoted":
        inner = F.trim(F.regexp_replace("__a", "^[“” ]+|[“” ]+$", ""))
        ok = same & (F.col("confidence") >= 0.7) & F.length(inner).between(1, 4) & F.col("__a").startswith("“") & F.col("__a").endswith("”")
        kinds = ("recovered-quoted-text", "unresolved-empty-quotes")
    else:
        ok = same & (F.col("confidence") >= 0.9) & F.col("__a").rlike(f"^[{HAN_RANGE}]$")
        kinds = ("recovered-caption", "unresolved-caption-component")
    ok = F.coalesce(ok, F.lit(False))
    return r.select(*keys, ok.alias("accepted"), F.when(ok, F.col("__a")).alias("text"), F.when(ok, kinds[0]).otherwise(kinds[1]).alias("kind"), "confidence")


def blank_evidence(pages: DataFrame, lines: DataFrame, keys: list[str], ink: str, text: str, confidence: str, y: str) -> DataFrame:
    """A page is blank only without any credible line and with next to no ink; edge noise does not count."""
    noise = (F.coalesce(F.col(confidence), F.lit(1.0)) < 0.35) & ((F.col(y) < 0.02) | (F.col(y) > 0.98)) & ~F.coalesce(F.col(text), F.lit("")).rlike("[\\p{L}\\p{N}]")
    n = lines.groupBy(*keys).agg(F.count_if(~noise).alias("credible_lines"), F.count(F.lit(1)).alias("raw_lines"))
    j = pages.join(n, keys, "left").na.fill(0, ["credible_lines", "raw_lines"])
    return j.withColumn("blank", (F.col("credible_lines") == 0) & (F.col(ink) < 0.0002))


def region_disagreement(sources: DataFrame, pieces: DataFrame, region: list[str], source_text: str, order: list[str], text: str, stretch: int = 4096) -> DataFrame:
    """Regions whose re-read pieces, put together, differ from the source apart from blanks and case.

    Source and pieces are cut at the same places, every ``stretch`` characters of the region, so that each character travels once and
    no region is put together in one place.  A null source is no disagreement, null pieces are empty, and a source without pieces
    disagrees unless it is empty.
    """
    compact = lambda c: F.lower(F.regexp_replace(c, "\\s+", ""))
    chunks = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{stretch}}}"), F.lit(0))
    p = pieces.select(*region, *order, compact(F.col(text)).alias("__t")).withColumn("__len", F.length("__t")).filter("__len > 0")
    run = Ordered(p, region, order).add(__end=("sum", "__len")).done().withColumn("__start", F.col("__end") - F.col("__len"))
    # A piece fills up the stretch that it begins in; the rest of it is cut from there on.
    room = (stretch - F.col("__start") % stretch).cast("int")
    bits = F.concat(F.array(F.substring(F.col("__t"), F.lit(1), room)), chunks(F.substring(F.col("__t"), room + 1, F.length("__t"))))
    cut = run.select(*region, "__start", F.posexplode(bits).alias("__i", "__t")).withColumn("__b", F.floor(F.col("__start") / stretch) + F.col("__i"))
    # At most ``stretch`` bits meet, as none is empty; their order is that of the pieces they come from.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__start", "__t"))), lambda x: x["__t"]), "")
    parts = cut.groupBy(*region, "__b").agg(joined.alias("__t"))
    s = sources.select(*region, compact(F.col(source_text)).alias("__s"))
    # The last stretch of a source is never full, so text beyond the source's end differs from it there.
    rest = F.when(F.length("__s") % stretch == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    asked = s.filter("__s IS NOT NULL").select(*region, F.posexplode(F.concat(chunks(F.col("__s")), rest)).alias("__b", "__s"))
    asked = asked.withColumn("__b", F.col("__b").cast("bigint"))
    on = null_safe("l", "r", [*region, "__b"])
    bad = asked.alias("l").join(parts.alias("r"), on, "left").filter(F.col("l.__s") != F.coalesce("r.__t", F.lit(""))).select("l.*")
    found = bad.select(*region).distinct()
    return s.alias("l").join(found.alias("r"), null_safe("l", "r", region), "left_semi").select(*region, F.lit("recognition-disagreement").alias("kind"))


def flag_regions(pieces: DataFrame, issues: DataFrame, region: list[str]) -> DataFrame:
    """Pieces of regions with an issue need review."""
    bad = issues.select(*region).distinct().withColumn("__bad", F.lit(True))
    return pieces.join(bad, region, "left").withColumn("review_required", F.col("__bad").isNotNull()).drop("__bad")
