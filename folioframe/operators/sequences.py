"""Order-dependent operators: numbering, runs, carried values, schedules, retention."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ordered import Ordered, null_safe, weighted_rank_pick

# Days until the next review per level, and the wait after a failed one.
REVIEW_DAYS = [0, 1, 3, 7, 14, 30]
RETRY_MS = 60_000


def millis(col: str | Column) -> Column:
    """Epoch milliseconds of a timestamp."""
    return F.unix_millis((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def last_before(spots: DataFrame, right: DataFrame, keys: list[str], right_on: Column, value: Column, strict: bool = False) -> DataFrame:
    """(keys, __at, __out): for each row (keys, __at) of ``spots``, once, the value of the last right row at or before it.

    The ordered pass has one row a place and side, however many rows are there, so no two of them tie.
    """
    mine, theirs = (0, 1) if strict else (1, 0)
    r = right.select(*keys, right_on.alias("__at"), value.alias("__value")).groupBy(*keys, "__at").agg(F.max("__value").alias("__value"))
    both = cut_lineage(spots.select(*keys, "__at").distinct().withColumn("__side", F.lit(mine)).unionByName(r.withColumn("__side", F.lit(theirs)), allowMissingColumns=True))
    done = Ordered(both, keys, ["__at", "__side"]).add(__out=("last", "__value")).done()
    return done.filter(F.col("__side") == mine).select(*keys, "__at", "__out")


def with_places(left: DataFrame, found: DataFrame, keys: list[str], left_on: Column, out: str) -> DataFrame:
    """``left`` with the result of ``last_before`` at its places.

    A place of many rows is a skewed key on the left side only, which adaptive execution splits, or broadcasts past.
    """
    return (left.withColumn("__at", left_on).alias("l").join(found.alias("r"), null_safe("l", "r", [*keys, "__at"]), "left")
            .select(*[F.col(f"l.`{c}`") for c in left.columns], F.col("r.__out").alias(out)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_on: Column, right_on: Column, value: Column, out: str,
          strict: bool = False) -> DataFrame:
    """For each left row the value of the last right row at or before it (before it if ``strict``); of right rows at one place the largest value."""
    found = last_before(left.select(*keys, left_on.alias("__at")), right, keys, right_on, value, strict)
    return with_places(left, found, keys, left_on, out)


def number_missing(df: DataFrame, number: str, order: list[str]) -> DataFrame:
    """Rows without a number get max + 1, max + 2 ... in order; given numbers never change."""
    top = F.coalesce(df.agg(F.max(number)).scalar(), F.lit(0))
    fresh = Ordered(df.filter(F.col(number).isNull()), [], order).add(__i=("row",)).done()
    fresh = fresh.withColumn(number, top + F.col("__i")).drop("__i")
    return df.filter(F.col(number).isNotNull()).unionByName(fresh.select(*df.columns))


def tag_runs(df: DataFrame, part: list[str], order: list[str], value: Column, gap, *, out: str = "run") -> DataFrame:
    """Number the runs of rows whose successive values are at most ``gap`` apart."""
    o = Ordered(df.withColumn("__v", value), part, order).add(__prev=("lag", "__v"))
    broken = F.col("__prev").isNull() | (F.col("__v") - F.col("__prev") > gap)
    o.with_columns(__break=broken.cast("long")).add(**{out: ("sum", "__break")})
    return o.done().drop("__v", "__prev", "__break")


def gap_runs(df: DataFrame, part: list[str], order: list[str], value: Column, gap) -> DataFrame:
    """One row per run: start, end, number of rows and rows per unit of length."""
    tagged = tag_runs(df.withColumn("__pos", value), part, order, F.col("__pos"), gap)
    return (tagged.groupBy(*part, "run").agg(F.min("__pos").alias("start"), F.max("__pos").alias("end"), F.count(F.lit(1)).alias("n"))
            .withColumn("density", F.col("n") / (F.col("end") - F.col("start") + 1)))


def reading_order(df: DataFrame, part: list[str], order: list[str], out: str = "id") -> DataFrame:
    """Renumber rows from 0 in reading order."""
    return Ordered(df, part, order).add(**{out: ("row",)}).done().withColumn(out, F.col(out) - 1)


def paragraphs(df: DataFrame, part: list[str], order: list[str], x: str, y: str, h: str, tolerance: float = 0.025) -> DataFrame:
    """Number paragraphs: a new one starts at an indent or after a vertical gap over the tolerance."""
    edges = df.groupBy(*part).agg(F.min(x).alias("__left"))
    o = Ordered(df, part, order).add(__end=("lag", F.col(y) + F.col(h)))
    o.df = (o.df.alias("l").join(edges.alias("r"), null_safe("l", "r", part)).select("l.*", "r.__left"))
    starts = F.col("__end").isNull() | (F.col(x) > F.col("__left") + tolerance) | (F.col(y) > F.col("__end") + tolerance)
    o.with_columns(__start=starts.cast("long")).add(paragraph=("sum", "__start"))
    return o.done().drop("__left", "__end", "__start")


def parse_choices(df: DataFrame, part: list[str], order: list[str], text: str) -> DataFrame:
    """Answer parts of numbered questions: question, letter and text.

    A number carries forward to the following rows, a letter A-D opens a part and later text joins it,
    until the next letter or number.  Lines that have places on a page are read by ``choices.page_choices``.
    """
    t = F.col(text)
    number = F.regexp_extract(t, "^\\s*(\\d+)\\s*[.．]", 1)
    letter = F.regexp_extract(t, "^\\s*(?:\\d+\\s*[.．]\\s*)?([ABCD])\\s*", 1)
    marked = df.withColumns({
        "__q": F.when(number != "", number.cast("long")),
        # A number without a letter closes the part before it.
        "__l": F.when(letter != "", letter).when(number != "", ""),
        "__t": F.when(letter != "", F.regexp_replace(t, "^\\s*(?:\\d+\\s*[.．]\\s*)?[ABCD]\\s*", "")).otherwise(t)})
    o = Ordered(marked, part, order).add(question=("last", "__q"), letter=("last", "__l"), __i=("row",))
    rows = o.done().filter(F.col("question").isNotNull() & (F.col("letter") != ""))
    # The text of one answer is the value of the output row.
    pieces = F.array_sort(F.collect_list(F.struct("__i", "__t")))
    return rows.groupBy(*part, "question", "letter").agg(
        F.array_join(F.transform(pieces, lambda p: p["__t"]), "").alias("answer"), F.count(F.lit(1)).alias("pieces"))


def interval_assign(lines: DataFrame, starts: DataFrame, part: list[str], line_at: Column, start_at: Column, ident: str,
                    tolerance: float = 0.007, out: str = "start") -> DataFrame:
    """Each line belongs to the last start at or above it, within the tolerance."""
    return as_of(lines, starts, part, line_at, start_at - tolerance, F.col(ident), out)


def expansion_shift(df: DataFrame, part: list[str], ident: list[str], top: str, height: str, required: str) -> DataFrame:
    """Move items down by the growth of the bands above them.

    Items that overlap side by side share one band, whose growth is the largest one needed in it; an item
    moves by the growth of every band that ends above it.  Where every part is small beside the whole, all of it is one shuffle of the items.
    """
    counts = (F.col(height) > 0) & F.col(required).isNotNull()
    extra = F.greatest(F.lit(0.0), F.col(required) - F.col(height))
    fresh = F.col("__reach").isNull() | (F.col(top) >= F.col("__reach") - 1)
    ends = df.withColumns({"__in": F.coalesce(counts, F.lit(False)), "__end": F.when(counts, F.col(top) + F.col(height))})
    o = Ordered(ends, part, [top, *ident])
    whole = o.hot is None
    if not whole:
        o = Ordered(ends.filter("__in"), part, [top, *ident])
    o.add(__reach=("prior_max", "__end")).with_columns(__new=F.when(F.col("__in"), fresh.cast("long"))).add(__band=("sum", "__new"))
    if whole:
        moved = _moved_in_parts(o.done().drop("__reach"), part, top, extra).select(*df.columns, "shift")
    else:
        bands = o.done().groupBy(*part, "__band").agg(F.max("__end").alias("__end"), F.max(extra).alias("__extra"))
        grown = Ordered(cut_lineage(bands.filter("__extra > 0")), part, ["__end", "__band"]).add(__shift=("sum", "__extra")).done()
        moved = as_of(df, grown, part, F.col(top) + 1, F.col("__end"), F.col("__shift"), "shift")
    return moved.withColumn("shift", F.coalesce("shift", F.lit(0.0))).withColumn("shifted_top", F.col(top) + F.col("shift"))


def _moved_in_parts(rows: DataFrame, part: list[str], top: str, extra: Column) -> DataFrame:
    """Rows with ``shift``: the first row of a band also stands at the band's end, and what grew is summed up to each row's top."""
    parts = part or [F.lit(0)]
    band = Window.partitionBy(*parts, "__band")
    rows = rows.withColumns({"__to": F.max("__end").over(band), "__more": F.max(F.when(F.col("__in"), extra)).over(band)})
    row = F.struct((F.col(top) + 1).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("more"))
    growth = F.struct(F.col("__to").alias("at"), F.lit(0).alias("side"), F.col("__more").cast("double").alias("more"))
    spots = F.when((F.col("__new") == 1) & (F.col("__more") > 0), F.array(row, growth)).otherwise(F.array(row))
    upto = Window.partitionBy(*parts).orderBy("__spot.at", "__spot.side", "__band").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__spot", F.explode(spots)).withColumn("shift", F.sum("__spot.more").over(upto)).filter("__spot.side = 1")


def stack_rows(df: DataFrame, part: list[str], order: list[str], y: str, height: str, gap: float) -> DataFrame:
    """Place rows one below the other: own y, or the end of the row above plus the gap if that is lower."""
    step = F.col(height) + gap
    o = Ordered(df.withColumn("__step", step), part, order).add(__upto=("sum", "__step"))
    o.with_columns(__free=F.col(y) - (F.col("__upto") - F.col("__step"))).add(__lift=("max", "__free"))
    placed = F.greatest(F.col("__lift"), F.lit(float(gap))) + (F.col("__upto") - F.col("__step"))
    return o.done().withColumn("stacked_y", placed).drop("__step", "__upto", "__free", "__lift")


def adjacent_pairs(df: DataFrame, part: list[str], order: list[str], mark: str, opening: str, closing: str, ident: str) -> DataFrame:
    """Opening marks directly followed by a closing one."""
    done = Ordered(df, part, order).add(__next=("lead", F.struct(F.col(mark).alias("m"), F.col(ident).alias("i")))).done()
    return (done.filter((F.col(mark) == opening) & (F.col("__next.m") == closing))
            .select(*part, F.col(ident).alias("open_id"), F.col("__next.i").alias("close_id")))


def batches(df: DataFrame, order: list[str], size: int = 60) -> DataFrame:
    """Ordered chunks of ``size`` rows, numbered from 0."""
    done = Ordered(df, [], order).add(__i=("row",)).done()
    return done.withColumn("batch", F.floor((F.col("__i") - 1) / size)).drop("__i")


def review_ladder(df: DataFrame, keys: list[str], order: list[str], ts: str, passed: Column) -> DataFrame:
    """Review state after every attempt: attempts, successes, level and due time (epoch ms).

    A pass raises the level by one up to 5 and waits 1, 3, 7, 14 or 30 days; a failure resets the level
    and asks again after a minute.
    """
    o = Ordered(df.withColumn("__ok", passed.cast("long")), keys, order).add(attempts=("row",), successes=("sum", "__ok"))
    o.with_columns(__at_fail=F.when(F.col("__ok") == 0, F.col("successes"))).add(__base=("last", "__at_fail"))
    level = F.least(F.col("successes") - F.coalesce("__base", F.lit(0)), F.lit(5)).cast("int")
    days = F.element_at(F.array(*[F.lit(d) for d in REVIEW_DAYS]), F.col("level") + 1)
    wait = F.when(F.col("__ok") == 1, days.cast("long") * 86_400_000).otherwise(RETRY_MS)
    return (o.done().withColumn("level", level).withColumn("due_ms", millis(ts) + wait)
            .drop("__ok", "__at_fail", "__base"))


def review_state(df: DataFrame, keys: list[str], order: list[str], ts: str, passed: Column) -> DataFrame:
    """Last review state per key, from one pre-aggregated pass over the attempts.

    The level only depends on the passes after the last failure, and those are the ones later than it.
    """
    at = F.struct(*order)
    fails = df.filter(~passed).groupBy(*keys).agg(F.max(at).alias("__fail"))
    joined = df.alias("l").join(fails.alias("r"), null_safe("l", "r", keys), "left").select("l.*", "r.__fail")
    since = passed & (F.col("__fail").isNull() | (F.struct(*order) > F.col("__fail")))
    agg = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(passed.cast("long")).alias("successes"),
        F.least(F.sum(since.cast("long")), F.lit(5)).cast("int").alias("level"),
        F.max_by(F.struct(millis(ts).alias("ms"), passed.alias("ok")), at).alias("__last"))
    days = F.element_at(F.array(*[F.lit(d) for d in REVIEW_DAYS]), F.col("level") + 1)
    wait = F.when(F.col("__last.ok"), days.cast("long") * 86_400_000).otherwise(RETRY_MS)
    return agg.withColumn("due_ms", F.col("__last.ms") + wait).drop("__last")


def due_queue(items: DataFrame, part: list[str], due_ms: str, now_ms: Column, order: list[str]) -> DataFrame:
    """Position in the review queue: due first, then new (no due time), then later ones."""
    rank = F.when(F.col(due_ms).isNull(), 1).when(F.col(due_ms) <= now_ms, 0).otherwise(2)
    ranked = items.withColumn("rank", rank).withColumn("__due", F.coalesce(due_ms, F.lit(0)))
    return Ordered(cut_lineage(ranked), part, ["rank", "__due", *order]).add(position=("row",)).done().drop("__due")


def averaged_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    n = F.col("__n")
    m = weighted_rank_pick(df, keys, value, {"__lo": F.floor((n + 1) / 2), "__hi": F.floor(n / 2) + 1})
    return m.select(*keys, "n", ((F.col("__lo") + F.col("__hi")) / 2).alias(out))


def lattice(df: DataFrame, part: list[str], row: str, y: str) -> DataFrame:
    """Row centres, pitch and start of an evenly spaced grid, all as medians."""
    centres = cut_lineage(averaged_median(df, part + [row], y, "centre").drop("n"))
    o = Ordered(centres, part, [row]).add(__prev=("lag", "centre"), __i=("row",))
    steps = cut_lineage(o.done().withColumn("__step", F.col("centre") - F.col("__prev")))
    pitch = averaged_median(steps, part, "__step", "pitch").drop("n")
    placed = (steps.alias("l").join(pitch.alias("r"), null_safe("l", "r", part), "left").select("l.*", "r.pitch")
              .withColumn("pitch", F.coalesce("pitch", F.lit(0.0)))
              .withColumn("__origin", F.col("centre") - (F.col("__i") - 1) * F.col("pitch")))
    start = averaged_median(placed, part, "__origin", "start").withColumnRenamed("n", "rows")
    return start.alias("l").join(pitch.alias("r"), null_safe("l", "r", part), "left").select(
        "l.*", F.coalesce("r.pitch", F.lit(0.0)).alias("pitch"))


def reflow(df: DataFrame, part: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """A column-by-column list as a grid of ``rows`` rows, padded with blanks."""
    placed = Ordered(df, part, order).add(__i=("row",)).done().withColumn("__i", F.col("__i") - 1)
    blanks = (placed.groupBy(*part).agg((F.max("__i") + 1).alias("__n"))
              .withColumn("__full", (F.ceil(F.col("__n") / rows) * rows))
              .filter("__full > __n").withColumn("__i", F.explode(F.sequence(F.col("__n"), F.col("__full") - 1)))
              .select(*part, "__i", F.lit("").alias(value)))
    return placed.select(*part, "__i", value).unionByName(blanks).select(
        *part, (F.col("__i") % rows).alias("row"), F.floor(F.col("__i") / rows).alias("col"), value)


def filtered_top(df: DataFrame, keep: Column, sort: list[Column], limit: int = 60) -> DataFrame:
    """First ``limit`` rows of a filtered, sorted list, with how many more there are."""
    kept = df.filter(keep)
    more = F.greatest(kept.agg(F.count(F.lit(1))).scalar() - limit, F.lit(0))
    return kept.orderBy(*sort).limit(limit).withColumn("remaining", more)


def last_per_key(df: DataFrame, keys: list[str], created: list[str], active: Column) -> DataFrame:
    """Newest row per key; an active one goes before newer inactive ones."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(active, *created)).alias("__r"))
    return best.select(*keys, "__r.*")


def attach_punctuation(df: DataFrame, part: list[str], order: list[str], token: str, word: Column, limit: int | None = None) -> DataFrame:
    """Pieces of a sentence: a word with the marks after it; all of them, or the first ``limit`` if given.

    Marks before the first word form a piece of their own.
    """
    o = Ordered(df.withColumn("__w", word.cast("long")), part, order).add(__word=("sum", "__w"), __i=("row",))
    # The number of words never falls, so the least one so far is that of the first token.
    pieces = o.add(__first=("min", "__word")).done().withColumn("piece", F.col("__word") - F.col("__first") + 1)
    if limit is not None:
        pieces = pieces.filter(F.col("piece") <= limit)
    text = F.array_sort(F.collect_list(F.struct("__i", token)))
    return pieces.groupBy(*part, "piece").agg(F.array_join(F.transform(text, lambda p: p[token]), "").alias("text"))


def threshold_segments(df: DataFrame, part: list[str], order: list[str], value: str, *, pause: int = 7, shortest: int = 8) -> DataFrame:
    """Stretches above p20 + .3 (p95 - p20) of their series, joined over short pauses; short ones are dropped."""
    n = F.col("__n")
    levels = weighted_rank_pick(df, part, value, {"__p20": F.floor(n * 0.2) + 1, "__p95": F.least(F.floor(n * 0.95) + 1, n)}, "__size")
    indexed = reading_order(df, part, order, "__i")
    loud = (indexed.alias("l").join(levels.alias("r"), null_safe("l", "r", part)).select("l.*", "r.__p20", "r.__p95", "r.__size")
            .filter(F.col(value) > F.col("__p20") + (F.col("__p95") - F.col("__p20")) * 0.3))
    runs = tag_runs(cut_lineage(loud.select(*part, "__i", "__size")), part, ["__i"], F.col("__i"), pause + 1, out="segment")
    # A series that ends within a pause keeps its last stretch open to the end.
    end = F.when(F.max("__size") - 1 - F.max("__i") <= pause, F.max("__size") - 1).otherwise(F.max("__i"))
    segments = runs.groupBy(*part, "segment").agg(F.min("__i").alias("start"), end.alias("end"))
    return segments.filter(F.col("end") - F.col("start") >= shortest).drop("segment")


def adjust_segments(segments: DataFrame, part: list[str], count: int) -> DataFrame:
    """Bring each series to ``count`` stretches: join the closest neighbours, or split the longest.

    Joining removes the smallest gaps, which is a rank over the gaps.  Splitting only runs where there are
    fewer than ``count`` stretches, so a group there has fewer than ``count`` rows.
    """
    sizes = segments.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    o = Ordered(segments, part, ["start"]).add(__prev=("lag", "end")).done()
    sized = o.alias("l").join(sizes.alias("r"), null_safe("l", "r", part)).select("l.*", "r.__n")
    sized = cut_lineage(sized)
    many = sized.filter(F.col("__n") >= count).withColumn("__gap", F.col("start") - F.col("__prev"))
    ranked = Ordered(many.filter("__gap IS NOT NULL"), part, ["__gap", "start"]).add(__rank=("row",)).done()
    joins = ranked.select(*part, "start", (F.col("__rank") > F.col("__n") - count).cast("long").alias("__cut"))
    tagged = many.select(*part, "start", "end", "__gap").alias("l").join(
        joins.alias("r"), null_safe("l", "r", part + ["start"]), "left").select("l.*", F.coalesce("r.__cut", F.lit(0)).alias("__cut"))
    grouped = Ordered(cut_lineage(tagged), part, ["start"]).add(__g=("sum", "__cut")).done()
    joined = grouped.groupBy(*part, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        longest = [(a - b, a, b) for a, b in zip(pdf["start"].tolist(), pdf["end"].tolist())]  # of equal ones the first
        heapq.heapify(longest)
        while len(longest) < count:
            _, first, last = longest[0]
            half = (first + last + 1) // 2
            heapq.heapreplace(longest, (first - half, first, half))
            heapq.heappush(longest, (half + 1 - last, half + 1, last))
        head = pdf[part].iloc[[0] * len(longest)].reset_index(drop=True)
        return head.assign(start=[a for _, a, _ in longest], end=[b for _, _, b in longest])

    few = sized.filter(F.col("__n") < count).select(*part, "start", "end")
    return joined.select(*part, "start", "end").unionByName(few.groupBy(*part).applyInPandas(split, few.schema))


def trim_retention(df: DataFrame, part: list[str], order: list[str], in_use: Column, keep: int) -> DataFrame:
    """Rows that stay when the oldest unused rows are dropped until ``keep`` remain; rows in use always stay."""
    flagged = df.withColumn("__used", in_use)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    aged = Ordered(flagged.filter(~F.col("__used")), part, order).add(__age=("row",)).done()
    unused = (aged.alias("l").join(sizes.alias("r"), null_safe("l", "r", part)).select("l.*", "r.__n")
              .filter(F.col("__age") > F.col("__n") - keep))
    return flagged.filter("__used").select(*df.columns).unionByName(unused.select(*df.columns))


def interpolate_missing(df: DataFrame, page: list[str], row: str, col: str, x: str, *, same_column: bool = False) -> DataFrame:
    """Fill missing cells of a grid and mark them for review.

    In this order: the same column of another row (if wanted), the line between the neighbours in the row,
    the line through the first and last known cell of the row.
    """
    key = page + [row]
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(col).alias("c"), F.col(x).cast("double").alias("x")))
    o = Ordered(df.withColumn("__k", known), key, [col]).add(__a=("prior_last", "__k"), __z=("next", "__k")).done()
    ends = df.filter(F.col(x).isNotNull()).groupBy(*key).agg(
        F.min(col).alias("__c0"), F.min_by(x, col).cast("double").alias("__x0"), F.max(col).alias("__c1"), F.max_by(x, col).cast("double").alias("__x1"))
    j = o.alias("l").join(ends.alias("r"), null_safe("l", "r", key), "left").select("l.*", "r.__c0", "r.__x0", "r.__c1", "r.__x1")
    between = F.col("__a.x") + (F.col("__z.x") - F.col("__a.x")) * (F.col(col) - F.col("__a.c")) / (F.col("__z.c") - F.col("__a.c"))
    along = F.when(F.col("__c1") > F.col("__c0"), F.col("__x0") + (F.col("__x1") - F.col("__x0")) * (F.col(col) - F.col("__c0"))
                   / F.nullif(F.col("__c1") - F.col("__c0"), F.lit(0)))
    choices = [F.col(x).cast("double"), between, along]
    if same_column:
        first = df.filter(F.col(x).isNotNull()).groupBy(*page, col).agg(F.min_by(x, row).cast("double").alias("__same"))
        j = j.alias("l").join(first.alias("r"), null_safe("l", "r", page + [col]), "left").select("l.*", "r.__same")
        choices.insert(1, F.col("__same"))
    filled = j.withColumn("recovered", F.col(x).isNull()).withColumn(x, F.coalesce(*choices))
    return filled.withColumn("review_required", F.col("recovered") & F.col(x).isNotNull()).select(*df.columns, "recovered", "review_required")


def carry_forward(df: DataFrame, part: list[str], order: list[str], opener: Column, head: Column, value: Column, default: Column, out: str) -> DataFrame:
    """Value of the last opener at or before each row, else of the last weaker head, else the default."""
    o = Ordered(df.withColumns({"__o": F.when(opener, value), "__h": F.when(head, value)}), part, order)
    done = o.add(__opener=("last", "__o"), __head=("last", "__h")).done()
    return done.withColumn(out, F.coalesce("__opener", "__head", default)).drop("__o", "__h", "__opener", "__head")


def lookahead(df: DataFrame, part: list[str], order: list[str], match: Column, stop: Column, value: Column, out: str, k: int = 2,
              number: str | None = None) -> DataFrame:
    """Value of the first match in the next ``k`` rows, not past a stop row; null on rows that match themselves.

    With ``number`` (a whole number that the order follows) the next rows are those of the next ``k`` numbers: a missing number ends the search.
    """
    at = F.lit(0) if number is None else F.col(number)
    o = Ordered(df.withColumn("__s0", F.struct(match.alias("m"), stop.alias("s"), value.alias("v"), at.alias("n"))), part, order)
    for i in range(1, k + 1):
        o.add(**{f"__s{i}": ("lead", f"__s{i - 1}")})
    found = F.lit(None)
    for i in range(k, 0, -1):
        s = F.col(f"__s{i}")
        gap = F.lit(False) if number is None else s["n"] != F.col(number) + i
        found = F.when(s.isNull() | s["s"] | gap, None).when(s["m"], s["v"]).otherwise(found)
    return o.done().withColumn(out, F.when(~match, found)).drop(*[f"__s{i}" for i in range(k + 1)])


def debounce(df: DataFrame, keys: list[str], order: list[str], ts: str, gap_ms: int) -> DataFrame:
    """Last change of every burst: a change that has no later one within the gap."""
    done = Ordered(df.withColumn("__ms", millis(ts)), keys, order).add(__next=("lead", "__ms")).done()
    return done.filter(F.col("__next").isNull() | (F.col("__next") - F.col("__ms") > gap_ms)).drop("__ms", "__next")


def idempotent_queue(df: DataFrame, keys: list[str], order: list[str], request: Column, finish: Column) -> DataFrame:
    """Requests with what happened to them: accepted, or absorbed by work already queued for the key.

    A finish row (done or error) lets the next request start new work.
    """
    state = F.when(request, "open").when(finish, "closed")
    o = Ordered(df.withColumn("__s", state), keys, order).add(__before=("prior_last", "__s")).done()
    outcome = F.when(F.col("__before") == "open", "absorbed").otherwise("accepted")
    return o.filter(request).withColumn("outcome", outcome).drop("__s", "__before")
