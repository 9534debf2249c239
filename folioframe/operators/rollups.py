"""Aggregations: journals, activity series, scores, medians, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tone_count, toneless
from .lineage import cut_lineage
from .ordered import Ordered, null_safe, weighted_rank_pick

LOCAL_ZONE = "Asia/Qyzylorda"


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def _filled(c: str | Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c if isinstance(c, Column) else F.col(c), F.lit(""))


# -- journals ------------------------------------------------------------------

def model_rollup(df: DataFrame, keys: list[str], kind: str, cost: str, subscription: str, rating: str) -> DataFrame:
    """Per provider and model: kinds, counts, cost of the priced rows and the average rating.

    A missing cost is unknown, not zero, and subscription rows carry no cost.  The kinds are a small fixed set.
    """
    priced = ~F.col(subscription) & F.col(cost).isNotNull()
    rated = F.coalesce(F.col(rating), F.lit(0)) > 0
    return (df.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(priced, F.col(cost))), F.lit(0)).alias("cost"), F.count_if(priced).alias("priced"),
        F.count_if(F.col(subscription)).alias("subscription"), F.count_if(rated).alias("rated"),
        F.avg(F.when(rated, F.col(rating))).alias("avg_rating"))
        .orderBy(F.desc_nulls_last("avg_rating"), F.desc("n"), *keys))


def journal_totals(df: DataFrame, kind: str, first_kind: str, cost: str, subscription: str, rating: str) -> DataFrame:
    spend = F.when(~F.col(subscription), F.coalesce(F.col(cost), F.lit(0))).otherwise(0)
    return df.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col(kind) == first_kind).alias("first_kind"),
                  F.count_if(F.col(kind) != first_kind).alias("other_kinds"), F.sum(spend).alias("spend"),
                  F.count_if(F.col(subscription)).alias("subscription"), F.count_if(F.coalesce(F.col(rating), F.lit(0)) > 0).alias("rated"))


def group_rollup(entries: DataFrame, groups: DataFrame, on: str, group: str, number: str) -> DataFrame:
    """Entries and highest number per group; entries without a group form a last group of their own."""
    per_key = entries.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.max(number).alias("last"))
    joined = per_key.join(groups.select(on, group), on, "left")
    rolled = joined.groupBy(group).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return rolled.orderBy(F.col(group).isNull(), group)


def key_holders(df: DataFrame, source_key: str, digest: str, order: list[str]) -> DataFrame:
    """(source key, __since): when each source key was taken, going through the rows in order.

    A row takes its key if nobody holds that and its content has no key yet.  So the taken pairs are the greedy matching of keys and
    contents: a pair that is the earliest left of both its key and its content is taken, and pairs with either of them are out.  A round takes all
    such pairs at once; rounds grow with the longest chain of pairs that wait for each other.
    """
    at = F.struct(*order)
    loose = F.when(_filled(digest).isNull(), at)  # a row without content is a content of its own
    pairs = df.filter(_filled(source_key).isNotNull()).groupBy(F.col(source_key).alias("__k"), _filled(digest).alias("__h"), loose.alias("__own")).agg(F.min(at).alias("__at"))
    pairs, taken = cut_lineage(pairs), None
    while True:
        of_key = pairs.groupBy("__k").agg(F.min("__at").alias("__at"))
        of_content = pairs.groupBy("__h", "__own").agg(F.min("__at").alias("__at"))
        first = pairs.join(of_key, ["__k", "__at"]).alias("l").join(of_content.alias("r"), null_safe("l", "r", ["__h", "__own", "__at"])).select("l.*")
        first = cut_lineage(first)
        if first.isEmpty():
            return (taken if taken is not None else first).select(F.col("__k").alias(source_key), F.col("__at").alias("__since"))
        taken = first if taken is None else taken.unionByName(first)
        rest = pairs.join(first.select("__k"), "__k", "left_anti").alias("l")
        pairs = cut_lineage(rest.join(first.alias("r"), null_safe("l", "r", ["__h", "__own"]), "left_anti"))


def dedup_richest(df: DataFrame, source_key: str, digest: str, order: list[str], fill: list[str],
                  linked: dict[str, list[str]] | None = None, unknown: str = "^unknown") -> DataFrame:
    """One row per content hash: the earliest one, with each empty field filled by the first later value.

    Rows count in order (``order`` has no ties).  A row whose source key an earlier row holds is dropped; otherwise it is merged into the row of
    the same content, which takes over its key if it has none; otherwise it stays and holds its key.  ``linked`` names fields that are taken
    together with a main field; text matching ``unknown`` counts as empty there.
    """
    at = F.struct(*order)
    linked = linked or {}
    since = key_holders(df, source_key, digest, order)
    held = df.alias("l").join(since.alias("r"), F.col(f"l.{source_key}") == F.col(f"r.{source_key}"), "left")
    rows = held.filter(F.col("__since").isNull() | (F.struct(*[F.col(f"l.{c}") for c in order]) <= F.col("__since"))).select("l.*")
    fill = [source_key, *fill]
    plain = [c for c in df.columns if c not in (digest, *fill, *linked, *[x for v in linked.values() for x in v])]
    aggs = [F.min_by(F.struct(*plain), at).alias("__id"), F.count(F.lit(1)).alias("copies")]
    for c in fill:
        v = _filled(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c)
        aggs.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(c))
    for main, others in linked.items():
        known = F.col(main).isNotNull() & (F.col(main) != "") & ~F.col(main).rlike(unknown)
        group = F.struct(main, *others)
        aggs.append(F.coalesce(F.min_by(group, F.when(known, at)), F.min_by(group, at)).alias(f"__{main}"))
    merged = rows.filter(_filled(digest).isNotNull()).groupBy(digest).agg(*aggs).select(
        digest, "__id.*", *fill, *[f"__{m}.*" for m in linked], "copies")
    loose = rows.filter(_filled(digest).isNull()).withColumn("copies", F.lit(1).cast("long"))
    return merged.unionByName(loose.select(*merged.columns))


# -- activity --------------------------------------------------------------------

def local_day(ts: str, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))


def daily_activity(df: DataFrame, keys: list[str], ts: str, seconds: str, word: str, *, zone: str = LOCAL_ZONE, keep: int = 370) -> DataFrame:
    """Seconds and distinct words per local day; the last ``keep`` days with any activity."""
    daily = df.withColumn("day", local_day(ts, zone)).groupBy(*keys, "day").agg(
        F.sum(F.greatest(F.coalesce(F.col(seconds), F.lit(0)), F.lit(0))).alias("seconds"), F.countDistinct(_filled(word)).alias("words"))
    # One row per key and day is left, so the ranking is small.
    return (Ordered(daily, keys, [-F.unix_date("day")]).add(__age=("row",)).done().filter(F.col("__age") <= keep).drop("__age"))


def week_series(df: DataFrame, ts: str, seconds: str, word: str, anchor: Column, *, zone: str = LOCAL_ZONE) -> DataFrame:
    """Monday to Sunday around the anchor day: minutes and distinct words, zero where nothing happened."""
    monday = F.date_sub(anchor, F.weekday(anchor))
    week = df.withColumn("day", local_day(ts, zone)).filter(F.col("day").between(monday, F.date_add(monday, 6)))
    daily = daily_activity(week, [], ts, seconds, word, zone=zone)
    days = df.sparkSession.range(7).select(F.date_add(monday, F.col("id").cast("int")).alias("day"))
    return days.join(F.broadcast(daily), "day", "left").select(
        "day", round_half_up(F.coalesce("seconds", F.lit(0)) / 60).alias("minutes"), F.coalesce("words", F.lit(0)).alias("words"))


def month_buckets(df: DataFrame, ts: str, seconds: str, word: str, anchor: Column, *, zone: str = LOCAL_ZONE) -> DataFrame:
    """Days 1-7, 8-14 ... of the anchor's month, with words counted once per bucket."""
    first, length = F.trunc(anchor, "month"), F.dayofmonth(F.last_day(anchor))
    month = df.withColumn("day", local_day(ts, zone)).filter(F.trunc("day", "month") == first)
    rolled = month.withColumn("bucket", F.floor((F.dayofmonth("day") - 1) / 7)).groupBy("bucket").agg(
        F.sum(F.greatest(F.coalesce(F.col(seconds), F.lit(0)), F.lit(0))).alias("seconds"), F.countDistinct(_filled(word)).alias("words"))
    buckets = df.sparkSession.range(5).select(F.col("id").alias("bucket")).filter(F.col("bucket") * 7 < length)
    return buckets.join(F.broadcast(rolled), "bucket", "left").select(
        (F.col("bucket") * 7 + 1).alias("first_day"), F.least(F.col("bucket") * 7 + 7, length).alias("last_day"),
        round_half_up(F.coalesce("seconds", F.lit(0)) / 60).alias("minutes"), F.coalesce("words", F.lit(0)).alias("words"))


# -- coverage and contracts --------------------------------------------------------

def coverage(fields: DataFrame, keys: list[str], translation: str) -> DataFrame:
    """Total and translated fields per key."""
    return fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count(_filled(translation)).alias("translated"))


def missing_fields(fields: DataFrame, translation: str, report: list[str]) -> DataFrame:
    return fields.filter(_filled(translation).isNull()).select(*report)


def contract_state(subjects: DataFrame, violations: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """failed with any error, review with any warning, else passed; one row per subject."""
    worst = violations.groupBy(*keys).agg(F.count_if(F.col(severity) == "error").alias("errors"),
                                          F.count_if(F.col(severity) == "warning").alias("warnings"))
    state = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "review").otherwise("passed")
    return (subjects.select(*keys).distinct().join(worst, keys, "left").na.fill(0, ["errors", "warnings"]).withColumn("state", state))


# -- distributions ---------------------------------------------------------------------

def binned_mode(df: DataFrame, part: list[str], col: str, shift: int = 3) -> DataFrame:
    """Centre and share of the most frequent bin of width 2^shift; the smallest bin wins a tie."""
    counts = df.withColumn("__bin", F.shiftright(F.col(col).cast("long"), shift)).groupBy(*part, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    top = counts.groupBy(*part).agg(F.max(F.struct("__c", (-F.col("__bin")).alias("b"))).alias("__m"), F.sum("__c").alias("n"))
    centre = -F.col("__m.b") * (1 << shift) + ((1 << shift) // 2)
    return top.select(*part, centre.alias("centre"), (F.col("__m.__c") / F.col("n")).alias("share"), "n")


def median_stats(df: DataFrame, part: list[str], col: str) -> DataFrame:
    """The upper middle value and the averaged median."""
    n = F.col("__n")
    m = weighted_rank_pick(df, part, col, {"__lo": F.floor((n + 1) / 2), "upper_median": F.floor(n / 2) + 1})
    return m.select(*part, "n", "upper_median", ((F.col("__lo") + F.col("upper_median")) / 2).alias("median"))


# -- documents ---------------------------------------------------------------------------

def build_documents(pages: DataFrame, book: str, lesson: str, page: str, header: list[str], title: str, opener: Column, kind: Column) -> DataFrame:
    """Pages of every lesson in order, with the lesson's header on each row.

    The header comes from the first page and the title from the first opener page, else from the first
    page.  The pages stay rows instead of one array, so a lesson of any size is never gathered in a task.
    """
    heads = pages.groupBy(book, lesson).agg(
        F.min_by(F.struct(*header), page).alias("__h"), F.min_by(title, F.when(opener, F.col(page))).alias("__opener"),
        F.min_by(title, page).alias("__first"), F.count(F.lit(1)).alias("pages"))
    number = F.col(lesson).cast("long")
    heads = heads.select(book, lesson, "__h.*", F.coalesce("__opener", "__first").alias("lesson_title"), "pages",
                         F.format_string("%s-%03d", F.col(book).cast("string"), number).alias("lesson_id"),
                         F.format_string("%s|%04d", F.col(book).cast("string"), number).alias("sort_key"), kind.alias("kind"))
    placed = Ordered(pages, [book, lesson], [page]).add(position=("row",)).done()
    extra = [c for c in pages.columns if c not in (*header, book, lesson)]
    return placed.select(book, lesson, *extra, "position").join(heads, [book, lesson])


def distinct_first(sources: list[DataFrame], native: str, reading: str, required: Column, order: list[str]) -> DataFrame:
    """First complete entry per native text and reading, over sources in order of priority."""
    union = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        union = s if union is None else union.unionByName(s)
    key = F.concat_ws("/", native, F.lower(F.regexp_replace(reading, "\\s+", "")))
    complete = union.filter((F.col(native) != "") & (F.col(reading) != "") & required).withColumn("__k", key)
    rest = [c for c in union.columns]
    best = complete.groupBy("__k").agg(F.min_by(F.struct(*rest), F.struct("source", *order)).alias("__r"))
    return best.select("__r.*")


def symbols(text: Column, keep: str) -> Column:
    """Distinct symbols of a text matching a pattern, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({keep})"), F.lit(1)))


def symbol_inventory(docs: DataFrame, order: str, text: str, kept: DataFrame, dictionary: DataFrame, pattern: str) -> DataFrame:
    """Every symbol once: kept ones first, then by first appearance; kept fields win over the dictionary.

    ``kept`` and ``dictionary`` have the columns symbol and reading; ``kept`` also has position.
    """
    seen = docs.select(F.col(order).alias("__d"), F.posexplode(symbols(F.col(text), pattern)).alias("__p", "symbol"))
    first = seen.groupBy("symbol").agg(F.min(F.struct("__d", "__p")).alias("__at"))
    both = (first.join(kept.select("symbol", F.col("position").alias("__kept"), F.col("reading").alias("__mine")), "symbol", "full")
            .join(dictionary.select("symbol", F.col("reading").alias("__dict")), "symbol", "left"))
    both = both.withColumns({"__late": F.col("__kept").isNull(), "reading": F.coalesce(_filled("__mine"), "__dict", F.lit(""))})
    done = Ordered(both, [], ["__late", "__kept", "__at", "symbol"]).add(position=("row",)).done()
    return done.select("symbol", "reading", "position", F.col("__at.__d").alias("first_seen"))


def option_completeness(questions: DataFrame, options: DataFrame, keys: list[str], letter: str, letters: list[str]) -> DataFrame:
    """Questions whose options are not exactly the given letters, with what is missing and how many there are."""
    got = options.groupBy(*keys, letter).agg(F.count(F.lit(1)).alias("__c"))
    flags = [F.max(F.when(F.col(letter) == x, 1).otherwise(0)).alias(f"__{x}") for x in letters]
    per = got.groupBy(*keys).agg(F.sum("__c").alias("options"), *flags)
    joined = questions.select(*keys).distinct().join(per, keys, "left").na.fill(0)
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__{x}") == 0, F.lit(x)) for x in letters])), "")
    return joined.withColumn("missing", missing).filter((F.col("missing") != "") | (F.col("options") != len(letters))).select(*keys, "options", "missing")


def cell_coverage(cells: DataFrame, table: list[str], row: str, col: str, rowspan: str, colspan: str, rows: str, cols: str) -> DataFrame:
    """Per table: invalid cells, overlapping positions and gaps after expanding the spans."""
    ok = ((F.col(row) >= 0) & (F.col(col) >= 0) & (F.col(rowspan) >= 1) & (F.col(colspan) >= 1)
          & (F.col(row) + F.col(rowspan) <= F.col(rows)) & (F.col(col) + F.col(colspan) <= F.col(cols)))
    flagged = cells.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    grid = (flagged.filter("__ok").withColumn("__r", F.explode(F.sequence(F.col(row), F.col(row) + F.col(rowspan) - 1)))
            .withColumn("__c", F.explode(F.sequence(F.col(col), F.col(col) + F.col(colspan) - 1)))
            .groupBy(*table, "__r", "__c").agg(F.count(F.lit(1)).alias("__n")))
    filled = grid.groupBy(*table).agg(F.count(F.lit(1)).alias("filled"), F.sum(F.col("__n") - 1).alias("overlapping"))
    sizes = flagged.groupBy(*table).agg(F.max(F.col(rows) * F.col(cols)).alias("__size"), F.count_if(~F.col("__ok")).alias("invalid"))
    done = sizes.join(filled, table, "left").na.fill(0, ["filled", "overlapping"])
    return done.select(*table, "invalid", "overlapping", (F.col("__size") - F.col("filled")).alias("gaps"))


# -- scores --------------------------------------------------------------------------------

def best_candidate(candidates: DataFrame, block: list[str], candidate: str, score: str, before: DataFrame, gain: float = 1e-4) -> DataFrame:
    """Best candidate per block when it beats the score before by the gain, else none."""
    top = candidates.groupBy(*block).agg(F.max_by(F.col(candidate), F.struct(F.col(score), -F.col(candidate))).alias("__c"), F.max(score).alias("__s"))
    j = before.join(top, block, "left")
    better = F.coalesce(F.col("__s") > F.col("before") + gain, F.lit(False))
    return j.select(*block, "before", F.when(better, F.col("__c")).alias("chosen"), F.when(better, F.col("__s")).otherwise(F.col("before")).alias("score"))


def revert_regressions(chosen: DataFrame, after: Column, before: Column, chosen_col: str, eps: float = 1e-3) -> DataFrame:
    """Blocks that ended up worse than before lose their choice."""
    worse = after < before - eps
    return chosen.withColumns({"reverted": F.coalesce(worse, F.lit(False)), chosen_col: F.when(~F.coalesce(worse, F.lit(False)), F.col(chosen_col))})


def regression_report(now: DataFrame, base: DataFrame, page: list[str], cell: list[str], score: str, page_drop: float = 0.5, cell_drop: float = 4.0,
                      error: str | None = None) -> DataFrame:
    """Status per page against its accepted scores: error, new, worse, better or same.

    Both inputs hold one row per cell; the score of a page is given by the row whose cell columns are null.  ``error`` names a text column
    of ``now``: a page with any filled value there could not be built and is compared with nothing; the text is kept.
    """
    both = now.alias("l").join(base.select(*page, *cell, F.col(score).alias("__base")).alias("r"), null_safe("l", "r", page + cell), "left").select("l.*", "r.__base")
    whole = F.col(cell[0]).isNull()
    agg = both.groupBy(*page).agg(
        F.max(F.when(whole, F.col(score))).alias("score"), F.max(F.when(whole, F.col("__base"))).alias("base"),
        F.count_if(~whole & (F.col(score) - F.col("__base") <= -cell_drop)).alias("dropped_cells"))
    delta = F.round(F.col("score") - F.col("base"), 1)
    status = (F.when(F.col("base").isNull(), "new").when((delta <= -page_drop) | (F.col("dropped_cells") > 0), "worse")
              .when(delta >= page_drop, "better").otherwise("same"))
    done = agg.withColumns({"delta": delta, "status": status})
    if error is None:
        return done
    failed = now.groupBy(*page).agg(F.min(_filled(error)).alias(error))
    told = done.alias("l").join(failed.alias("r"), null_safe("l", "r", page)).select("l.*", f"r.{error}")
    bad, measured = F.col(error).isNotNull(), ["score", "base", "dropped_cells", "delta"]
    return told.withColumns({"status": F.when(bad, "error").otherwise(F.col("status")), **{c: F.when(~bad, F.col(c)) for c in measured}})


def regression_totals(report: DataFrame, keys: list[str]) -> DataFrame:
    """Pages per status, and the regressions: pages that became worse or could not be built."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("error", "new", "worse", "better", "same")]
    return report.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *counts, F.count_if(F.col("status").isin("worse", "error")).alias("regressions"))


def grid_scores(df: DataFrame, part: list[str], x: Column, y: Column, value: str, rows: int, cols: int, *, worst: int = 6, below: float | None = None) -> DataFrame:
    """Mean per cell of a rows x cols grid over unit coordinates, with the worst cells ranked."""
    cell = lambda v, n: F.least(F.floor(v * n), F.lit(n - 1))
    cells = df.withColumns({"row": cell(y, rows), "col": cell(x, cols)}).groupBy(*part, "row", "col").agg(F.avg(value).alias("score"))
    ranked = Ordered(cells, part, [F.round("score", 6), "row", "col"]).add(rank=("row",)).done()
    bad = F.col("rank") <= worst
    if below is not None:
        bad = bad & (F.col("score") < below)
    return ranked.withColumn("worst", bad)


def array_similarity(a: Column, b: Column, tolerance: float = 24, span: float = 255) -> Column:
    """Share of elements within the tolerance, mean absolute error and whole-array structural similarity."""
    n = F.size(a)
    def mean(arr):
        return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v) / n
    diff = F.zip_with(a, b, lambda p, q: F.abs(p - q))
    ma, mb = mean(a), mean(b)
    va, vb = mean(F.transform(a, lambda v: v * v)) - ma * ma, mean(F.transform(b, lambda v: v * v)) - mb * mb
    cov = mean(F.zip_with(a, b, lambda p, q: p * q)) - ma * mb
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    share = F.size(F.filter(diff, lambda v: v <= tolerance)) / n
    return F.struct(share.alias("share"), mean(diff).alias("mae"), ssim.alias("ssim"))


def precision_recall_f1(hits_in_truth: Column, truth: Column, hits_in_found: Column, found: Column, empty_below: int = 12) -> Column:
    """F1 of near matches; 1 where there is next to nothing on both sides, 0 where nothing agrees."""
    recall = F.when(truth > 0, hits_in_truth / F.nullif(truth, F.lit(0))).otherwise(1.0)
    precision = F.when(found > 0, hits_in_found / F.nullif(found, F.lit(0))).otherwise(1.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / F.nullif(recall + precision, F.lit(0.0))).otherwise(0.0)
    return F.when(truth + found < empty_below, 1.0).otherwise(f1)


def fidelity_score(ssim: Column, ink: Column, colour: Column) -> Column:
    return 100 * (0.45 * F.greatest(F.lit(0.0), ssim) + 0.35 * ink + 0.2 * colour)


# -- words ---------------------------------------------------------------------------------------

def best_variant(words: DataFrame, word: str, rank: Column) -> DataFrame:
    """Each word with the spelling of its toneless form that carries the most marks; its capital letter stays.

    The highest ``rank`` wins among spellings with equally many marks.
    """
    w = F.col(word)
    keyed = words.withColumns({"__k": toneless(w), "__m": tone_count(w)})
    best = keyed.filter("__m > 0").groupBy("__k").agg(F.max_by(F.struct(w.alias("w"), F.col("__m").alias("m")), F.struct("__m", rank.alias("r"))).alias("__b"))
    first = F.substring(w, 1, 1)
    cased = F.when(first == F.upper(first), F.concat(F.upper(F.substring("__b.w", 1, 1)), F.expr("substring(__b.w, 2)"))).otherwise(F.col("__b.w"))
    joined = keyed.join(best, "__k", "left")
    return joined.withColumn("printed", F.when(F.col("__b.m") > F.col("__m"), cased).otherwise(w)).select(*words.columns, "printed")


def novelty(docs: DataFrame, order: str, text: str, pattern: str, known: DataFrame | None = None) -> DataFrame:
    """Symbols that a document uses first: not in earlier documents and not in the known list (column symbol)."""
    used = docs.select(F.col(order), F.explode(symbols(F.col(text), pattern)).alias("symbol"))
    first = used.groupBy("symbol").agg(F.min(order).alias(order))
    if known is not None:
        first = first.join(known.select("symbol").distinct(), "symbol", "left_anti")
    counts = first.groupBy(order).agg(F.count(F.lit(1)).alias("novel"))
    return docs.select(order).join(counts, order, "left").na.fill(0, ["novel"])


def unit_vote(boxes: DataFrame, page: list[str], x: str, y: str, w: str, h: str, width: Column, height: Column) -> DataFrame:
    """Unit of a page's boxes by 70 percent majority, with the scales that bring them to 0..1.

    Boxes with a value that is null or not finite have no vote; a page with no other boxes is in fractions.
    """
    sound = F.lit(True)
    for c in (x, y, w, h):
        sound = sound & F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False))
    right, low, y = F.when(sound, F.col(x) + F.col(w)), F.when(sound, F.col(y) + F.col(h)), F.when(sound, F.col(y))
    def share(limit):
        return F.avg(F.when(sound, F.when((right <= limit) & (low <= limit), 1.0).otherwise(0.0)))
    v = boxes.groupBy(*page).agg(share(1.05).alias("__f"), share(101).alias("__p"), share(1005).alias("__g"), F.max(right).alias("__mx"),
                                 F.max(low).alias("__my"), F.max(y).alias("__sy"), F.max(width).alias("__w"), F.max(height).alias("__h"))
    grid = (F.col("__g") >= 0.7) & (F.col("__sy") <= 1000) & (~(F.col("__h") > 1050) | (F.col("__sy") < F.col("__h") * 0.66))
    unit = (F.when(F.col("__f").isNull() | (F.col("__f") >= 0.7), "fraction").when(F.col("__p") >= 0.7, "percent").when(grid, "grid1000")
            .when((F.col("__w") > 0) & (F.col("__h") > 0), "pixels").otherwise("scaled"))
    def scale(size, reach):
        return (F.when(F.col("unit") == "fraction", 1.0).when(F.col("unit") == "percent", 0.01).when(F.col("unit") == "grid1000", 0.001)
                .when(F.col("unit") == "pixels", 1 / F.greatest(F.col(size), F.col(reach))).otherwise(1 / F.col(reach)))
    return v.withColumn("unit", unit).select(*page, "unit", scale("__w", "__mx").alias("sx"), scale("__h", "__my").alias("sy"))


def palette(df: DataFrame, channels: list[str], k: int = 10, iterations: int = 8, seed: int = 17) -> DataFrame:
    """Quantised colours and the number of samples of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    data = VectorAssembler(inputCols=channels, outputCol="__v").transform(df)
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="__v", predictionCol="colour").fit(data)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "colour int, centre array<double>")
    counts = model.transform(data).groupBy("colour").agg(F.count(F.lit(1)).alias("samples"))
    return counts.join(F.broadcast(centres), "colour")


def manifest_check(headers: DataFrame, tracks: DataFrame, keys: list[str], ident: str, size: str, duration: str, tolerance: float = 3.0) -> DataFrame:
    """Whether count, bytes and duration of the tracks equal their header (columns count, total_bytes, total_duration)."""
    per_id = tracks.groupBy(*keys, ident).agg(F.count(F.lit(1)).alias("__c"), F.sum(size).alias("__b"), F.sum(duration).alias("__d"))
    sums = per_id.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.sum("__b").alias("__bytes"), F.sum("__d").alias("__dur"), F.count_if(F.col("__c") > 1).alias("duplicate_ids"))
    j = headers.join(sums, keys, "left").na.fill(0, ["__n", "__bytes", "__dur", "duplicate_ids"])
    return j.select(*keys, (F.col("__n") == F.col("count")).alias("count_ok"), (F.abs(F.col("__bytes") - F.col("total_bytes")) < 0.005).alias("bytes_ok"),
                    (F.abs(F.col("__dur") - F.col("total_duration")) <= tolerance).alias("duration_ok"), "duplicate_ids")
