"""Joins by key: dictionaries, memories, aliases, revisions, prices, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, memory_key
from .lineage import cut_lineage
from .ordered import Ordered, null_safe
from .sequences import as_of

def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def dictionary_fill(df: DataFrame, dictionary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The fixed dictionary wins over the value at hand; of several entries of one key, the smallest value."""
    d = dictionary.groupBy(*keys).agg(F.min(value).alias("__dict"))
    return df.join(d, keys, "left").withColumn(value, F.coalesce("__dict", value)).drop("__dict")


def _memory_keys(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn("__mk", F.when((_filled(source).isNotNull()) & _filled(target).isNotNull(),
                                        F.concat_ws("\n", memory_key(F.col(source)), memory_key(F.col(target)))))


def translation_memory(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Memory key to value, only for keys with exactly one distinct value."""
    known = _memory_keys(df, source, target).filter(F.col("__mk").isNotNull() & _filled(value).isNotNull())
    per_key = known.groupBy("__mk").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return per_key.filter("__lo = __hi").select(F.col("__mk").alias("memory_key"), F.col("__lo").alias("value"))


def restore(df: DataFrame, memory: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Fill missing values from the memory and flag the restored rows."""
    keyed = _memory_keys(df, source, target).withColumn("__need", _filled(value).isNull())
    j = keyed.join(memory.select(F.col("memory_key").alias("__mk"), F.col("value").alias("__v")), "__mk", "left")
    return j.select(*[c for c in df.columns if c != value], F.when(F.col("__need"), F.col("__v")).otherwise(F.col(value)).alias(value),
                    (F.col("__need") & F.col("__v").isNotNull()).alias("restored"))


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the left table that the right one lacks, sorted."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti").orderBy(*keys)


def require_existing(df: DataFrame, references: list[tuple[str, DataFrame, str]], report: list[str]) -> DataFrame:
    """Violations: one row per reference whose target is missing; references are (column, table, key)."""
    out = None
    for col, table, key in references:
        bad = df.join(table.select(F.col(key).alias(col)).distinct(), col, "left_anti").select(
            *report, F.lit(col).alias("reference"), F.col(col).cast("string").alias("value"))
        out = bad if out is None else out.unionByName(bad)
    return out


def reconcile(marks: DataFrame, have: DataFrame, key: str, page: str) -> DataFrame:
    """Per key: how many pages mark it, the first and last of them, and whether it is playable, missing or unused."""
    m = marks.groupBy(key).agg(F.countDistinct(page).alias("pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    j = m.join(have.select(key).distinct().withColumn("__have", F.lit(True)), key, "full")
    state = F.when(F.col("pages").isNull(), "unused").when(F.col("__have").isNull(), "missing").otherwise("playable")
    return j.select(key, F.coalesce("pages", F.lit(0)).alias("pages"), "first_page", "last_page", state.alias("state"))


def missing_marks(marks: DataFrame, have: DataFrame, key: str, page: str) -> DataFrame:
    """Every (key, page) whose key is not available, as rows."""
    return marks.select(key, page).distinct().join(have.select(key), key, "left_anti")


def next_larger(values: DataFrame, steps: DataFrame, need: str, step: str, out: str = "step") -> DataFrame:
    """Smallest step that is at least the need, else the largest step."""
    largest = steps.agg(F.max(step)).scalar()
    found = as_of(values, steps, [], -F.col(need), -F.col(step), F.col(step), out)
    return found.withColumn(out, F.coalesce(out, largest))


def _grams(df: DataFrame, text: str, size: int) -> DataFrame:
    """Every distinct run of ``size`` characters of each text, as (text, __g)."""
    chars = df.select(text).withColumn("__c", F.filter(F.split(text, ""), lambda c: c != ""))
    run = lambda c, i: F.concat(c, *[F.get("__c", i + k) for k in range(1, size)])
    starts = F.slice("__c", 1, F.greatest(F.size("__c") - (size - 1), F.lit(0)))
    return chars.select(text, F.explode(F.array_distinct(F.transform(starts, run))).alias("__g"))


def contained(short: DataFrame, long: DataFrame, size: int) -> DataFrame:
    """Pairs (s, l) of distinct texts in which ``l`` holds ``s``, for texts ``s`` of at least ``size`` characters.

    An inverted index of the runs of ``size`` characters of ``long``: a text is looked up by the rarest of its runs only, and not at all if
    the index lacks one of them; the few texts that share that run are compared.
    """
    index = _grams(long, "l", size)
    known = index.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    rare = (_grams(short, "s", size).join(known, "__g", "left").groupBy("s")
            .agg(F.min(F.struct("__n", "__g")).alias("__r"), F.count_if(F.col("__n").isNull()).alias("__gone")).filter("__gone = 0"))
    return rare.select("s", F.col("__r.__g").alias("__g")).join(index, "__g").filter(F.contains("l", "s")).select("s", "l")


def match_alias(speakers: DataFrame, aliases: DataFrame, manual: DataFrame | None, *, key: str | list[str] = "key", group: Column | None = None, min_partial: int = 3) -> DataFrame:
    """Character of each speaker: manual choice, then an exact alias, then a partial one.

    A speaker has one or several keys (columns); the first that is not empty finds its manual choice, and all of at least two
    characters are compared with the aliases.  ``aliases`` has the columns character, place (order of the characters) and alias.  A manual
    choice of ``none`` means no character.  In a partial match one text holds the other, the shorter of which has at least ``min_partial``
    characters; the first character in order wins.
    """
    names = [key] if isinstance(key, str) else list(key)
    first = F.min(F.struct("place", "character")).alias("hit")
    named = aliases.filter(F.length("alias") >= 2).groupBy("alias").agg(first)
    people = speakers.filter(~group) if group is not None else speakers
    each = people.select(*names, F.explode(F.array_distinct(F.array(*names))).alias("k")).filter(F.length("k") >= 2).distinct()
    keys, texts = each.select("k").distinct(), named.select("alias")
    inside_alias = contained(keys.select(F.col("k").alias("s")), texts.select(F.col("alias").alias("l")), min_partial).select(F.col("s").alias("k"), F.col("l").alias("alias"))
    inside_key = contained(texts.select(F.col("alias").alias("s")), keys.select(F.col("k").alias("l")), min_partial).select(F.col("l").alias("k"), F.col("s").alias("alias"))
    part = inside_alias.unionByName(inside_key).join(named, "alias").groupBy("k").agg(F.min("hit").alias("partial"))
    hits = each.join(named.select(F.col("alias").alias("k"), F.col("hit").alias("exact")), "k", "left").join(part, "k", "left")
    found = hits.groupBy(*names).agg(F.min("exact").alias("exact"), F.min("partial").alias("partial"))
    j = (speakers.withColumn("__key", F.coalesce(*[_filled(n) for n in names])).alias("l")
         .join(found.alias("r"), null_safe("l", "r", names), "left").select("l.*", "r.exact", "r.partial"))
    if manual is not None:
        j = j.join(manual.groupBy(F.col("key").alias("__key")).agg(F.min("character").alias("__chosen")), "__key", "left")
    else:
        j = j.withColumn("__chosen", F.lit(None).cast("string"))
    ok = F.lit(True) if group is None else ~group
    tier = (F.when(~ok, None).when(F.col("__chosen") == "none", None).when(F.col("__chosen").isNotNull(), "manual")
            .when(F.col("exact").isNotNull(), "exact").when(F.col("partial").isNotNull(), "partial"))
    j = j.withColumn("tier", tier)
    name = F.when(F.col("tier") == "manual", F.col("__chosen")).when(F.col("tier") == "exact", F.col("exact.character")).when(F.col("tier") == "partial", F.col("partial.character"))
    return j.withColumn("character", name).select(*speakers.columns, "character", "tier")


# -- revisions ---------------------------------------------------------------------

def match_revision(new: DataFrame, old: DataFrame, page: list[str], ident: str, same: list[str], order: list[str]) -> DataFrame:
    """Old identity of each new block (column ``matched_id``) and its lasting id (column ``block_id``).

    The same id matches first; rows that repeat an id match one to one in reading order.  The rest pairs up, one
    to one and in reading order, with unmatched old blocks that agree in ``same`` (type and source hash).  A new block gets an id from its content.
    """
    numbered_new = Ordered(new, [*page, ident], order).add(__n=("row",)).done()
    numbered_old = Ordered(old, [*page, ident], order).add(__n=("row",)).done()
    old_ids = numbered_old.select(*page, F.col(ident).alias("__old"), "__n")
    by_id = (numbered_new.alias("l").join(old_ids.alias("r"), null_safe("l", "r", [*page, "__n"]) & (F.col(f"l.{ident}") == F.col("r.__old")), "left")
             .select("l.*", "r.__old"))
    by_id = cut_lineage(by_id)
    taken = by_id.filter("__old IS NOT NULL").select(*page, F.col("__old").alias(ident), "__n")
    free_old = (numbered_old.alias("l").join(taken.alias("r"), null_safe("l", "r", [*page, "__n"]) & (F.col(f"l.{ident}") == F.col(f"r.{ident}")), "left_anti")
                .drop("__n"))
    by_id = by_id.drop("__n")
    ranked_old = Ordered(free_old, page + same, order).add(__k=("row",)).done().select(*page, *same, "__k", F.col(ident).alias("__pair"))
    free_new = by_id.filter("__old IS NULL").drop("__old")
    ranked_new = Ordered(free_new, page + same, order).add(__k=("row",)).done()
    paired = (ranked_new.alias("l").join(ranked_old.alias("r"), null_safe("l", "r", page + same + ["__k"]), "left")
              .select(*[F.col(f"l.{c}") for c in new.columns], F.col("r.__pair").alias("matched_id")))
    both = by_id.filter("__old IS NOT NULL").withColumnRenamed("__old", "matched_id").select(*new.columns, "matched_id").unionByName(paired)
    fresh = F.concat(F.lit("b-"), F.substring(F.sha2(F.to_json(F.struct(*page, *same, *order)), 256), 1, 16))
    return both.withColumn("block_id", F.coalesce("matched_id", ident, fresh))


def carry_translations(matched: DataFrame, old: DataFrame, page: list[str], ident: str, source_hash: str, value: str) -> DataFrame:
    """Old value for blocks whose source is unchanged, even if the wording changed; a new value wins."""
    o = old.select(*page, F.col(ident).alias("matched_id"), F.col(source_hash).alias("__h"), F.col(value).alias("__v"))
    j = matched.join(o, [*page, "matched_id"], "left")
    kept = F.when(F.col("__h") == F.col(source_hash), F.col("__v"))
    return j.withColumn(value, F.coalesce(_filled(value), kept)).select(*matched.columns)


def is_subsequence(inner: Column, outer: Column) -> Column:
    """All characters of ``inner`` occur in ``outer`` in this order; one step a character of ``outer``."""
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    def reached(wanted: Column) -> Column:
        return F.aggregate(chars(outer), F.lit(0), lambda n, ch: n + F.when(ch == F.get(wanted, n), 1).otherwise(0)) == F.size(wanted)
    return (F.length(inner) > 0) & (F.length(inner) <= F.length(outer)) & let(chars(inner), reached)


def revision_regressions(new: DataFrame, old: DataFrame, page: list[str], ident: str, value: str, *, alternate: list[str], region: list[str], text: str,
                         optional: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """Values that were present before and are gone now, by page and id.

    A value survives when the block with its id, or one with the same alternate key, carries a value; or
    when the translated pieces of its region, joined in ``order`` (default: by id), hold its characters in order.
    Optional rows (glossary terms) may disappear.
    """
    had = old.filter(_filled(value).isNotNull())
    if optional is not None:
        had = had.filter(~optional)
    now = new.filter(_filled(value).isNotNull())
    rest = had.join(now.select(*page, ident), [*page, ident], "left_anti")
    rest = rest.join(now.select(*page, *alternate), [*page, *alternate], "left_anti")
    letters = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "")
    # Only regions that still matter are put together.
    wanted = rest.select(*page, *region).distinct()
    pieces = (new.join(wanted, [*page, *region], "left_semi").groupBy(*page, *region)
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*(order or []), ident])], F.col(text).alias("t")))), lambda p: p["t"]), "").alias("__now"),
                   F.count_if(_filled(value).isNull()).alias("__bare")))
    j = rest.join(pieces, [*page, *region], "left")
    split = (F.col("__bare") == 0) & is_subsequence(letters(F.col(text)), letters(F.col("__now")))
    return j.filter(~F.coalesce(split, F.lit(False))).select(*page, ident, F.col(value).alias("lost_value"))


# -- names and records -----------------------------------------------------------------

def correct_by_consensus(names: DataFrame, evidence: DataFrame, group: str, name: str, seen: str, confidence: str, *, threshold: float = 0.9, min_groups: int = 2) -> DataFrame:
    """Replace a name that its group's evidence does not show by a known one that differs in one character.

    The replacement must be shown with high confidence in the same group and in at least ``min_groups``
    groups.  Names that differ in one character share a pattern with that character masked.
    """
    distinct = names.select(group, name).distinct()
    shown = evidence.filter(F.col(confidence) >= threshold).select(group, F.col(seen).alias(name)).distinct()
    known = distinct.select(name).distinct()
    strong = shown.groupBy(name).agg(F.count(F.lit(1)).alias("__g")).filter(F.col("__g") >= min_groups).join(known, name, "left_semi")
    def masked(df, out):
        spots = F.sequence(F.lit(1), F.length(name))
        m = F.transform(spots, lambda i: F.struct(i.alias("i"), F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.lit("\u0000"), F.substring(F.col(name), i + 1, F.length(name))).alias("m")))
        return df.filter(F.length(name) >= 2).select(group, F.col(name).alias(out), F.explode(m).alias("__m")).select(group, out, "__m.i", "__m.m")
    doubtful = distinct.join(shown, [group, name], "left_anti")
    candidates = masked(shown.join(strong.select(name), name, "left_semi"), "__new")
    first = candidates.groupBy(group, "i", "m").agg(F.min("__new").alias("__new"))
    # A doubtful name is not shown in its group, so it is never its own candidate.
    best = masked(doubtful, "__old").join(first, [group, "i", "m"]).groupBy(group, "__old").agg(F.min("__new").alias("corrected"))
    return names.join(best.withColumnRenamed("__old", name), [group, name], "left")


def merge_fill_empty(current: DataFrame, incoming: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Merge profiles by name without regard to case: values at hand stay, empty ones are filled, new names are added."""
    k = F.lower(F.trim(key))
    def pick(df, tag):
        aggs = [F.min_by(_filled(f), F.when(_filled(f).isNotNull(), F.col(order))).alias(f"{tag}_{f}") for f in fields]
        return (df.withColumn("__k", k).filter("__k <> ''").groupBy("__k")
                .agg(F.min_by(F.trim(key), order).alias(f"{tag}_name"), *aggs))
    j = pick(current, "c").join(pick(incoming, "n"), "__k", "full")
    return j.select(F.coalesce("c_name", "n_name").alias(key), *[F.coalesce(f"c_{f}", f"n_{f}").alias(f) for f in fields], F.col("c_name").isNull().alias("added"))


def merge_keep_existing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows at hand stay as they are; only new keys are added."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti").select(*current.columns))


# -- prices and states ---------------------------------------------------------------------

# Frame height per resolution name.
HEIGHTS = {"480p": 480, "720p": 720, "768p": 768, "1080p": 1080, "2k": 1440, "4k": 2160}

# What a mark in a price's name is worth; the first mark found of each line counts.
SKU_WEIGHTS = [[("own resolution", 4), ("any resolution", -3)],
               [("wanted sound", 2), ("other sound", -2)],
               [("from text", 1)]]


def price_estimate(requests: DataFrame, skus: DataFrame) -> DataFrame:
    """Estimated price of each request from the price list of its model.

    ``requests``: model, resolution, aspect, audio, duration and any other columns.  ``skus``: model, sku,
    price.  The best per-second price wins (resolution, then audio, then text-to-video); without one the
    best video-token price is used; a minimum charge in cents applies.  Prices are ranked once per
    distinct (model, resolution, audio), not per request.
    """
    k = F.lower("sku")
    usable = skus.filter((F.col("price") > 0)).withColumn("sku", k)
    combos = requests.select("model", F.lower("resolution").alias("res"), "audio").distinct()
    s = F.col("sku")
    marks = {"own resolution": (F.col("res") != "") & F.contains(s, F.col("res")), "any resolution": s.rlike("\\d+p|4k|2k"),
             "wanted sound": F.contains(s, F.when(F.col("audio"), "with_audio").otherwise("without_audio")),
             "other sound": F.contains(s, F.when(F.col("audio"), "without_audio").otherwise("with_audio")), "from text": F.contains(s, F.lit("text_to_video"))}
    score = sum(F.coalesce(*[F.when(marks[mark], weight) for mark, weight in rule], F.lit(0)) for rule in SKU_WEIGHTS)
    offers = combos.join(usable, "model").withColumns({
        "score": score, "second": s.rlike("duration_seconds|per_second|output_second") & ~F.contains(s, F.lit("megapixel")),
        "token": s.startswith("video_tokens") & ~F.contains(s, F.lit("video_input")), "sound": F.contains(s, F.lit("with_audio"))})
    # With sound, a price that includes it goes before any that does not.
    rank = F.struct((F.col("audio") & F.col("sound")).alias("a"), "score", (-F.col("price")).alias("p"), "sku")
    plain = F.struct("score", (-F.col("price")).alias("p"), "sku")
    best = offers.groupBy("model", "res", "audio").agg(
        F.max_by(F.struct("sku", "price"), F.when(F.col("second"), rank)).alias("__s"),
        F.max_by(F.struct("sku", "price"), F.when(F.col("token"), plain)).alias("__t"),
        F.min(F.when(s.startswith("minimum_cents"), F.col("price"))).alias("__min"))
    j = requests.withColumn("res", F.lower("resolution")).join(best, ["model", "res", "audio"], "left")
    seconds = F.col("__s.price") * F.when(F.contains(F.col("__s.sku"), F.lit("cents")), 0.01).otherwise(1.0) * F.col("duration")
    height = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HEIGHTS.items() for x in kv]), F.col("res")), F.lit(720))
    parts = F.split(F.coalesce(_filled("aspect"), F.lit("16:9")), ":")
    ratio = F.get(parts, F.lit(0)).try_cast("double") / F.nullif(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0))
    width = F.floor(height * F.coalesce(ratio, F.lit(16 / 9)) + 0.5)  # an aspect that is no ratio counts as 16:9
    tokens = F.col("__t.price") * (width * height * 24 * F.col("duration") / 1024)
    usd = F.coalesce(seconds, tokens)
    return j.withColumn("usd", F.when(F.col("duration") > 0, F.when(usd.isNotNull(), F.greatest(usd, F.col("__min") / 100)))).select(*requests.columns, "usd")


def state_matrix(entities: DataFrame, ident: str, count: str, jobs: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per entity and number 1..N with its state.

    ``jobs``: id, n, state; ``facts``: id, n, has_layout, failed, changed_ms, published_ms.  Queued or
    running work goes first, then done, then error, else none.  A page is stale when it changed more than
    two seconds after it was published.
    """
    grid = entities.select(F.col(ident).alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))).alias("n")).filter(F.col("n") >= 1)
    active = jobs.filter(F.col("state").isin("queued", "running")).groupBy("id", "n").agg(F.max("state").alias("__job"))
    j = grid.join(active, ["id", "n"], "left").join(facts, ["id", "n"], "left")
    state = (F.coalesce("__job", F.when(F.col("has_layout"), "done").when(F.col("failed"), "error"), F.lit("none")))
    stale = F.col("__job").isNull() & F.col("has_layout") & (F.col("changed_ms") > F.col("published_ms") + 2000)
    return j.select("id", "n", state.alias("state"), F.coalesce(stale, F.lit(False)).alias("stale"))
