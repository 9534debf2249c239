"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds (term, document, position) of every occurrence of a benchmark term in the corpus, and each document's length
under the empty term; it is a table in the shared folder.  A phrase (a window of consecutive benchmark words) is looked up by
its two rarest terms: their posting lists are shifted by the terms' offsets in the phrase and intersected.  What is left is
compared word by word with the document.

Documents are known by (doc_id, hash of doc_id and text), so repeated rows and null ids are told apart without an extra number.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.lineage import cut_lineage

WINDOW = 10
SMALL_BYTES = 8 << 20  # terms up to this measured size are broadcast, more are shuffled
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; other letters stay as they are (null: none)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), NOT_WORD), "")


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k1"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k2")]


def phrases(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, phrase) with phrase an array of words: every window of an item, or the whole of a shorter one."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("phrase")).distinct()


def _sent_whole(df: DataFrame, text: str) -> DataFrame:
    """``df`` (the column ``text`` and a few fixed ones) marked for broadcast if its measured size allows; else it is shuffled."""
    size = df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index rows (term, k1, k2, pos) of ``terms``, and one row per document with term '' and pos its number of words."""
    terms = terms.union(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    every = docs.select(*_keys(id_col, text_col), F.posexplode(F.array_append(words(F.col(text_col)), F.lit(""))).alias("pos", "term"))
    return every.join(_sent_whole(terms, "term"), "term")


def _rare_terms(known: DataFrame, index: DataFrame, whole_only: bool = True) -> DataFrame:
    """(phrase_id, term, off, need, list): the one or two rarest terms of each phrase whose terms all occur in the corpus.

    Without ``whole_only`` those of every phrase, among its terms that do occur.
    """
    freq = index.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    placed = known.select("phrase_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("off", "term"))
    ranked = placed.join(freq, "term").withColumn("rank", F.row_number().over(Window.partitionBy("phrase_id").orderBy("freq", "off")))
    whole = Window.partitionBy("phrase_id")
    return (ranked.withColumn("found", F.count(F.lit(1)).over(whole)).filter("found = n and rank <= 2" if whole_only else "rank <= 2")
            .select("phrase_id", "term", "off", F.least("n", F.lit(2)).alias("need"), F.col("rank").alias("list")))


def _shifted(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Where each phrase would have to start for its rare terms to be where the index has them."""
    return index.join(_sent_whole(rare, "term"), "term").withColumn("start", F.col("pos") - F.col("off"))


def _numbered(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    found = phrases(benchmark, id_col, text_col, window)
    return cut_lineage(found.withColumn("phrase_id", F.unhex(F.md5(F.concat_ws(" ", "phrase")))))


def build(docs: DataFrame, benchmark: DataFrame, *, window: int, id_col: str, text_col: str, item_col: str,
          item_text_col: str, whole_only: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items of phrases, phrases, index, rare terms), each written once and read by all that follows."""
    of_items = _numbered(benchmark, item_col, item_text_col, window)
    known = of_items.select("phrase_id", "phrase").dropDuplicates(["phrase_id"])
    terms = known.select(F.explode("phrase").alias("term")).distinct()
    index = cut_lineage(postings(docs, terms, id_col, text_col))
    return of_items, known, index, cut_lineage(_rare_terms(known, index, whole_only))


def exact_matches(docs: DataFrame, known: DataFrame, index: DataFrame, rare: DataFrame, window: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(k1, k2, phrase_id, start, n): every occurrence of a phrase."""
    meet = (_shifted(index, rare).filter("start >= 0").groupBy("phrase_id", *KEY, "start")
            .agg(F.bit_or("list").alias("lists"), F.max("need").alias("need")).filter("lists = 2 * need - 1"))  # 1 alone, or 1 and 2
    spots = cut_lineage(meet.select("phrase_id", *KEY, "start"))
    wanted = _sent_whole(spots.select(*KEY).distinct(), "k1")
    read = (docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text")).join(wanted, KEY, "left_semi")
            .dropDuplicates(KEY).select(*KEY, words(F.col("text")).alias("w")))
    # A document's spots are cut out of its words before they meet the phrases: the words are handed on no further.
    cut = (spots.groupBy(*KEY).agg(F.collect_list(F.struct("phrase_id", "start")).alias("spots")).join(read, KEY)
           .select(*KEY, F.explode(F.transform("spots", lambda s: F.struct(
               s["phrase_id"].alias("phrase_id"), s["start"].alias("start"),
               F.slice("w", s["start"] + 1, window).alias("there")))).alias("s")).select(*KEY, "s.*"))
    return (cut.join(known, "phrase_id").filter(F.slice("there", 1, F.size("phrase")) == F.col("phrase"))
            .select(*KEY, "phrase_id", "start", F.size("phrase").alias("n")))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, *, slack: int = 5, window: int = WINDOW, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k1, item, distance): documents in which a phrase's two rarest terms stand at most ``slack`` words from their places.

    Two terms alone decide, the rarest of those that the corpus has: the phrase's other words are not compared, and may be changed or
    occur nowhere.  A phrase of several words of which the corpus has only one matches nothing; one of a single word matches where that
    stands, at distance 0.  distance is the smallest shift between the two; 0 means that both stand exactly as in the phrase.  Posting lists meet in
    blocks of ``slack + 1`` positions and their two neighbours, never as whole lists.
    """
    of_items, _, index, rare = build(docs, benchmark, window=window, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col,
                                     whole_only=False)
    spots = _shifted(index, rare.filter("need = 2")).withColumn("block", F.floor(F.col("start") / (slack + 1)))
    first = F.min("off").over(Window.partitionBy("phrase_id"))
    sides = rare.filter("need = 2").withColumn("side", F.col("off") == first).select("phrase_id", "off", "side")
    spots = spots.join(sides, ["phrase_id", "off"])
    left = spots.filter("side").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    right = spots.filter("not side").select("phrase_id", *KEY, "block", F.col("start").alias("other"), F.col("pos").alias("other_pos"))
    near = (left.join(right, ["phrase_id", *KEY, "block"]).withColumn("distance", F.abs(F.col("start") - F.col("other"))).filter((F.col("distance") <= slack) & (F.col("pos") != F.col("other_pos")))
            .groupBy("phrase_id", *KEY).agg(F.min("distance").alias("distance")))
    alone = _shifted(index, rare.filter("need = 1")).select("phrase_id", *KEY, F.lit(0).alias("distance"))
    near = near.select("phrase_id", *KEY, "distance").union(alone)
    return near.join(of_items.select("phrase_id", "item"), "phrase_id").groupBy("k1", "item").agg(F.min("distance").alias("distance"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence), n_items, item_ids (sorted as strings) and contaminated.

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one.  Null and empty texts have no words and
    an item without words never matches.  Repeated rows each get their result; rows sharing an id are told apart by text.
    Input columns with the result's names are replaced, others pass unchanged.  An empty benchmark contaminates nothing.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    of_items, known, index, rare = build(docs, benchmark, window=window, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    found = cut_lineage(exact_matches(docs, known, index, rare, window, id_col, text_col))
    order = Window.partitionBy(*KEY).orderBy("start", "n")
    before = F.coalesce(F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stop = F.col("start") + F.col("n")
    hits = (found.select(*KEY, "start", "n").distinct().withColumn("fresh", F.greatest(F.lit(0), stop - F.greatest("start", before)))
            .groupBy(*KEY).agg(F.sum("fresh").alias("n_hit")))
    items = (found.select(*KEY, "phrase_id").distinct().join(of_items.select("phrase_id", "item"), "phrase_id").select(*KEY, "item").distinct()
             .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("item_ids")))
    lengths = index.filter("term = ''").select(*KEY, F.col("pos").cast("bigint").alias("n_words")).dropDuplicates(KEY)
    own = [f"__leak_{k}" for k in KEY]  # a column of the documents may be called k1
    facts = lengths.join(hits.join(items, KEY, "left"), KEY, "left").withColumnsRenamed(dict(zip(KEY, own)))
    return (docs.select("*", *[c.alias(k) for c, k in zip(_keys(id_col, text_col), own)]).join(facts, own).select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.array_size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
