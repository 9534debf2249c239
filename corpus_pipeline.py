"""A training corpus from ``documents``: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder and reads it as the next one's input.

In every stage a null text counts as an empty one and stays null, whole texts of any length are read, an empty table stays empty, and further columns
pass unchanged whatever their names.  Ties go to the smallest id; rows that repeat an id and a text are one row after the second stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontam, quality, simhash, substring
from folioframe.llm.queries import encoded, table
from folioframe.operators.lineage import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeps_columns(stage: Stage) -> Stage:
    """The stage between renamings, so that no column of the documents meets one that an operator adds."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"__doc_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
        kept = stage(spark, docs.withColumnsRenamed(own), sf_dir)
        return kept.select(*[F.col(own.get(c, f"`{c}`")).alias(c) for c in docs.columns])
    return run


@keeps_columns
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject.

    Repeated rows are judged alike; without labels of both classes every document has one score.
    """
    model = quality.fit_documents(docs, table(spark, sf_dir, "labels"), one_class=True)
    return quality.classify(docs, model).filter("predicted = 1")


@keeps_columns
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; empty texts are one group."""
    return simhash.keep_one(docs)


@keeps_columns
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that an earlier document has; texts that lose nothing stay as they are.

    A document without an id loses nothing.  ``n_chars`` follows the text where that changes.
    """
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    found = substring.dedup_windows(docs).withColumn("text", text)
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))


@keeps_columns
def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window stands; texts without words stay, and so do all where the benchmark is empty."""
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of each text, none for a null one."""
    return encoded(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good), ("near duplicates", distinct), ("repeated passages", unrepeated), ("decontamination", unleaked), ("token ids", tokens)]

#: The quality scores, XXH64 fingerprints and token ids have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
