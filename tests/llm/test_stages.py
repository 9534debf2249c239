"""Pipeline stages on documents with odd values and columns that are called like those of the operators."""

from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import decontam

NAMES = ["score", "predicted", "n_words", "n_removed", "kept_text", "item_ids", "contaminated", "k1", "k2", "fp", "id", "x", "component_id", "ids", "term", "pos"]


def test_columns_of_any_name_pass_unchanged(spark, sf):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "s", None), (900_002, "", None, None, 0), (900_003, "word " * 40_000, "en", "s", 200_000)], plain.schema)
    table = plain.unionByName(odd).withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id")) for n in NAMES})
    with_names, without = table, plain.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:4]:
        with_names = corpus_pipeline.cut_lineage(stage(spark, with_names, sf))
        without = corpus_pipeline.cut_lineage(stage(spark, without, sf))
        assert with_names.columns == table.columns
        assert with_names.select(*plain.columns).exceptAll(without).isEmpty() and with_names.count() == without.count() > 0
        for n in NAMES:
            assert with_names.filter(~F.col(n).eqNullSafe(F.concat(F.lit(f"{n}-"), F.col("doc_id")))).isEmpty()
    ids = corpus_pipeline.STAGES[4][1](spark, with_names, sf)
    assert ids.columns == ["doc_id", "n_tokens", "ids"] and ids.count() == without.count()


def test_decontamination_keeps_columns_called_like_its_keys(spark, sf):
    docs = spark.createDataFrame([(1, "one two three", "a", 5), (2, "four", None, None)], "doc_id long, text string, k1 string, k2 int")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    got = {r.doc_id: (r.k1, r.k2, r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: ("a", 5, True), 2: (None, None, False)}
