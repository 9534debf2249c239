"""The registered queries against their SQL or brute force, and the pipeline stage by stage."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import check
import corpus_pipeline
from folioframe.llm import byte_bpe, decontam, quality, simhash
from folioframe.llm.oracles import ORACLES
from folioframe.llm.queries import QUERIES

from .test_operators import RANKS, ascii_words, without_repeats


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got = check.rows([tuple(r) for r in df.collect()], df.columns)
    cur = db.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == check.rows(cur.fetchall(), cols)


def reference_ids(text):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    return ref.encode_ordinary(text or "")


def test_byte_bpe_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = reference_ids(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def simhash_components(rows):
    fps = np.array([simhash.fingerprint_of(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.array([i for i, _ in rows])
    while True:
        new = np.array([label[near[k]].min() for k in range(len(rows))])
        if (new == label).all():
            return dict(zip((i for i, _ in rows), label.tolist()))
        label = new


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op8_simhash"](spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == simhash_components(rows)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {i: simhash.fingerprint_of(t) for i, t in rows}


@pytest.mark.parametrize("name, label, least", [("op5_quality", "quality", 0.9), ("op6_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    held = QUERIES[name](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert len(held) > 100
    assert sum(r.predicted == r[label] for r in held) >= least * len(held)


@pytest.mark.parametrize("empty", [("documents",), ("labels",), ("documents", "labels")])
def test_empty_tables(spark, sf, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        (rows.limit(0) if name in empty else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    n = spark.read.parquet(f"{tmp_path}/documents.parquet").count()
    for name in ("op5_quality", "op6_toxicity"):
        assert QUERIES[name](spark, str(tmp_path)).count() == n
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:1] if n else corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, str(tmp_path)))
        assert docs.count() == n


def test_pipeline(spark, sf):
    """Each stage on what the one before it left, by brute force where the stage is not a fitted model."""
    def rows(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    table = spark.read.parquet(f"{sf}/documents.parquet")
    got, kept = [], table
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut_lineage(stage(spark, kept, sf))
        got.append(kept)
    assert all(df.columns == table.columns for df in got[:4])

    model = quality.fit_documents(table, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {i for i, _ in rows(got[0])} == {r.doc_id for r in quality.classify(table, model).filter("predicted = 1").collect()}
    one = rows(got[0])
    assert {i for i, _ in rows(got[1])} == set(simhash_components(one).values())
    two = rows(got[1])
    texts = dict(two)
    want = {i: kept if n else texts[i] for i, _, n, kept in without_repeats(two, 13)}
    assert dict(rows(got[2])) == want
    items = [ascii_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[s:s + 10]) for w in items if w for s in range(max(1, len(w) - 9))}
    sizes = {len(p) for p in windows}
    clean = {i: t for i, t in want.items() if not any(tuple(w[s:s + n]) in windows for w in [ascii_words(t)] for n in sizes for s in range(len(w) - n + 1))}
    assert dict(rows(got[3])) == clean
    assert {r.doc_id: r.ids for r in got[4].collect()} == {i: reference_ids(t) for i, t in clean.items()}
    assert corpus_pipeline.run(spark, sf).count() == len(clean)


def test_plans_have_no_python_where_none_is_wanted(spark, sf):
    for name in ("op2_decontaminate", "op7_url_filter", "op9_chat"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert decontam.WINDOW == 10
