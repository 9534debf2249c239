"""Every example query against its SQL twin, and again with every larger key split as a hot one."""

import duckdb
import pytest

import check
from folioframe.plans import ORACLES, QUERIES

SPLIT = ["number_missing", "gap_runs", "reading_order", "paragraphs", "interval_assign", "expansion_shift", "stack_rows", "adjacent_pairs", "batches", "review_ladder",
         "due_queue", "lattice", "attach_punctuation", "threshold_segments", "trim_retention", "interpolate_missing", "carry_forward", "lookahead", "debounce", "idempotent_queue",
         "median_stats", "build_documents", "symbol_inventory", "ordered_catalog", "ordered_union_distinct", "match_revision", "uncovered", "reconcile_cells", "next_larger",
         "group_words_to_lines", "region_disagreement", "tiered_match", "allocate_width", "daily_activity", "grid_scores", "parse_choices"]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = check.rows([tuple(r) for r in df.collect()], df.columns)
    cur = db.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == check.rows(cur.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, db, name):
    compare(spark, sf, db, name)


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_hot_keys(spark, sf, db, name, hot_split):
    compare(spark, sf, db, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
