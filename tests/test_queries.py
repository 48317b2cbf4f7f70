"""Every query with SQL against DuckDB; the others must run."""

from __future__ import annotations

import pytest

from sedge.plans import load

CATALOG = load()
#: Queries without SQL: tests of their own hold them against brute force or invariants.
HELD_ELSEWHERE = {
    "c18_chunk_fixed", "c19_chunk_hierarchy", "c21_chunk_recursive", "c22_add_overlap", "c23_merge_small", "e3_embed", "i7_synthetic_corpus", "i8_train_classifier", "i9_predict_type",
    "i10_feature_importance", "i11_cross_validate", "i11_fold_report", "i12_unknown_queue", "i14_retrain_report", "c18_chunk_fixed_by_words", "c21_chunk_recursive_by_pieces",
    "e3_embed_by_model", "e17_batch_rag_by_model",
}


@pytest.mark.parametrize("name", sorted(CATALOG.SQL))
def test_equals_sql(name, spark, sf_dir, duck, same):
    same(CATALOG.QUERIES[name](spark, sf_dir), duck, CATALOG.SQL[name])


def test_every_query_is_held_against_something():
    assert set(CATALOG.QUERIES) - set(CATALOG.SQL) == HELD_ELSEWHERE


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
