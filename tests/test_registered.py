"""Registered queries against their SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry

import compare

# Covered by the longer scoring and evaluation queries or by unit tests; the full
# list is run by tests/compare.py.
QUICK = [
    "balanced_mean", "covariance_macro_shrunk", "knn_weights", "topk_mean_similarity", "split_series",
    "split_candidates", "range_gather", "external_refs_union", "macro_summary", "evaluate_series", "sample_labeled",
    "cache_scan", "cache_index", "cache_labels", "series_csv", "episodes_csv", "pool_scan", "unlabelled_detected",
    "violations_detected",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    want = compare.connect(sf).execute(entry.oracle_sql()[name]).fetch_df()
    assert compare.difference(entry.queries()[name](spark, sf).toPandas(), want) is None


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.OWN) <= set(entry.oracle_sql())
