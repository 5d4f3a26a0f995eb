"""Registered queries vs their DuckDB oracle on sf0.001 (the driver does the
same at sf0.01; ``tests/oracle_check.py`` runs all of them)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.oracle_check import TABLES, rows_of

SUBSET = [
    "scan_table", "filter_product_test", "dropna_any", "unmapped_rows", "null_counts", "distinct_counts",
    "constant_columns", "class_distribution", "categorical_summary", "unique_values_table",
    "numeric_statistics", "grouped_statistics", "boxplot_summary", "label_balance", "dataset_profile",
    "roc_running_counts", "target_correlation_ranked", "normalize_whitespace", "label_in_range",
    "correlation_matrix", "remove_highly_correlated_features", "chi2_pairwise", "infer_column_kind",
    "split_80_20", "split_70_15_15", "stratified_folds", "nearest_minority_neighbours", "smote_oversample",
    "classification_report", "roc_curve_from_scores", "evaluate_model", "preprocess_t1",
    "drop_associated_categoricals", "read_split_datasets", "spearman_matrix", "linear_regression", "pca_reconstruction", "histogram",
    "spec_limits", "impute_missing", "historical_validation", "multi_objective_tradeoff", "contrast_products", "load_model",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, sf, con, name):
    sdf = E.queries()[name](spark, sf)
    cols = sorted(sdf.columns)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    srows = rows_of([r.asDict() for r in sdf.collect()], cols)
    drows = rows_of([dict(zip(dcols, r)) for r in res.fetchall()], cols)
    assert srows == drows


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 92


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.columns == ["label", "n", "pct"] and out.count() >= 1
