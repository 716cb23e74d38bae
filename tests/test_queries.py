"""Registered queries against DuckDB on the smallest tables; tools/check_oracles.py runs all of them at any scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare
from windowlab.plans import catalog

CHOSEN = [
    "tall_to_wide", "window_timing", "limit_runs", "reason_shares", "probe_status_join", "cohens_d_by_domain", "control_rate_features",
    "grouped_split_windows", "robust_scaler", "correlation_pruning", "mutual_information", "rank_aggregation", "universal_set_soft", "anchored_top_k",
    "best_threshold", "best_quantile_threshold", "roc_auc", "rescaled_confusion", "paired_analysis", "score_drift_distance", "bootstrap_separation",
    "cluster_bootstrap_accuracy", "permutation_test", "gap_decomposition", "fewshot_curve", "resumable_grid", "edge_parameters", "isotonic_curve",
    "failing_feature_share", "subset_comparison", "k_sweep_cells", "ablation_17_sets", "drop_column_all", "feature_config_sums", "single_precision_rates", "correlation_pairs_wide",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) == ""


def test_entry_and_inventory(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.COVERS) == set(catalog.QUERIES) <= set(entry.queries())
