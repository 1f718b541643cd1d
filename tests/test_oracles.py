"""Queries against their SQL in DuckDB at the smallest scale."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sidlens.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["sid_validity", "history_parse", "remap_sid", "remap_report", "quality_report", "ppmi_support", "encode_examples", "codebook_usage", "prediction_audit", "item_level_eval", "product_level_eval", "collision_confound", "paired_bootstrap", "popularity_buckets", "history_copy", "heldout_majority", "nmi", "ppmi", "prior_ranks", "beamlike_pool", "rerank_cooc", "pointwise_score", "augment_candidates", "listwise_features", "listwise_score", "grid_cells", "grid_select", "subset_cells", "subset_select", "apply_compare", "compare_ci", "catalog_argmax", "split_order", "collision_intervals", "seed_summary", "seed_summary_kept", "seed_means_kept", "two_stage_bootstrap_kept", "curve_summary", "info_stats", "reachability_augmented", "title_coherence_sampled", "negative_sample", "beamlike_negatives", "cluster_bootstrap"]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and not math.isnan(v) and v == int(v):
        v = int(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = ", ".join(df.columns)
    want = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
