"""Queries beside their SQL in DuckDB on the smallest tables, for a part of each module; compare.py runs all."""

import duckdb
import pytest
from compare import plain

from subsieve.plans import MODULES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["h1_draw_balanced", "h3_allocate_proportional", "h6_stratified_split", "i2_ks_distance", "i6_regime_breakdown", "i13_ranking_event", "i4_budget_summary", "j2_frontier", "j2_best_draw", "j6_select_joint", "j12_regime_count_grid", "j14_failure_modes", "a7_write_report", "e6_scene_image_stats", "j7_pareto", "j17_holdout_protocol",
        "b1_canonicalize", "b5_keep_first", "g6_coverage", "g7_coverage_bias", "k2_rank_methods", "k4_kendall", "c1_feature_summary", "c5_correlation", "d6_normalize", "d8_select_frames",
        "a2_read_logs", "a4_flatten_features", "e1_parse_images", "e3_pose_stats", "e7_focus_point", "f2_silhouette", "f12_radius_components", "l3_regime_coverage", "m3_scan_markers", "n1_stream_logs",
        "a9_file_listing", "a10_file_assets", "h7_trial_store", "n1_tiered_store"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, con, name):
    queries = {k: f for m in MODULES for k, f in m.QUERIES.items()}
    sql = {k: s for m in MODULES for k, s in m.SQL.items()}
    got, want = plain(queries[name](spark, SF).toPandas()), plain(con.sql(sql[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.fillna("~").equals(want.fillna("~"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
