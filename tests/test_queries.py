"""Registered queries against their SQL in DuckDB, on the smallest driver tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "a3_regression_by_group", "a5_spearman_by_pair", "a8_pair_information", "a11_lag_overview_by_group", "a12_mann_kendall", "a26_compare_datasets", "g3_terminal_groups_edited",
    "g5_upstream_links_nested", "g6_first_gage_below", "j5_lag_one_year", "p7_elevation_classes", "t1_pchip_monthly", "t6_anomaly", "t6_rolling_year", "t9_peaks", "x1_points_in_polygons", "x3_nearest_line",
    "a33_class_fits", "a34_class_fits_by_season", "a43_information_fit", "a51_slope_split", "j9_by_number", "j10_class_join", "p17_without_outer_noise", "p19_display_name",
    "x6_containing_or_nearest", "x9_lines_meeting_polygons",
    "x2_entities_in_catchments", "x7_basins_of_gages", "j3_enriched_series", "j12_with_fits", "j14_match_rate", "a52_step_metrics", "t10_held_mean_curve",
    "s3_attributes_of_series", "s8_reach_elevations", "s9_vertex_arrays", "s11_resumed_study", "u5_selections", "u5_selection_fits", "s6_gage_locations", "s7_flags",
    "s13_upstream_map",
    "u1_p_values", "u2_trend_labels", "t4_global_outliers", "p14_trimmed", "a54_profile", "a46_rank_sum", "g4_upstream_of", "g7_upstream_summary", "x3_reaches_of_points", "x5_utm",
    "s11_nine_steps", "a27_five_lags", "a35_period_trends", "u5_summary", "a53_group_range", "p8_own_classes", "j12_described_trends",
]


def told(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    cols = sorted(got.columns)
    rows = sorted(tuple(told(v) for v in r) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    want = duck.sql(entry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert rows == sorted(tuple(told(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_study_inputs_stay_the_same_between_runs(spark, monkeypatch):
    """Levels whose last bits change whenever they are made, as sums of doubles do on several executors."""
    import random

    from pyspark.sql import functions as F

    from pairflow.catalog import places
    from pairflow.catalog.base import Tables
    from pairflow.plans.tables import fingerprint

    steady, noise = Tables.levels, F.udf(lambda v: v * (1 + random.choice((-1, 0, 1)) * 2**-52), "double").asNondeterministic()
    monkeypatch.setattr(Tables, "levels", lambda t: steady(t).withColumn("wte", noise("wte")))
    inputs = places._study_inputs(Tables(spark, FOLDER))
    assert fingerprint(inputs["levels"]) == fingerprint(inputs["levels"])
