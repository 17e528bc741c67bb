"""Physical plans: no cross joins, no Python where native expressions do, pruned scans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from motionloom.operators.ordered import spread_join
from motionloom.plans.views import imu6, stream_rows

SF = "/root/testdata/sf0.001"
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsIn", "MapInPandas", "MapInArrow")
NATIVE = ["time_axis_rebuild", "recording_summary", "channel_profile", "robust_outlier", "stream_quality", "clean_channel", "fill_short_gaps", "hampel_spike", "longest_run",
          "grid_interpolate", "uniform_resample_dedup", "sliding_windows", "label_validate", "timeline_gap_fill", "trial_audit", "loro_nearest_centroid",
          "lopo_two_action", "roc_auc", "group_folds", "centroid_distance", "pairwise_cross", "equivalent_exports_test", "quality_totals", "impute_standardize",
          "assign_batch_clock", "live_normalize", "sequence_gaps", "debounce_hold", "debounce_count", "posture_monitor", "sessionize_gap", "interval_union_duration", "daily_summary",
          "quat_ops", "interval_union_duration", "legacy_contains_join", "segment_interval_join", "event_store_upsert"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(NATIVE)))
def test_native_queries_have_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in (*PYTHON, "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_windows_shuffle_rows_once(spark):
    """Rows cross the network for their position and once more for all overlapping windows."""
    df = entry.queries()["sliding_windows"](spark, SF)
    text = plan(df).split("Generate explode(sequence(_w0")[0]
    assert "Exchange" not in text  # grouping by (key, block, window) reuses the (key, block) partitioning


@pytest.mark.parametrize("name", ["window_stats_v1", "window_stats_v2", "posture_window_features", "contrast_window_features", "live_features_v1"])
def test_kernels_copy_no_row_per_window(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "explode(sequence(_w0" not in text and text.count("MapInArrow") == 1 and "EvalPython" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(stream_rows(spark, SF).groupBy("device").agg(F.count("x")))
    schema = text.split("ReadSchema:")[1].splitlines()[0]
    assert "props" not in schema and "ts" not in schema and "event_type" not in schema


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["inherit_split"](spark, SF))
    assert "GreaterThan(c_acctbal" in text


def test_spread_join_salts_hot_keys(spark):
    rows = spark.range(0, 4000).select(F.lit(7).alias("k"), "id").repartition(4)
    dim = spark.createDataFrame([(7, "x")], "k int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spread_join(rows, dim, ["k"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) > 3 and max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_views_are_block_numbered(spark):
    text = plan(imu6(spark, SF))
    assert "windowspecdefinition(l_suppkey" in text and "_blk" in text


def test_staged_tables_can_be_dropped(spark, tmp_path):
    import os

    from motionloom import session

    before = session._MADE.pop(spark.sparkContext.applicationId, [])
    session.staged(spark.range(3), "gone")
    (path,) = session._MADE[spark.sparkContext.applicationId]
    assert os.path.isdir(path)
    assert session.drop_staged(spark) == 1 and not os.path.exists(path)
    session._MADE[spark.sparkContext.applicationId] = before
