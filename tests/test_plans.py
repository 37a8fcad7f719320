"""Plans of the main queries: what is joined how, and what reaches the scan."""

import __spark_entry__ as entry
import pytest

QUERIES = entry.queries()


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 4000)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "join_points_in_windows", "join_buffers", "join_grid_cells", "join_tracks_windows", "plan_cities", "gdelt_sa_3w", "random_extents",
    "random_extents_boxes", "gdelt_france_1m", "tracks_grid_5d", "join_concurrency", "b_tube", "win_qcut_by_group"])
def test_no_unkeyed_joins(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["join_points_in_windows", "join_buffers", "plan_cities", "gdelt_france_1m"])
def test_features_are_not_shuffled(spark, sf, name):
    """Windows are broadcast; the only exchanges are those of counts by name."""
    plan = plan_of(QUERIES[name](spark, sf))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_one_window_is_a_filter(spark, sf):
    plan = plan_of(QUERIES["life_bbox"](spark, sf))
    assert "Join" not in plan
    assert "GreaterThan(ts,2024-01-08T00:00)" in plan and "LessThan(ts,2024-01-14T23:59:59)" in plan
    assert "event_type" not in plan.split("ReadSchema")[1]


def test_time_reach_of_a_window_set_reaches_the_scan(spark, sf):
    plan = plan_of(QUERIES["plan_cities"](spark, sf))
    assert "GreaterThanOrEqual(o_orderdate,1987-01-01T00:00)" in plan
