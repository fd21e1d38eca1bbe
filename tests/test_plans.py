"""Shape of the physical plans."""

import pytest

import __spark_entry__ as entry
from rainweave import plans

FOLDER = "/root/testdata/sf0.001"
# Python is expected only where a dense solve, a recursion or complex numbers need it
PYTHON = {
    "x1_blockwise_function",
    "i4_ordinary_kriging", "i4_nearest_kriging_at_gauges", "i4_nearest_kriging_grid", "i5_universal_kriging", "i6_external_drift_kriging",
    "i7_variogram_bins", "i7_near_variogram_bins", "i9_kriging_benchmark", "i5_nearest_universal_grid", "i6_nearest_external_drift_grid", "i9_nearest_kriging_benchmark",
}
FITTED = {"g5_components"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - FITTED))
def test_no_cross_join_and_python_only_where_needed(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    uses_python = "Python" in text or "InPandas" in text or "ArrowEval" in text
    assert uses_python == (name in PYTHON)


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(entry.queries()["a1_first_per_bucket"](spark, FOLDER))
    assert "props" not in text.split("ReadSchema")[1]
    rain = plan(entry.queries()["p7_rain_class"](spark, FOLDER))
    assert "PushedFilters: [" in rain and "event_type" in rain.split("PushedFilters")[1]
