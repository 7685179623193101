"""Joins in slices against plain joins."""

import pytest

from docspan.operators import skew


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [1_000_000, 7])
def test_sliced_join_equals_a_join(spark, how, hot):
    rows = [(1, "a", k) for k in range(40)] + [(2, "b", k) for k in range(5)] + [(None, "a", 1), (1, None, 2), (None, None, 3), (9, "z", 4)] + [(1, "a", 0)] * 20
    left = spark.createDataFrame(rows, "k long, s string, n int").repartition(3)
    right = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "z"), (None, "a", "never"), (5, "q", "w")], "k long, s string, v string")
    key = lambda r: tuple(map(str, r))
    got = skew.salted_join(left, right, ["k", "s"], how, hot)
    assert sorted(map(key, got.select("k", "s", "n", "v").collect())) == sorted(map(key, left.join(right, ["k", "s"], how).select("k", "s", "n", "v").collect()))


@pytest.mark.parametrize("hot", [1_000_000, 7])
def test_hinted_join_is_not_broadcast(spark, hot):
    left, right = spark.range(50).selectExpr("id % 3 AS k", "id"), spark.range(3).selectExpr("id AS k", "id AS v")
    joined = skew.salted_join(left, right, ["k"], hot_rows=hot, hint="merge")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50


def test_hot_keys_get_slices_and_nulls_stay(spark):
    left = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 1 WHEN id < 90 THEN NULL ELSE id END AS k", "id")
    hot = {r.k: r._slices for r in skew.slices_of_hot_keys(left.filter("k IS NOT NULL"), ["k"], 10).collect()}
    assert hot == {1: 6} and skew.slices_of_hot_keys(left, ["k"], 100) is None
    with pytest.raises(ValueError):
        skew.salted_join(left, left, ["k"], "full")
