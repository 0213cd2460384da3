import pytest
from pyspark.sql import functions as F

from fumarole.operators import joins


def frames(spark):
    left = spark.createDataFrame(
        [("hot", i) for i in range(200)] + [(None, i) for i in range(150)] + [(f"k{i % 40}", i) for i in range(120)],
        "ticker string, n int",
    )
    right = spark.createDataFrame(
        [("hot", 1.0), ("hot", 2.0), (None, 9.0)] + [(f"k{i}", float(i)) for i in range(20)],
        "ticker string, extra double",
    )
    return left, right


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("max_right", [1000, 1])
def test_split_join_equals_plain_join(spark, null_safe, max_right):
    left, right = frames(spark)
    other = right.withColumnRenamed("ticker", "t")
    on = left["ticker"].eqNullSafe(other["t"]) if null_safe else left["ticker"] == other["t"]
    want = left.join(other, on, "left").select("ticker", "n", "extra")
    got = joins.skew_safe_left_join(left, right, "ticker", null_safe, share=0.2, min_rows=50, max_right=max_right)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_hot_keys_are_found_and_not_shuffled(spark):
    left, right = frames(spark)
    assert set(joins.hot_keys(left, "ticker", 0.2, 50)) == {"hot", None}
    assert joins.hot_keys(left, "ticker") == []


def test_fill_and_drop(spark):
    emissions = spark.createDataFrame([("t", None, "x"), ("u", 5.0, None)], "ticker string, revenue double, industry string")
    extract = spark.createDataFrame([("t", 7.0, "y", 3)], "ticker string, revenue double, industry string, staff int")
    filled = joins.merge_financials(emissions, extract, fill=True)
    assert sorted(map(tuple, filled.collect())) == [("t", 7.0, "x", 3), ("u", 5.0, None, None)]
    dropped = joins.merge_financials(emissions, extract, fill=False)
    assert sorted(map(tuple, dropped.collect())) == [("t", None, "x", 3), ("u", 5.0, None, None)]


def test_duplicate_right_keys(spark):
    emissions = spark.createDataFrame([("t", 1)], "ticker string, n int")
    extract = spark.createDataFrame([("t", 1.0), ("t", 2.0)], "ticker string, x double")
    assert joins.merge_financials(emissions, extract).count() == 2
    with pytest.raises(ValueError, match="duplicate ticker"):
        joins.merge_financials(emissions, extract, unique_right=True)


def test_lookup_beyond_the_broadcast_bound_is_exact(spark):
    left = spark.range(100).select((F.col("id") % 30).alias("k"))
    table = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = sorted(map(str, joins.lookup(left, table, "k").collect()))
    large = sorted(map(str, joins.lookup(left, table, "k", max_rows=5).collect()))
    assert small == large


def test_shared_columns_are_rejected(spark):
    df = spark.createDataFrame([(1, 2)], "k int, x int")
    for join in (joins.lookup, joins.skew_safe_left_join):
        with pytest.raises(ValueError, match="x"):
            join(df, df, "k")
