import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.operators import encode
from fumarole.session import stage_path


def rows(spark, n=200, seed=3):
    draw = random.Random(seed)
    data = [
        (draw.choice(["a", "b", "c", None]), i % 4, None if draw.random() < 0.1 else draw.random(), draw.random())
        for i in range(n)
    ]
    return spark.createDataFrame(data, "sector string, fold int, log_scope1_emissions double, scope2_emissions double"), data


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values)


def test_group_means_with_unseen_and_null_groups(spark):
    df, data = rows(spark)
    model = encode.GroupMean(groupCol="sector").fit(df)
    assert model.names() == ["sector_mean_log_scope1", "sector_mean_log_scope2"]
    probe = spark.createDataFrame([("a",), ("new",), (None,)], "sector string")
    got = {r["sector"]: r["sector_mean_log_scope1"] for r in model.transform(probe).collect()}
    overall = mean([d[2] for d in data])
    assert got["a"] == pytest.approx(mean([d[2] for d in data if d[0] == "a"]))
    assert got["new"] == pytest.approx(overall) and got[None] == pytest.approx(overall)


def test_refit_replaces_the_column(spark):
    df, _ = rows(spark)
    model = encode.GroupMean(groupCol="sector").fit(df)
    twice = model.transform(model.transform(df))
    assert twice.columns.count("sector_mean_log_scope1") == 1


def test_absent_target_is_left_out(spark):
    df, _ = rows(spark)
    model = encode.GroupMean(groupCol="sector").fit(df.drop("scope2_emissions"))
    assert model.names() == ["sector_mean_log_scope1"]


def test_out_of_fold_means_by_brute_force(spark):
    df, data = rows(spark)
    got = encode.out_of_fold_means(df.withColumn("n", F.monotonically_increasing_id()), "sector", "fold")
    seen = {(r["sector"], r["fold"]): r["sector_mean_log_scope1"] for r in got.collect()}
    assert got.count() == len(data)
    for (sector, fold), value in seen.items():
        others = [d[2] for d in data if d[1] != fold and (sector is None or d[0] == sector)]
        assert value == pytest.approx(mean(others))


def test_ordinal_codes_by_codepoint(spark):
    values = ["b", "B", "é", "a", None, "Zz"]
    df = spark.createDataFrame([(v,) for v in values], "sector string")
    model = encode.OrdinalCode(inputCol="sector").fit(df)
    got = {r["sector"]: r["sector_encoded"] for r in model.transform(df).collect()}
    order = sorted(v or "Unknown" for v in values)
    assert got == {v: order.index(v or "Unknown") for v in values}
    unseen = model.transform(spark.createDataFrame([("q",)], "sector string")).first()
    assert unseen["sector_encoded"] == -1


def test_many_values_are_numbered_per_partition(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"))
    few = {r["value"]: r["code"] for r in encode.ranked_values(df, "v").collect()}
    many = {r["value"]: r["code"] for r in encode.ranked_values(df, "v", max_rows=10).collect()}
    assert few == many and sorted(many.values()) == list(range(5000))


def test_codes_of_several_columns_in_one_pass(spark):
    df = spark.createDataFrame([("b", None), ("a", "x"), ("a", "y")], "p string, q string")
    for bound in (100, 2):
        one, two = encode.fit_codes(df, ["p", "q"], max_rows=bound)
        rows = two.transform(one.transform(df)).collect()
        assert [(r["p_encoded"], r["q_encoded"]) for r in sorted(rows, key=str)] == [(0, 1), (0, 2), (1, 0)]


def test_encoders_survive_saving(spark):
    df, _ = rows(spark)
    fitted = Pipeline(stages=[encode.GroupMean(groupCol="sector"), encode.OrdinalCode(inputCol="sector")]).fit(df)
    path = stage_path(spark, "encoders")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    assert sorted(fitted.transform(df).collect(), key=str) == sorted(loaded.transform(df).collect(), key=str)


def test_encode_all_keeps_order_and_adds_codes(spark):
    df = spark.createDataFrame([("e", "i", "c")], "sector string, industry string, country string")
    assert encode.encode_all(df).columns == ["sector", "industry", "country", *vocab.CODES]
