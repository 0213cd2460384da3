import numpy as np
import pytest
from pyspark.sql import functions as F

from fumarole.operators import metrics as m


def points(spark, pairs, group=None):
    data = [(float(y), float(p), group or "g") for y, p in pairs]
    return spark.createDataFrame(data, "actual double, predicted double, sector string")


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(10, 3, 200), rng.normal(10, 3, 200)
    got = m.metrics(points(spark, zip(y, p))).first()
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["mape"] == pytest.approx((np.abs((y - p) / y)).mean() * 100)


def test_constant_actuals(spark):
    assert m.metrics(points(spark, [(2, 2), (2, 2)])).first()["r2"] == 1.0
    assert m.metrics(points(spark, [(2, 2), (2, 3)])).first()["r2"] == 0.0
    assert m.metrics(points(spark, [(2, 2)])).first()["r2"] is None


def test_mape_leaves_out_zero_actuals(spark):
    assert m.metrics(points(spark, [(0, 1), (4, 5)])).first()["mape"] == 25.0
    assert m.metrics(points(spark, [(0, 1), (0, 5)])).first()["mape"] is None


def test_small_sectors_are_left_out(spark):
    df = points(spark, [(i, i + 1) for i in range(4)], "small").unionByName(
        points(spark, [(i, i + 1) for i in range(5)], "large")
    ).unionByName(points(spark, [(i, i) for i in range(6)], "exact"))
    assert [r["sector"] for r in m.metrics_by(df).collect()] == ["large", "exact"]


def test_both_scales(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "y double, p double")
    got = m.both_scales(df, "y", "p").first()
    assert got["log_mae"] == pytest.approx(0.4 / 3)
    assert got["mae"] == pytest.approx(np.abs(np.expm1([1, 2, 3]) - np.expm1([1.1, 1.9, 3.2])).mean())


def results(spark):
    rows = [("b", 0.9, 2.0, 1.0, 5.0, None), ("a", 0.9, 1.0, 2.0, 4.0, None), ("c", 0.1, 9.0, 9.0, None, None), ("d", None, None, None, None, "boom")]
    return spark.createDataFrame(rows, "model string, r2 double, rmse double, mae double, mape double, error string")


def test_ranking_and_best(spark):
    df = results(spark)
    assert [r["model"] for r in m.ranked_models(df).collect()] == ["a", "b", "c"]
    assert m.best_model(df).first()["model"] == "a"
    good = m.ranked_models(df)
    assert [r["model"] for r in m.sorted_by_metric(good, "mae").collect()] == ["b", "a", "c"]
    assert [r["model"] for r in m.sorted_by_metric(good, "mape").collect()] == ["a", "b", "c"]


def test_residuals_and_line(spark):
    df = points(spark, [(1, 3), (5, 2)])
    assert sorted(r["residual"] for r in m.residuals(df).collect()) == [-2.0, 3.0]
    assert tuple(m.line_bounds(df).first()) == (1.0, 5.0)
    assert m.long_metrics(m.ranked_models(results(spark))).where(F.col("value").isNotNull()).count() == 11
