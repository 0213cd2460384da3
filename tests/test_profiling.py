import math

import numpy as np
import pandas as pd
import pytest
from conftest import companies, plan_of
from pyspark.sql import functions as F

from fumarole.operators import profiling as p
from fumarole.operators.cleaning import add_logs
from fumarole.plans.clean import clean
from fumarole.plans.explore import explore, write_exploration
from fumarole.plans.ingest import merge_sources
from fumarole.sources.dimensions import country_macro
from fumarole.session import stage_path


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 400)
    pdf = pd.DataFrame({
        "x": x, "y": x ** 2 + rng.normal(0, 0.1, 400), "z": rng.lognormal(0, 1, 400), "k": 4.5,
        "g": rng.choice(["a", "b"], 400),
    })
    pdf.loc[::9, "y"] = np.nan
    return spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "x double, y double, z double, k double, g string"), pdf


def test_correlations_are_pairwise_complete(numbers):
    df, pdf = numbers
    got = {(r["x"], r["y"]): r["r"] for r in p.correlations(df, ["x", "y", "z", "k"]).collect()}
    want = pdf[["x", "y", "z"]].corr()
    assert len(got) == 16 and got["k", "k"] is None and got["x", "k"] is None
    for a in want:
        for b in want:
            assert got[a, b] == pytest.approx(want.loc[a, b])


def test_correlations_of_many_columns_stay_one_small_aggregate(spark):
    names = [f"c{i}" for i in range(16)]
    wide = spark.range(50).select(*[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)])
    table = p.correlations(wide, names)
    assert plan_of(table).count("partial_regr_sxy") <= 2
    got = {(r["x"], r["y"]): r["r"] for r in table.collect()}
    want = wide.toPandas().corr()
    assert len(got) == 256 and all(got[a, b] == pytest.approx(want.loc[a, b]) for a in names for b in names)
    empty = p.correlations(wide.where("c0 > 2"), names).collect()
    assert len(empty) == 256 and all(r["r"] is None for r in empty)


def test_histogram_counts_every_value(numbers):
    df, pdf = numbers
    rows = {r["bin"]: r["n"] for r in p.histogram(df, "y", 20).collect()}
    counts, _ = np.histogram(pdf["y"].dropna(), 20)
    assert rows == dict(enumerate(counts.tolist()))
    assert p.histogram(df, "k", 5).collect()[0]["n"] == 400
    assert p.histogram(df.where("1 = 0"), "k", 5).count() == 0


def test_skewness_is_the_adjusted_one(spark, numbers):
    df, pdf = numbers
    got = p.skew_before_after(df, {"z": "y"}).first()
    assert got["raw_skew"] == pytest.approx(pdf["z"].skew())
    assert got["log_skew"] == pytest.approx(pdf["y"].skew())
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "z double, y double")
    assert p.skew_before_after(two, {"z": "y"}).first()["raw_skew"] is None


def test_describe_matches_pandas(numbers):
    df, pdf = numbers
    got = {r["column"]: r for r in p.describe(df, ["x", "y"]).collect()}
    want = pdf[["x", "y"]].describe().round(3)
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "q25", "50%": "q50", "75%": "q75", "max": "max"}
    for c in ("x", "y"):
        for theirs, ours in names.items():
            assert got[c][ours] == pytest.approx(want.loc[theirs, c])


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 1.0)], "sector string, v double")
    got = {r["sector"]: r for r in p.box_stats(df, "v", log=False).collect()}
    assert (got["a"]["q1"], got["a"]["med"], got["a"]["q3"]) == (2.0, 3.0, 4.0)
    assert got["a"]["whisker_hi"] == 4.0 and got["a"]["hi"] == 100.0 and got["a"]["n_outliers"] == 1
    assert got["b"]["whisker_lo"] == 1.0


def test_missing_profile(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, "x")], "a double, b int, c string")
    assert [tuple(r) for r in p.missing_profile(df).collect()] == [("a", 2, 100.0), ("c", 1, 50.0)]


def test_mutual_information_by_brute_force(numbers):
    df, pdf = numbers
    got = {r["column"]: r["mi"] for r in p.mutual_information(df, ["x", "z", "k"], "y", bins=8).collect()}
    data = pdf.dropna()
    assert "k" not in got and got["x"] > got["z"]
    for c in ("x", "z"):
        bx, by = pd.qcut(data[c], 8, labels=False), pd.qcut(data["y"], 8, labels=False)
        joint = pd.crosstab(bx, by).to_numpy() / len(data)
        outer = joint.sum(1, keepdims=True) @ joint.sum(0, keepdims=True)
        want = sum(j * math.log(j / o) for j, o in zip(joint.ravel(), outer.ravel()) if j)
        assert got[c] == pytest.approx(want)
    assert p.mutual_information(df.limit(19), ["x"], "y").count() == 0


def test_column_choices(numbers):
    df, _ = numbers
    flagged = df.selectExpr("*", "1 as x_missing")
    assert p.numeric_columns(flagged) == ["x", "y", "z", "k"]
    assert p.numeric_columns(flagged, flags=True)[-1] == "x_missing"
    assert p.varying_columns(df, ["x", "k"]) == ["x"]


def test_scatter_hides_what_has_no_log(spark):
    rows = [("a", 1, "s", 1.0, 1.0), ("b", 1, "s", 0.0, 1.0), ("c", 1, "s", 1.0, -1.0), ("d", 1, "s", None, 1.0)]
    df = spark.createDataFrame(rows, "company_name string, reporting_year int, sector string, x double, y double")
    assert [r[0] for r in p.scatter_points(df, "x", "y").collect()] == ["a"]


def test_pair_sample_is_bounded(spark):
    df = add_logs(merge_sources(companies(spark, 200), None, country_macro(spark)))
    assert p.pair_sample(df, rows=50).count() == 50
    complete = df.na.drop(subset=["revenue", "total_assets", "employee_count", "market_cap"]).count()
    assert p.pair_sample(df).count() == complete


def test_exploration_job(spark):
    rows = clean(merge_sources(companies(spark, 200), None, country_macro(spark)))
    tables = explore(rows, sample=60)
    assert tables["revenue_vs_scope1"].count() == 60 and tables["missing"].count() == 0
    assert tables["sector_medians"].count() == 11
    names = write_exploration(rows, stage_path(spark, "eda"))
    assert set(names) == set(tables)
