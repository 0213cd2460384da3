import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fumarole.operators import attribution as at
from fumarole.operators import learners

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = 2 * x[:, 0] + x[:, 1] * x[:, 2] + (x[:, 1] > 0)
    rows = [(f"r{i}", *map(float, x[i]), float(y[i])) for i in range(150)]
    return spark.createDataFrame(rows, "row_id string, a double, b double, c double, y double").cache()


def shapley(names, value):
    """Exact Shapley values of a set function over feature numbers."""
    n = len(names)
    phi = [0.0] * n
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for chosen in itertools.combinations(rest, size):
                phi[i] += weight * (value({*chosen, i}) - value({*chosen}))
    return phi


def expected(leaves, x, known):
    """Mean leaf value: known features decide, unknown ones split by cover."""
    total = 0.0
    for leaf in leaves:
        share = 1.0
        for f, lo, hi, cover in zip(leaf.features, leaf.lo, leaf.hi, leaf.cover):
            share *= float(lo < x[f] <= hi) if f in known else cover
        total += leaf.value * share
    return total


@pytest.mark.parametrize("name", ["RandomForest", "GradientBoosting"])
def test_trees_by_brute_force(spark, data, name):
    one = learners.learners("y")[name]
    one.regressor._set(maxDepth=4, **({"numTrees": 3} if name == "RandomForest" else {"maxIter": 3}))
    model = learners.pipeline(one, NAMES).fit(data)
    leaves = at.tree_leaves(model.stages[-1])
    long = at.attributions(model, data, NAMES).toPandas()
    wide = long.pivot(index="row_id", columns="feature", values="phi")
    base = long["base"].iloc[0]
    predictions = {r["row_id"]: r["prediction"] for r in model.transform(data).collect()}
    for row in data.limit(25).collect():
        x = [row[n] for n in NAMES]
        want = shapley(NAMES, lambda known: expected(leaves, x, known))  # noqa: B023
        assert list(wide.loc[row["row_id"], NAMES]) == pytest.approx(want)
        assert base + wide.loc[row["row_id"]].sum() == pytest.approx(predictions[row["row_id"]])


def test_a_single_leaf_has_no_attribution(spark, data):
    one = learners.learners("y")["RandomForest"]
    one.regressor._set(numTrees=2, maxDepth=0)
    model = learners.pipeline(one, NAMES).fit(data)
    long = at.attributions(model, data, NAMES)
    assert long.agg(F.max(F.abs("phi"))).first()[0] == 0.0 and long.count() == 450


def test_linear(spark, data):
    model = learners.pipeline(learners.learners("y")["LinearRegression"], NAMES).fit(data)
    long = at.attributions(model, data, NAMES)
    sums = long.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("total"))
    both = model.transform(data).join(sums, "row_id")
    assert both.where(F.abs(F.col("total") - F.col("prediction")) > 1e-9).count() == 0
    assert abs(long.groupBy("feature").agg(F.avg("phi").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-9


def crossed(df):
    v = vector_to_array("features")
    return df.withColumn("prediction", v[0] * v[1] * v[2] + 2 * v[0])


def test_sampled_over_all_orders_is_exact(spark, data):
    few = data.limit(5)
    background = at.background_rows(data, NAMES, rows=7)
    long = at.sampled_attributions(few, NAMES, crossed, background, permutations=400).toPandas()
    f = lambda x: x[0] * x[1] * x[2] + 2 * x[0]
    base = np.mean([f(b) for b in background])
    assert long["base"].iloc[0] == pytest.approx(base)
    for row in few.collect():
        x = [row[n] for n in NAMES]

        def value(known):
            return np.mean([f([x[i] if i in known else b[i] for i in range(3)]) for b in background])  # noqa: B023

        got = long[long["row_id"] == row["row_id"]].set_index("feature")["phi"]
        assert got.sum() + base == pytest.approx(f(x))
        # 400 sampled orders come close to all six
        assert list(got[NAMES]) == pytest.approx(shapley(NAMES, value), abs=0.35)


def test_summaries(spark, data):
    long = at.linear_attributions(data, {"a": 1.0, "b": -5.0, "c": 0.5}, 1.0)
    assert [r["feature"] for r in at.global_importance(long, 2).collect()] == ["b", "a"]
    assert {r["feature"] for r in at.dependence(long, 2).collect()} == {"a", "b"}
    steps = at.waterfall(long, "r3").collect()
    one = data.where("row_id = 'r3'").first()
    assert steps[0]["end"] == pytest.approx(1 + one["a"] - 5 * one["b"] + 0.5 * one["c"])
    assert steps[-1]["start"] == pytest.approx(steps[-1]["end"] - steps[-1]["phi"])
    folded = at.waterfall(long, "r3", top=1).collect()
    assert [r["feature"] for r in folded][1:] == ["other features"]
    assert folded[0]["end"] == pytest.approx(steps[0]["end"])


def test_cap_and_background_are_fixed_samples(spark, data):
    model = learners.pipeline(learners.learners("y")["LinearRegression"], NAMES).fit(data)
    capped = at.attributions(model, data, NAMES, cap=20)
    assert capped.count() == 60
    again = at.background_rows(data.repartition(9), NAMES)
    assert len(again) == 50 and again == at.background_rows(data, NAMES)


def test_rows_that_share_their_keys_stay_apart(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 1, 5.0), ("a", 1, 5.0), ("b", 2, 2.0), (None, 2, 3.0)],
        "company_name string, reporting_year int, x double",
    )
    rows = at.with_row_id(df)
    assert {r["row_id"]: r["x"] for r in rows.collect()} == {
        "a|1": 1.0, "a|1#2": 5.0, "a|1#3": 5.0, "b|2": 2.0, "2": 3.0,
    }
    identity = lambda t: t.withColumn("prediction", F.get("inputs", F.lit(0)))
    phi = at.sampled_attributions(rows, ["x"], identity, [[0.0]])
    assert {r["row_id"]: r["phi"] for r in phi.collect()} == {
        "a|1": 1.0, "a|1#2": 5.0, "a|1#3": 5.0, "b|2": 2.0, "2": 3.0,
    }
