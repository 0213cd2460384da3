import pytest
from conftest import plan_of
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from fumarole.operators import attribution, learners
from fumarole.operators.encode import GroupMean


@pytest.fixture(scope="module")
def rows(spark):
    found = [
        (i % 3, ["a", "b", None, "c"][i % 4], float(i), None if i % 5 == 0 else i / 7.0, float(i * i % 11))
        for i in range(60)
    ] + [(1, "only here", 4.0, 2.0, 3.0)]
    return spark.createDataFrame(found, "fold int, sector string, log_scope1_emissions double, log_scope2_emissions double, x double")


def test_group_means_of_all_folds_come_from_one_pass(rows, monkeypatch):
    first, passes = [GroupMean(groupCol="sector")], []
    plain = GroupMean.sums
    monkeypatch.setattr(GroupMean, "sums", lambda self, *a: passes.append(a[1:]) or plain(self, *a))
    names = ["x", "sector_mean_log_scope1", "sector_mean_log_scope2"]
    label = "log_scope1_emissions"
    linear = learners.learners(label)["LinearRegression"]
    fit = learners.fit_learner(linear, rows, label, names, 3, first=first)
    assert passes == [("fold",)]

    monkeypatch.undo()
    plan = learners.pipeline(linear, names, first)
    errors = []
    for fold in range(3):
        model = plan.fit(rows.where(F.col("fold") != fold))
        miss = F.col(label) - F.col("prediction")
        errors.append(model.transform(rows.where(F.col("fold") == fold)).agg(F.avg(miss * miss)).first()[0])
    assert fit.cv_mse == pytest.approx(sum(errors) / 3)
    one, two = (m.transform(rows).orderBy("log_scope1_emissions", "x").select("prediction").collect() for m in (fit.model, plan.fit(rows)))
    assert [r[0] for r in one] == pytest.approx([r[0] for r in two])


def test_fold_means_equal_a_fit_on_the_other_folds(rows):
    stage = GroupMean(groupCol="sector")
    sums = learners.fold_sums([stage], rows)
    for fold in (0, 1, 2, None):
        train = rows if fold is None else rows.where(F.col("fold") != fold)
        got, want = learners.fit_shared([stage], sums, train, fold).stages[0], Pipeline(stages=[stage]).fit(train).stages[0]
        assert got.overall == pytest.approx(want.overall)
        tables = [{r["group"]: tuple(r)[1:] for r in m.table.collect()} for m in (got, want)]
        assert tables[0].keys() == tables[1].keys()
        for group, means in tables[0].items():
            assert means == pytest.approx(tables[1][group])


def test_tree_attributions_stay_in_arrow(rows):
    """Long rows are built as Arrow columns, without an object for each text."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    forest = RandomForestRegressor(labelCol="log_scope1_emissions", numTrees=2, maxDepth=3, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=["x", "fold"], outputCol="features"), forest]).fit(rows)
    explained = rows.withColumn(attribution.ROW, F.monotonically_increasing_id().cast("string"))
    long = attribution.attributions(model, explained, ["x", "fold"])
    assert "MapInArrow" in plan_of(long) and "MapInPandas" not in plan_of(long)
    sums = long.groupBy(attribution.ROW).agg((F.sum("phi") + F.first("base")).alias("total"), F.count("*").alias("n"))
    both = model.transform(explained).join(sums, attribution.ROW)
    assert both.where((F.abs(F.col("total") - F.col("prediction")) > 1e-9) | (F.col("n") != 2)).count() == 0
    assert both.count() == 61
