import pathlib

import pytest
from conftest import companies
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.operators import learners, scoring
from fumarole.operators.split import add_folds
from fumarole.plans import train as jobs
from fumarole.operators.cleaning import fit_cleaning
from fumarole.plans.clean import clean, standard_rows
from fumarole.plans.features import features, fit_encoders
from fumarole.plans.ingest import merge_sources
from fumarole.session import materialise, shared_dir, stage_path
from fumarole.sources import schemas
from fumarole.sources.dimensions import country_macro
from fumarole.sources.files import read_table

SMALL = {
    "RandomForest": {"numTrees": 3, "maxDepth": 3, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"},
    "GradientBoosting": {"maxIter": -1},  # not a valid setting
}


@pytest.fixture(scope="module")
def cleaned(spark):
    return materialise(clean(merge_sources(companies(spark, 400), None, country_macro(spark))), "clean")


@pytest.fixture(scope="module")
def encoders(cleaned):
    return fit_encoders(cleaned)


@pytest.fixture(scope="module")
def trained(spark, cleaned, encoders):
    folder = stage_path(spark, "models")
    table = materialise(features(cleaned, encoders=encoders), "features")
    names = ["LinearRegression", "RandomForest", "GradientBoosting"]
    results = jobs.train(table, folder, [vocab.SCOPE1], names, smoke=True, draws=1, overrides=SMALL)
    return folder, results


def test_feature_table_schema(cleaned, encoders):
    table = features(cleaned, encoders=encoders)
    assert set(table.columns) == set(schemas.FEATURES.names)
    kinds = {f.name: f.dataType for f in schemas.FEATURES.fields}
    assert all(kinds[f.name] == f.dataType for f in table.schema.fields)
    assert len(vocab.FEATURES) == 19 and len(learners.feature_names(table.columns)) == 25


def test_snapshot_header(spark, cleaned, encoders):
    """Without fold-safe encoding a snapshot has the 25 features, the log target, the sector."""
    table = features(cleaned, encoders=encoders)
    _, test = jobs.split_for(table, vocab.SCOPE2, fold_safe=False)
    assert [c for c in test.columns if c not in (*vocab.KEYS, "country")] == schemas.held_out(vocab.SCOPE2).names
    assert test.count() == 80


def test_logs_and_means_are_left_alone(cleaned):
    table = features(cleaned, fit_group_means=False)
    assert not set(vocab.GROUP_MEANS) & set(table.columns)
    marked = cleaned.withColumn("log_revenue", F.lit(7.0))
    assert features(marked, fit_group_means=False).first()["log_revenue"] == 7.0


def test_training_records_failures_and_ranks(spark, trained):
    folder, results = trained
    by_name = {r["model"]: r for r in results.collect()}
    assert by_name["GradientBoosting"]["error"] and by_name["GradientBoosting"]["r2"] is None
    good = [by_name[n] for n in ("LinearRegression", "RandomForest")]
    assert all(r["error"] is None and r["cv_mse"] > 0 and r["log_r2"] > 0 for r in good)
    table = read_table(spark, f"{folder}/model_comparison_{vocab.SCOPE1}")
    assert {r["model"] for r in table.collect()} == {"LinearRegression", "RandomForest"}
    best = jobs.best_models(spark, folder)
    assert set(best) == {vocab.SCOPE1}
    assert best[vocab.SCOPE1][1]["r2"] == max(r["r2"] for r in good)


def test_evaluation(spark, trained):
    folder, results = trained
    report = jobs.evaluate(spark, folder)[vocab.SCOPE1]
    best = max(r["r2"] for r in results.collect() if r["r2"] is not None)
    assert report["metrics"].first()["r2"] == pytest.approx(best)
    assert report["points"].count() == 80
    assert report["residual_histogram"].agg(F.sum("n")).first()[0] == 80
    assert report["by_sector"].where("n_rows < 5").count() == 0


def test_scoring_a_portfolio(spark, trained, cleaned, encoders):
    folder, results = trained
    companies = cleaned.select(*vocab.KEYS, *vocab.CATEGORICAL, *vocab.NUMERIC)
    scored = jobs.score_companies(companies, folder, encoders).collect()
    r2 = jobs.best_models(spark, folder)[vocab.SCOPE1][1]["r2"]
    confidence = min(max((r2 + 0.5) / 2, 0), 1)
    assert len(scored) == 400
    for row in scored[:50]:
        assert row["scope1"] >= 0 and row["scope2"] == 0.0 and row["total"] == row["scope1"]
        assert row["confidence_score"] == round(confidence, 3)
        assert row["scope1_interval"]["lo"] <= row["scope1"] <= row["scope1_interval"]["hi"]
        assert set(row["feature_values"]) == {*vocab.FEATURES, *vocab.FLAGS}


def test_scoring_takes_the_training_steps(spark, cleaned, encoders):
    """Companies with gaps and odd spellings get the features that cleaning gave the same rows."""
    raw = merge_sources(companies(spark, 400), None, country_macro(spark))
    rows = standard_rows(raw)
    steps = fit_cleaning(rows)
    folder = stage_path(spark, "models")
    jobs.save_cleaning(spark, steps, folder)
    assert jobs.stored_cleaning(spark, folder) == steps
    odd = rows.withColumns(
        {"sector": F.concat(F.lit(" "), F.lower("sector")), "country": F.concat(F.col("country"), F.lit(" "))}
    ).drop(*vocab.TARGETS, *vocab.MACRO, "company_name_raw")
    names = [*vocab.LOG_OF.values(), *vocab.RATIO_OF, *vocab.MACRO, *vocab.CODES, *[f"{c}_missing" for c in vocab.NUMERIC]]
    got = jobs.company_features(odd, folder, encoders, [*names, "unheard_of"])
    assert got.where("unheard_of <> 0").count() == 0
    want = features(cleaned, encoders=encoders)
    keyed = lambda t: {
        (r["ticker"], r["reporting_year"]): [None if r[c] is None else round(float(r[c]), 9) for c in names]
        for r in t.collect()
    }
    assert keyed(got) == keyed(want)


def test_companies_are_scored_and_explained(spark, trained, cleaned, encoders):
    folder, _ = trained
    rows = cleaned.select(*vocab.KEYS, *vocab.CATEGORICAL, *vocab.NUMERIC).limit(20)
    long = jobs.explain_companies(rows, folder, encoders, [vocab.SCOPE1])[vocab.SCOPE1]
    scored = jobs.score_companies(rows, folder, encoders)
    total = long.groupBy("row_id").agg(F.expm1(F.sum("phi") + F.first("base")).alias("v")).collect()
    assert sorted(round(max(r["v"], 0), 1) for r in total) == pytest.approx(
        sorted(r["scope1"] for r in scored.collect()), rel=1e-3, abs=0.2
    )
    ranked = jobs.best_importances(spark, folder)[vocab.SCOPE1]
    assert ranked.count() == len(jobs.best_models(spark, folder)[vocab.SCOPE1][1]["features"])


def test_training_leaves_no_stage_tables(spark, cleaned, encoders, tmp_path):
    table = features(cleaned, encoders=encoders)
    place = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in place.iterdir()}
    jobs.train(table, str(tmp_path / "m"), [vocab.SCOPE1], ["LinearRegression"])
    left = {p.name.rsplit("-", 1)[0] for p in place.iterdir() if p.name not in before}
    assert left <= {"lookup"} - {"lookup"}


def test_explanations_add_up(spark, trained):
    folder, _ = trained
    long = jobs.explain(spark, folder, cap=30)[vocab.SCOPE1]
    assert long.select("row_id").distinct().count() == 30
    model, _ = jobs.best_models(spark, folder)[vocab.SCOPE1]
    from fumarole.operators.attribution import with_row_id

    held = with_row_id(jobs.scored_test(spark, folder, vocab.SCOPE1, model)).select("row_id", "prediction")
    sums = long.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("total")).join(held, "row_id")
    assert sums.where(F.abs(F.col("total") - F.col("prediction")) > 1e-6).count() == 0


def test_no_models_no_scores(spark, cleaned):
    folder = stage_path(spark, "empty")
    assert jobs.best_models(spark, folder) == {} and jobs.evaluate(spark, folder) == {}
    row = jobs.score_companies(cleaned.limit(3), folder).first()
    assert row["total"] == 0.0 and row["confidence_score"] == 0.5


def test_encoders_are_fitted_on_the_other_folds(spark, cleaned):
    """A constant shift of the held-out fold's target must not reach its features."""
    folded, folds = add_folds(cleaned, None)
    shifted = folded.withColumn(
        "log_scope1_emissions", F.col("log_scope1_emissions") + F.when(F.col("fold") == 0, 1000.0).otherwise(0.0)
    )
    one = learners.learners("log_scope1_emissions")["LinearRegression"]
    plan = learners.pipeline(one, ["sector_mean_log_scope1"], learners.encoders(cleaned, True)[:1])
    fitted = plan.fit(shifted.where("fold <> 0")).transform(shifted.where("fold = 0"))
    assert fitted.agg(F.max("sector_mean_log_scope1")).first()[0] < 100 and folds == 5


def test_draws_are_distinct_settings_of_the_grid():
    grid = vocab.GRIDS["HistogramBoosting"]
    draws = learners.draw_settings(grid, 30)
    assert len({tuple(sorted(d.items())) for d in draws}) == 30
    assert all(d[k] in grid[k] for d in draws for k in grid)
    assert learners.draw_settings(grid, 30) == draws
    small = {"a": [1, 2], "b": [3]}
    assert sorted(d["a"] for d in learners.draw_settings(small, 30)) == [1, 2]


def test_registry_and_smoke_grids():
    full, smoke = learners.learners("y"), learners.learners("y", smoke=True)
    assert len(full) == 6 and not full["LinearRegression"].grid
    assert learners.grid_size(full["GradientBoosting"].grid) == 576
    assert all(len(v) <= 2 for one in smoke.values() for v in one.grid.values())


def test_score_inputs(spark):
    rows = [("a", 2020, "Energy", "USA", None, 0.0, 0.5, 10.0), ("b", 2020, "Nope", "XXX", 9.0, 3.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "company_name string, reporting_year int, sector string, country string, revenue double, total_assets double, market_cap double, employee_count double")
    got = {r["company_name"]: r for r in scoring.score_features(df).collect()}
    assert got["a"]["asset_to_revenue"] == 1.0 and got["a"]["gdp_per_capita"] == 76330.0
    assert got["b"]["gdp_per_capita"] == 50000.0 and got["b"]["energy_intensity"] == 4.5
    assert got["b"]["sector_mean_log_scope1"] == pytest.approx(8.517393171418904)
    assert got["b"]["country_mean_log_scope1"] == 10.0 and got["b"]["sector_encoded"] == -1


def test_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, extra double")
    out = scoring.aligned(df, ["missing", "x"])
    assert out.columns == ["missing", "x"] and tuple(out.first()) == (0, 1.0)


def test_confidence():
    assert scoring.confidence_of({}) == 0.5
    assert scoring.confidence_of({vocab.SCOPE1: 0.9, vocab.SCOPE2: 0.7}) == pytest.approx(0.8)
    assert scoring.confidence_of({vocab.SCOPE1: -3.0, vocab.SCOPE2: 0.7}) == 0.0


def test_training_goes_on_where_it_stopped(spark, cleaned, encoders, monkeypatch):
    folder = stage_path(spark, "models")
    table = materialise(features(cleaned, encoders=encoders), "features")
    names = ["LinearRegression", "RandomForest"]
    fixed = {"RandomForest": {"numTrees": 2, "maxDepth": 2}}
    call = lambda: jobs.train(table, folder, [vocab.SCOPE1], names, smoke=True, draws=2, parallelism=1, overrides=fixed)
    fits, real = [], learners.held_out_error

    def counted(regressor, *rest):
        if len(fits) == 9:
            raise OSError("the cluster is gone")
        fits.append(type(regressor).__name__)
        return real(regressor, *rest)

    monkeypatch.setattr(learners, "held_out_error", counted)
    broken = {r["model"]: r["error"] for r in call().collect()}
    assert "the cluster is gone" in broken["RandomForest"]
    first, fits[:] = list(fits), []
    monkeypatch.setattr(learners, "held_out_error", lambda *a: fits.append(1) or real(*a))
    results = {r["model"]: r for r in call().collect()}
    folds = first.count("LinearRegression")
    assert folds >= 2 and len(first) + len(fits) == 3 * folds  # one setting and two, each fold once
    assert set(results) == set(names) and all(r["error"] is None and r["r2"] is not None for r in results.values())
    fits.clear()
    refits = []
    fit = learners.Pipeline.fit
    monkeypatch.setattr(learners.Pipeline, "fit", lambda self, *a: refits.append(1) or fit(self, *a))
    again = {r["model"]: r for r in call().collect()}
    assert not fits and not refits and again == results
    other = table.withColumn(f"log_{vocab.SCOPE1}", F.col(f"log_{vocab.SCOPE1}") + 1)
    anew = jobs.train(other, folder, [vocab.SCOPE1], names[:1], parallelism=1).first()
    assert fits and anew["error"] is None  # other rows are fitted anew
