"""Training, evaluation, scoring and explanation jobs over a model folder."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumarole import vocab
from fumarole.operators import attribution, metrics
from fumarole.operators.cleaning import Cleaning
from fumarole.operators.learners import (
    encoders,
    feature_names,
    fit_learner,
    fold_sums,
    importances,
    learners,
    prepare,
)
from fumarole.operators.metrics import best_model, both_scales, ranked_models
from fumarole.operators.profiling import histogram
from fumarole.operators.scoring import default_macro, score, score_features, with_all
from fumarole.operators.split import add_folds, stratified_split, train_and_test
from fumarole.plans.features import Encoders
from fumarole.plans.ledger import Ledger, stamp
from fumarole.session import materialise, owned_stages
from fumarole.sources.files import read_table, write_table

RESULTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("target", T.StringType()),
            ("model", T.StringType()),
            *[(f"{p}{m}", T.DoubleType()) for p in ("", "log_") for m in ("r2", "rmse", "mae", "mape")],
            ("cv_mse", T.DoubleType()),
            ("settings", T.StringType()),
            ("model_path", T.StringType()),
            ("error", T.StringType()),
        ]
    ]
)
META = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
    ]
)


def split_for(
    feature_table: DataFrame, target: str, fold_safe: bool = True, seed: int = vocab.SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and held-out rows of a target, both as stage tables.

    Rows without the target are left out. With ``fold_safe`` the group-mean columns are
    dropped here and come from pipeline stages fitted on training rows only.
    """
    known = default_macro(feature_table).where(F.col(f"log_{target}").isNotNull())
    if fold_safe:
        known = known.drop(*vocab.GROUP_MEANS)
    chosen = prepare(known, target, keys=[*vocab.KEYS, "country"])
    if fold_safe:
        # the encoders read both log targets
        logs = [F.col(f"log_{t}") for t in vocab.TARGETS if f"log_{t}" in known.columns]
        chosen = known.select(*[c for c in chosen.columns if c != f"log_{target}"], *logs)
    split = materialise(stratified_split(chosen, f"log_{target}", seed=seed), "split")
    return train_and_test(split)


def model_inputs(columns: Sequence[str], fold_safe: bool) -> list[str]:
    present = list(columns) + (vocab.GROUP_MEANS if fold_safe else [])
    return feature_names(present)


def train(
    feature_table: DataFrame,
    folder: str,
    targets: Sequence[str] = vocab.TARGETS,
    names: Sequence[str] | None = None,
    smoke: bool = False,
    fold_safe: bool = True,
    fold_group: str | None = "sector",
    draws: int | None = None,
    parallelism: int = 4,
    seed: int = vocab.SEED,
    overrides: dict[str, dict[str, object]] | None = None,
    cleaning: Cleaning | None = None,
) -> DataFrame:
    """Train the chosen models per target and save models, snapshots, tables and the best.

    A model that fails is recorded with its error and the others go on. ``overrides`` fixes
    regressor settings per model name and skips the search over them. ``cleaning`` is stored
    with the models, so that companies to score take the same steps. Returns one row per target
    and model; the job's stage tables are removed at its end.

    Finished fits are recorded in the folder by (rows, target, model, settings, setting, fold). A
    second call with the same rows, settings and folder reads them, and stored models, instead of
    fitting again.
    """
    spark = feature_table.sparkSession
    if cleaning is not None:
        save_cleaning(spark, cleaning, folder)
    draws = draws or (vocab.SMOKE_DRAWS if smoke else vocab.SEARCH_DRAWS)
    rows = []
    for target in targets:
        with owned_stages(spark):
            rows += _train_target(
                feature_table, folder, target, names, smoke, fold_safe, fold_group, draws,
                parallelism, seed, overrides or {},
            )
    return spark.createDataFrame(rows, RESULTS)


def _train_target(
    feature_table: DataFrame,
    folder: str,
    target: str,
    names: Sequence[str] | None,
    smoke: bool,
    fold_safe: bool,
    fold_group: str | None,
    draws: int,
    parallelism: int,
    seed: int,
    overrides: dict[str, dict[str, object]],
) -> list[dict]:
    spark, rows = feature_table.sparkSession, []
    label = f"log_{target}"
    train_rows, test_rows = split_for(feature_table, target, fold_safe, seed)
    write_table(test_rows, posixpath.join(folder, f"test_{target}"))
    inputs = model_inputs(train_rows.columns, fold_safe)
    folded, folds = add_folds(train_rows, fold_group)
    first = encoders(folded, fold_safe)
    sums = fold_sums(first, folded)
    ledger = Ledger(spark, posixpath.join(folder, "ledger"))
    job = (stamp(train_rows), target, fold_safe, fold_group, seed)
    for name, learner in learners(label, seed, smoke).items():
        if names is not None and name not in names:
            continue
        row = dict.fromkeys(RESULTS.names)
        row.update(target=target, model=name)
        try:
            fixed = overrides.get(name, {})
            if fixed:
                learner.regressor._set(**fixed)
                learner = type(learner)(
                    name, learner.regressor,
                    {k: v for k, v in learner.grid.items() if k not in fixed}, learner.scaled,
                )
            path = posixpath.join(folder, f"{target}_{name}")
            whole = Ledger.key("model", *job, name, fixed, learner.grid, draws)
            if whole not in ledger.known:
                key = lambda setting, fold: Ledger.key("fold", *job, name, fixed, setting, fold)  # noqa: E731, B023
                fit = fit_learner(
                    learner, folded, label, inputs, folds, draws, first, parallelism, seed,
                    remembered=lambda *at: ledger.known.get(key(*at)),  # noqa: B023
                    record=lambda setting, fold, error: ledger.add(key(setting, fold), error),  # noqa: B023
                    sums=sums,
                )
                fit.model.write().overwrite().save(path)
                ledger.add(whole, {"cv_mse": float(fit.cv_mse), "settings": fit.settings})
            done = ledger.known[whole]
            scored = PipelineModel.load(path).transform(test_rows)
            row.update(both_scales(scored, label, "prediction").first().asDict())
            row.update(cv_mse=done["cv_mse"], settings=str({**fixed, **done["settings"]}), model_path=path)
        except Exception as err:  # noqa: BLE001 - one model's failure must not stop the others
            row["error"] = f"{type(err).__name__}: {err}"
        rows.append(row)
    results = spark.createDataFrame(rows, RESULTS)
    write_table(ranked_models(results), posixpath.join(folder, f"model_comparison_{target}"))
    save_best(results, folder, target, inputs)
    return rows


def save_best(results: DataFrame, folder: str, target: str, inputs: Sequence[str]) -> None:
    """Record the best model: its name, score, place and feature order, in one row."""
    best = best_model(results).collect()
    if not best:
        return
    meta = [(best[0]["model"], target, best[0]["r2"], best[0]["model_path"], list(inputs))]
    write_table(
        results.sparkSession.createDataFrame(meta, META), posixpath.join(folder, f"best_{target}")
    )


def best_models(spark: SparkSession, folder: str, targets: Sequence[str] = vocab.TARGETS) -> dict:
    """Per target the best model and its description row; targets without one are left out."""
    found = {}
    for target in targets:
        try:
            meta = read_table(spark, posixpath.join(folder, f"best_{target}"), META).first()
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found[target] = (PipelineModel.load(meta["model_path"]), meta)
    return found


def scored_test(spark: SparkSession, folder: str, target: str, model: PipelineModel) -> DataFrame:
    """Held-out rows with actual and predicted values on the original scale."""
    held = read_table(spark, posixpath.join(folder, f"test_{target}"))
    scored = model.transform(held)
    return scored.withColumns(
        {"actual": F.expm1(f"log_{target}"), "predicted": F.expm1("prediction")}
    )


def evaluate(
    spark: SparkSession, folder: str, targets: Sequence[str] = vocab.TARGETS
) -> dict[str, dict[str, DataFrame]]:
    """Metrics, residuals, ideal-line ends and per-sector metrics of each best model."""
    reports = {}
    for target, (model, _) in best_models(spark, folder, targets).items():
        points = metrics.residuals(scored_test(spark, folder, target, model))
        points = materialise(points.select("actual", "predicted", "residual", "sector"), "scored")
        by_sector = metrics.metrics_by(points)
        write_table(by_sector, posixpath.join(folder, f"sector_performance_{target}"))
        comparison = read_table(spark, posixpath.join(folder, f"model_comparison_{target}"), RESULTS)
        reports[target] = {
            "metrics": metrics.metrics(points),
            "points": points,
            "residual_histogram": histogram(points, "residual", 40),
            "line": metrics.line_bounds(points),
            "by_sector": by_sector,
            **{f"models_by_{m}": metrics.sorted_by_metric(comparison, m) for m in ("r2", "rmse", "mae", "mape")},
        }
    return reports


def save_cleaning(spark: SparkSession, fitted: Cleaning, folder: str) -> None:
    """One JSON text, next to the models."""
    rows = [(json.dumps(fitted._asdict()),)]
    write_table(spark.createDataFrame(rows, "cleaning string"), posixpath.join(folder, "cleaning"))


def stored_cleaning(spark: SparkSession, folder: str) -> Cleaning | None:
    try:
        text = read_table(spark, posixpath.join(folder, "cleaning")).first()["cleaning"]
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Cleaning(**json.loads(text))


def company_features(
    companies: DataFrame, folder: str, fitted: Encoders | None, names: Sequence[str]
) -> DataFrame:
    """Features of companies to score, made by the steps stored with the models and aligned to
    the models' own feature lists."""
    steps = stored_cleaning(companies.sparkSession, folder)
    table = score_features(
        companies, fitted.means if fitted else (), fitted.codes if fitted else (), steps
    )
    return with_all(table, names)


def score_companies(
    companies: DataFrame, folder: str, fitted: Encoders | None = None, keep: Sequence[str] = vocab.KEYS
) -> DataFrame:
    """Score a company table with the best models of a folder.

    ``fitted`` are the encoders of the feature table the models were trained on; fold-safe
    models carry their own group means. The cleaning stored with the models is applied.
    """
    spark = companies.sparkSession
    best = best_models(spark, folder)
    names = dict.fromkeys(c for _, meta in best.values() for c in meta["features"])
    table = company_features(companies, folder, fitted, list(names))
    predictors = {
        target: (
            lambda df, out, model=model: model.transform(df)
            .withColumnRenamed("prediction", out)
            .drop("features", "scaled")
        )
        for target, (model, _) in best.items()
    }
    return score(table, predictors, {t: meta["r2"] for t, (_, meta) in best.items()}, keep)


def explain_companies(
    companies: DataFrame,
    folder: str,
    fitted: Encoders | None = None,
    targets: Sequence[str] = vocab.TARGETS,
) -> dict[str, DataFrame]:
    """Attributions of the predictions for a company table, one long table per target."""
    tables = {}
    for target, (model, meta) in best_models(companies.sparkSession, folder, targets).items():
        rows = company_features(companies, folder, fitted, meta["features"])
        tables[target] = attribution.attributions(model, attribution.with_row_id(rows), meta["features"])
    return tables


def best_importances(
    spark: SparkSession, folder: str, targets: Sequence[str] = vocab.TARGETS
) -> dict[str, DataFrame]:
    """Importance of every feature in the stored best model of each target."""
    return {
        target: importances(model, meta["features"])
        for target, (model, meta) in best_models(spark, folder, targets).items()
    }


def explain(
    spark: SparkSession,
    folder: str,
    targets: Sequence[str] = vocab.TARGETS,
    cap: int | None = None,
) -> dict[str, DataFrame]:
    """Attributions of held-out rows per target, written next to the models.

    Every held-out row is explained; ``cap`` asks for a fixed-size sample instead.
    """
    tables = {}
    for target, (model, meta) in best_models(spark, folder, targets).items():
        held = read_table(spark, posixpath.join(folder, f"test_{target}"))
        rows = attribution.with_row_id(held)
        long = attribution.attributions(model, rows, meta["features"], cap)
        path = posixpath.join(folder, f"attributions_{target}")
        write_table(long, path)
        tables[target] = read_table(spark, path, long.schema)
    return tables
