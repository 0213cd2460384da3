"""The six regressors, their search grids and pipelines."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from fumarole import vocab
from fumarole.functions.maths import safe_log1p
from fumarole.operators.boosting import HistogramTrees
from fumarole.operators.encode import GroupMean
from fumarole.session import small_table
from fumarole.sources.dimensions import local_table

#: Where the rows of a fit are held between its passes.
HELD = StorageLevel.MEMORY_AND_DISK


def feature_names(columns: Sequence[str]) -> list[str]:
    """Listed features that exist, then any other missingness flag in table order."""
    listed = [c for c in vocab.FEATURES if c in columns]
    return listed + [c for c in columns if c.endswith("_missing") and c not in listed]


def prepare(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Features, the log target and the sector (a constant where there is none)."""
    log = f"log_{target}"
    y = F.col(log) if log in df.columns else safe_log1p(F.col(target))
    sector = F.col("sector") if "sector" in df.columns else F.lit("0")
    keep = [k for k in keys if k in df.columns and k != "sector"]
    return df.select(*keep, *feature_names(df.columns), y.alias(log), sector.alias("sector"))


@dataclass(frozen=True)
class Learner:
    """A regressor on the ``features`` vector and the values its search may take."""

    name: str
    regressor: Estimator
    grid: Mapping[str, Sequence[object]] = field(default_factory=dict)
    scaled: bool = False

    def stages(self) -> list[Estimator]:
        if not self.scaled:
            return [self.regressor.copy()]
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled")
        return [scaler, self.regressor.copy()]


def learners(label: str, seed: int = vocab.SEED, smoke: bool = False) -> dict[str, Learner]:
    """The registry by model name; ``smoke`` keeps the first two values of each grid axis.

    Linear, forest and plain boosting are MLlib's; the three boosting variants are this library's
    own histogram trees (``operators/boosting.py``).
    """
    tree = {"labelCol": label, "featuresCol": "features", "seed": seed}
    boosted = {**tree, "maxIter": 100, "stepSize": 0.1}
    plain = {
        "LinearRegression": Learner(
            "LinearRegression", LinearRegression(labelCol=label, featuresCol="scaled"), {}, True
        ),
        "RandomForest": Learner("RandomForest", RandomForestRegressor(**tree, numTrees=100, maxDepth=10)),
        "GradientBoosting": Learner("GradientBoosting", GBTRegressor(**boosted, maxDepth=3)),
        "HistogramBoosting": Learner(
            "HistogramBoosting", HistogramTrees(**boosted, growth="level", maxDepth=6, lambda_=1.0)
        ),
        "OrderedBoosting": Learner(
            "OrderedBoosting", HistogramTrees(**boosted, growth="symmetric", maxDepth=6, lambda_=3.0)
        ),
        "LeafwiseBoosting": Learner(
            "LeafwiseBoosting",
            HistogramTrees(**boosted, growth="leaf", maxDepth=-1, numLeaves=31, minInstancesPerNode=20, lambda_=0.0),
        ),
    }
    grids = {
        name: {k: values[:2] if smoke else values for k, values in grid.items()}
        for name, grid in vocab.GRIDS.items()
    }
    return {
        name: Learner(name, one.regressor, grids.get(name, {}), one.scaled)
        for name, one in plain.items()
    }


def grid_size(grid: Mapping[str, Sequence[object]]) -> int:
    return math.prod(len(values) for values in grid.values())


def draw_settings(
    grid: Mapping[str, Sequence[object]], draws: int, seed: int = vocab.SEED
) -> list[dict[str, object]]:
    """Distinct settings of a grid, at most ``draws``, without building the whole product."""
    size = grid_size(grid)
    picked = random.Random(seed).sample(range(size), min(draws, size))
    return [_setting(grid, number) for number in picked]


def _setting(grid: Mapping[str, Sequence[object]], number: int) -> dict[str, object]:
    setting = {}
    for name, values in grid.items():
        number, at = divmod(number, len(values))
        setting[name] = values[at]
    return setting


def encoders(df: DataFrame, fold_safe: bool) -> list[Estimator]:
    """Group-mean stages, for tables that carry the targets; fitted inside each fold."""
    if not fold_safe:
        return []
    return [GroupMean(groupCol=g) for g in ("sector", "country") if g in df.columns]


def fold_sums(first: Sequence[Estimator], rows: DataFrame) -> list[DataFrame]:
    """Per group-mean stage its sums by group and fold: one pass for the fits of all folds."""
    return [stage.sums(rows, "fold") for stage in first]


def fit_shared(
    stages: Sequence[Estimator], sums: Sequence[DataFrame], train: DataFrame, fold: int | None = None
) -> PipelineModel:
    """The stages before the regressor, fitted on rows outside of ``fold`` (all rows if none).

    The first stages are group means, made from their ``sums`` by group and fold; ``train`` is read
    only by those that follow.
    """
    means = []
    for stage, cells in zip(stages, sums):
        kept = cells if fold is None else cells.where(F.col("fold") != fold)
        group = stage.getOrDefault(stage.groupCol)
        totals = [F.sum(c).alias(c) for c in cells.columns if c not in (group, "fold")]
        means.append(stage.fit_sums(small_table(kept.groupBy(group).agg(*totals))))
    encoded = PipelineModel(stages=means).transform(train)
    rest = Pipeline(stages=list(stages[len(sums) :])).fit(encoded)
    return PipelineModel(stages=[*means, *rest.stages])


def pipeline(learner: Learner, names: Sequence[str], first: Sequence[Estimator] = ()) -> Pipeline:
    vector = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[*first, vector, *learner.stages()])


@dataclass
class Fit:
    """A fitted pipeline, its cross-validated error, its settings, and all settings tried."""

    model: PipelineModel
    cv_mse: float
    settings: dict[str, object]
    tried: list[tuple[dict[str, object], float]] = field(default_factory=list)


def held_out_error(regressor: Estimator, setting: Mapping[str, object], train: DataFrame, held: DataFrame, label: str) -> float | None:
    """Mean squared error of one fit on rows held out of it; none where there are no such rows."""
    model = regressor.fit(train, {regressor.getParam(k): v for k, v in setting.items()})
    miss = F.col(label) - F.col("prediction")
    return model.transform(held).agg(F.avg(miss * miss)).first()[0]


def fold_errors(
    plan: Pipeline,
    settings: Sequence[dict[str, object]],
    rows: DataFrame,
    label: str,
    folds: int,
    parallelism: int = 4,
    remembered: Callable[[dict[str, object], int], float | None] | None = None,
    record: Callable[[dict[str, object], int, float | None], None] | None = None,
    sums: Sequence[DataFrame] = (),
) -> list[float]:
    """Mean over the folds of the held-out squared error, per setting.

    The stages before the regressor (encoders, assembly, scaling) are fitted once per fold,
    on the other folds only, and shared by all settings; leading group means come from their
    ``sums``. A fold's training rows are held, as memory or disk, until its errors are known. Threads
    submit the jobs. Errors that are ``remembered`` by (setting, fold) are not fitted again, new ones
    go to ``record``.
    """
    *shared, regressor = plan.getStages()
    done: dict[tuple[int, int], float | None] = {}
    for s, setting in enumerate(settings):
        for fold in range(folds):
            found = remembered(setting, fold) if remembered else None
            if found is not None:
                done[s, fold] = found

    def prepare_fold(fold: int) -> tuple[DataFrame, DataFrame] | None:
        if all((s, fold) in done for s in range(len(settings))):
            return None
        train, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        fitted = fit_shared(shared, sums, train, fold)
        columns = [label, regressor.getFeaturesCol()]
        return fitted.transform(train).select(columns).persist(HELD), fitted.transform(held).select(columns)

    def error(task: tuple[int, int]) -> float | None:
        s, fold = task
        if task not in done:
            done[task] = held_out_error(regressor, settings[s], *prepared[fold], label)
            if record:
                record(settings[s], fold, done[task])
        return done[task]

    inherit = inheritable_thread_target(rows.sparkSession)
    with ThreadPool(parallelism) as pool:
        prepared = pool.map(inherit(prepare_fold), range(folds))
        tasks = [(s, fold) for s in range(len(settings)) for fold in range(folds)]
        try:
            found = pool.map(inherit(error), tasks, chunksize=1)
        finally:
            for pair in prepared:
                if pair is not None:
                    pair[0].unpersist()
    means = []
    for at in range(0, len(found), folds):
        held = [e for e in found[at:at + folds] if e is not None]  # an empty fold has no error
        means.append(sum(held) / len(held))
    return means


def fit_learner(
    learner: Learner,
    train: DataFrame,
    label: str,
    names: Sequence[str],
    folds: int,
    draws: int = vocab.SEARCH_DRAWS,
    first: Sequence[Estimator] = (),
    parallelism: int = 4,
    seed: int = vocab.SEED,
    remembered: Callable[[dict[str, object], int], float | None] | None = None,
    record: Callable[[dict[str, object], int, float | None], None] | None = None,
    sums: Sequence[DataFrame] | None = None,
) -> Fit:
    """Random search over the learner's grid by cross-validated squared error, then a refit.

    ``train`` carries the fold number of each row in ``fold``. A learner without a grid is
    scored and fitted as it is. ``sums`` are the ``fold_sums`` of ``first``, if known already.
    """
    plan = pipeline(learner, names, first)
    *shared, regressor = plan.getStages()
    sums = fold_sums(first, train) if sums is None else sums
    settings = draw_settings(learner.grid, draws, seed) if learner.grid else [{}]
    errors = fold_errors(plan, settings, train, label, folds, parallelism, remembered, record, sums)
    best = min(range(len(settings)), key=errors.__getitem__)
    chosen = {regressor.getParam(k): v for k, v in settings[best].items()}
    fitted = fit_shared(shared, sums, train)
    rows = fitted.transform(train).select(label, regressor.getFeaturesCol()).persist(HELD)
    try:
        model = PipelineModel(stages=[*fitted.stages, regressor.fit(rows, chosen)])
    finally:
        rows.unpersist()
    return Fit(model, errors[best], settings[best], list(zip(settings, errors)))


def importances(model: PipelineModel, names: Sequence[str], top: int | None = None) -> DataFrame:
    """Tree importance or absolute coefficient per feature, largest first; ``top`` keeps as many."""
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, abs(float(w))) for n, w in zip(names, weights.toArray())]
    table = local_table(SparkSession.active(), rows, ["feature", "importance"])
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)
