"""Per-row attributions as long tables: row id, feature, value, phi, base.

For every row the base plus the sum of phi is the prediction.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.operators.boosting import HistogramModel
from fumarole.operators.split import hash_sample
from fumarole.session import stage_path

ROW = "row_id"


def with_row_id(df: DataFrame, keys: Sequence[str] = vocab.KEYS) -> DataFrame:
    """A row id that is unique by construction: the keys, and a number where rows share them.

    Rows that share their keys are numbered in the order of all their columns, so the ids are
    the same in every run.
    """
    plain = df.withColumn(ROW, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    simple = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "udt")]
    number = F.row_number().over(Window.partitionBy(ROW).orderBy(*simple))
    numbered = plain.withColumn("_number", number)
    again = F.concat(F.col(ROW), F.lit("#"), F.col("_number").cast("string"))
    return numbered.withColumn(ROW, F.when(F.col("_number") == 1, F.col(ROW)).otherwise(again)).drop("_number")


# --- linear ------------------------------------------------------------------------------


def linear_attributions(
    df: DataFrame,
    coefficients: Mapping[str, float],
    intercept: float = 0.0,
    means: Mapping[str, float] | None = None,
) -> DataFrame:
    """phi = coefficient x (value - mean); the base is the prediction at the means.

    The means are taken from ``df`` in one aggregate unless given. Long form by an in-row
    expansion, without a shuffle.
    """
    names = list(coefficients)
    if means is None:
        means = df.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
    base = intercept + sum(coefficients[c] * means[c] for c in names)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                (F.lit(float(coefficients[c])) * (F.col(c) - F.lit(float(means[c])))).alias("phi"),
            )
            for c in names
        ]
    )
    return df.select(ROW, F.inline(cells)).withColumn("base", F.lit(float(base)))


def raw_coefficients(model: PipelineModel, names: Sequence[str]) -> tuple[dict[str, float], float]:
    """Coefficients and intercept on the unscaled features of a scaled linear pipeline."""
    scaler, linear = model.stages[-2], model.stages[-1]
    std, mean = scaler.std.toArray(), scaler.mean.toArray()
    scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
    coef = linear.coefficients.toArray() * scale
    return dict(zip(names, map(float, coef))), float(linear.intercept - coef @ mean)


# --- trees -------------------------------------------------------------------------------


class Leaf(NamedTuple):
    """A leaf's weight and, per feature on its path, the interval (lo, hi] that reaches it
    and the share of training rows that take the path's branches on that feature."""

    value: float
    features: list[int]
    lo: list[float]
    hi: list[float]
    cover: list[float]


class Leaves(NamedTuple):
    """All leaves with paths of one length, as arrays with a row for each leaf."""

    value: np.ndarray
    features: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    cover: np.ndarray


#: Cells (rows x leaves x path) of one step of the tree attribution.
STEP_CELLS = 1 << 20


def tree_leaves(model) -> list[Leaf]:
    """Leaves of a fitted MLlib tree ensemble with continuous splits.

    Read as columns from the node table of the saved model, which is as large as the model that
    the driver holds already.
    """
    if isinstance(model, HistogramModel):
        names = {"left": "leftChild", "right": "rightChild", "feature": "featureIndex", "value": "prediction", "count": "rawCount"}
        trees = model.nodes().query("tree >= 0").rename(columns=names).groupby("tree")
        return [leaf for _, tree in trees for leaf in _leaves(tree.to_dict("list"), 1.0)]
    spark = SparkSession.active()
    path = stage_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.numCategories",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    table = nodes.orderBy("treeID", "id").toArrow()
    columns = {name: table[name].to_numpy() for name in table.column_names}
    inner = columns["leftChild"] >= 0
    if (columns["numCategories"][inner] != -1).any():
        raise ValueError("categorical splits are not supported")
    weights = model.treeWeights
    average = 1.0 / sum(weights) if isinstance(model, RandomForestRegressionModel) else 1.0
    starts = np.flatnonzero(np.diff(columns["treeID"], prepend=-1))
    leaves: list[Leaf] = []
    for start, stop in zip(starts, np.append(starts[1:], len(inner))):
        tree = {name: column[start:stop].tolist() for name, column in columns.items()}
        leaves += _leaves(tree, weights[tree["treeID"][0]] * average)
    return leaves


def _leaves(tree: Mapping[str, list], weight: float) -> Iterator[Leaf]:
    """Leaves of one tree, given as columns; node ids count from 0 without gaps."""
    everywhere = (-np.inf, np.inf, 1.0)
    open_nodes: list[tuple[int, dict]] = [(0, {})]
    while open_nodes:
        node, path = open_nodes.pop()
        left, right = tree["leftChild"][node], tree["rightChild"][node]
        if left < 0:
            if not tree["prediction"][node]:
                continue  # adds nothing; leaves without training rows are among them
            features = sorted(path)
            bounds = [path[f] for f in features]
            lo, hi, cover = ([b[i] for b in bounds] for i in range(3))
            yield Leaf(weight * tree["prediction"][node], features, lo, hi, cover)
            continue
        at, threshold = tree["featureIndex"][node], tree["threshold"][node]
        lo, hi, cover = path.get(at, everywhere)
        for child, bounds in ((left, (lo, min(hi, threshold))), (right, (max(lo, threshold), hi))):
            share = cover * tree["rawCount"][child] / max(tree["rawCount"][node], 1)  # leaves may be empty
            open_nodes.append((child, {**path, at: (*bounds, share)}))


def tree_base(leaves: Sequence[Leaf]) -> float:
    """Mean prediction over the training rows that fell into each leaf."""
    return float(sum(leaf.value * math.prod(leaf.cover) for leaf in leaves))


def by_length(leaves: Sequence[Leaf]) -> list[Leaves]:
    """The leaves that split at all, gathered by the length of their path."""
    groups: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        if leaf.features:
            groups.setdefault(len(leaf.features), []).append(leaf)
    return [Leaves(*map(np.array, zip(*group))) for _, group in sorted(groups.items())]


@cache
def integration_points(length: int) -> list[tuple[float, float]]:
    """Gauss-Legendre points and weights on [0, 1] that integrate a path of this length exactly."""
    points, weights = np.polynomial.legendre.leggauss(max(1, (length + 1) // 2))
    return list(zip(((points + 1) / 2).tolist(), (weights / 2).tolist()))


def leaves_phi(group: Leaves, x: np.ndarray) -> np.ndarray:
    """Shapley values of many leaves for a batch: rows x features, summed over the leaves.

    A feature is either on the leaf's side (1), off it (0) or unknown (its cover). The
    Shapley weights are the integral over t in [0, 1] of the product of the other features'
    terms cover + (side - cover) * t, a polynomial that Gauss-Legendre points integrate
    exactly.
    """
    phi = np.zeros_like(x)
    length = group.features.shape[1]
    leaves = max(1, STEP_CELLS // max(1, len(x) * length))
    for i in range(0, len(group.value), leaves):
        part = Leaves(*(column[i : i + leaves] for column in group))
        columns = x[:, part.features]
        side = ((columns > part.lo) & (columns <= part.hi)).astype(float) - part.cover
        others = np.zeros_like(side)
        for t, weight in integration_points(length):
            terms = part.cover + side * t
            others += weight * terms.prod(axis=2, keepdims=True) / terms
        effect = (part.value[:, None] * side * others).reshape(len(x), -1)
        place = part.features.ravel()
        order = np.argsort(place, kind="stable")
        begins = np.flatnonzero(np.diff(place[order], prepend=-1))
        phi[:, place[order[begins]]] += np.add.reduceat(effect[:, order], begins, axis=1)
    return phi


def tree_attributions(df: DataFrame, model, names: Sequence[str]) -> DataFrame:
    """Path-dependent tree attributions, batch by batch in each task."""
    leaves = tree_leaves(model)
    base = tree_base(leaves) + (model.base if isinstance(model, HistogramModel) else 0.0)
    shared = SparkSession.active().sparkContext.broadcast(by_length(leaves))
    names = list(names)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(names, pa.string())
        for batch in batches:
            n = batch.num_rows
            x = np.empty((n, len(names)))
            for i in range(len(names)):
                x[:, i] = batch.column(i + 1).to_numpy(zero_copy_only=False)
            phi = np.zeros_like(x)
            for start in range(0, n, 256):
                rows = x[start : start + 256]
                for group in shared.value:
                    phi[start : start + 256] += leaves_phi(group, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), len(names)))),
                    labels.take(pa.array(np.tile(np.arange(len(names)), n))),
                    pa.array(x.ravel(), from_pandas=True),
                    pa.array(phi.ravel(), from_pandas=True),
                ],
                [ROW, "feature", "value", "phi"],
            )

    wide = df.select(ROW, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    long = wide.mapInArrow(explain, f"{ROW} string, feature string, value double, phi double")
    return long.withColumn("base", F.lit(base))


# --- any model ---------------------------------------------------------------------------


def background_rows(
    df: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = (ROW,),
    rows: int = vocab.BACKGROUND_ROWS,
    seed: int = vocab.SEED,
) -> list[list[float]]:
    """A fixed-size sample of reference rows, as plain values."""
    picked = hash_sample(df.select(*keys, *names), rows, keys, seed).select(*names)
    return [[float(v) for v in row] for row in picked.collect()]


def sampled_attributions(
    df: DataFrame,
    names: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    background: Sequence[Sequence[float]],
    permutations: int = 4,
    seed: int = vocab.SEED,
) -> DataFrame:
    """Attributions of any model by switching features from background to row values.

    For each row, background row and feature order, the features are switched one by one;
    the change of the prediction goes to the switched feature. ``predict`` adds
    ``prediction`` to a table with the ``inputs`` array and the same as a ``features`` vector.
    Each row expands in place to permutations x background x (features + 1) predictions and
    needs a unique ``row_id``. Orders come in pairs with their reverse.
    """
    names, n = list(names), len(names)
    draw = random.Random(seed)
    orders: list[list[int]] = []
    while len(orders) < permutations:
        order = draw.sample(range(n), n)
        orders += [order, order[::-1]]
    orders = orders[:permutations]
    places = [[order.index(i) for i in range(n)] for order in orders]
    plans = F.array(
        *[
            F.struct(F.lit(number).alias("number"), F.lit(place).alias("place"))
            for number, place in enumerate(places)
        ]
    )
    reference = F.array(*[F.lit([float(v) for v in row]) for row in background])
    x = F.array(*[F.col(c).cast("double") for c in names])
    # rows grow in place, so they are spread by row id first; the sums per row then stay put
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(ROW, x.alias("x")).repartition(tasks, ROW)
    switched = (
        spread
        .select(ROW, "x", F.explode(plans).alias("plan"))
        .select(ROW, "x", "plan", F.explode(reference).alias("b"))
        .select(ROW, "x", "plan", "b", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"))
    )
    mixed = F.array(
        *[
            F.when(F.get("plan.place", F.lit(i)) < F.col("step"), F.get("x", F.lit(i)))
            .otherwise(F.get("b", F.lit(i)))
            for i in range(n)
        ]
    )
    scored = predict(
        switched.select(
            ROW, "step", F.col("plan.number").alias("plan"), mixed.alias("inputs")
        ).withColumn("features", array_to_vector("inputs"))
    )
    # numbers only, so that both aggregates hash; the rows' values come back by row id
    totals = scored.groupBy(ROW, "plan", "step").agg(F.sum("prediction").alias("total"))

    # step k switches the k-th feature of the order: it gains the step's total and pays the last
    at = F.get(F.array(*[F.lit(order) for order in orders]), F.col("plan"))

    def gain(i: Column, change: Column) -> Column:
        return F.struct(i.alias("i"), change.alias("change"))

    gains = F.array(
        gain(F.get(at, F.col("step") - 1), F.col("total")),
        gain(F.get(at, F.col("step")), -F.col("total")),
    )
    runs = float(len(orders) * len(background))
    sums = (
        totals.select(ROW, F.explode(gains).alias("g"))
        .where("g.i is not null")
        .groupBy(ROW, "g.i")
        .agg((F.sum("g.change") / runs).alias("phi"))
        .join(spread, ROW)
    )
    spark = df.sparkSession
    at_background = predict(
        spark.createDataFrame([(list(row),) for row in background], "inputs array<double>")
        .withColumn("features", array_to_vector("inputs"))
    )
    base = at_background.agg(F.avg("prediction")).first()[0]
    label = F.get(F.array(*[F.lit(c) for c in names]), F.col("i"))
    return sums.select(
        ROW, label.alias("feature"), F.get("x", F.col("i")).alias("value"), "phi", F.lit(base).alias("base")
    )


# --- dispatch and summaries --------------------------------------------------------------


def after_assembly(model: PipelineModel) -> PipelineModel:
    """The stages of a fitted pipeline that follow its feature vector."""
    at = max(i for i, stage in enumerate(model.stages) if isinstance(stage, VectorAssembler))
    return PipelineModel(stages=model.stages[at + 1:])


def before_assembly(model: PipelineModel) -> PipelineModel:
    """The stages that come before the feature vector (fitted encoders)."""
    at = max(i for i, stage in enumerate(model.stages) if isinstance(stage, VectorAssembler))
    return PipelineModel(stages=model.stages[:at])


def attributions(
    model: PipelineModel,
    df: DataFrame,
    names: Sequence[str],
    cap: int | None = None,
    background: Sequence[Sequence[float]] | None = None,
    permutations: int = 4,
) -> DataFrame:
    """Attributions by model family: trees, linear, any other.

    ``df`` has ``row_id`` and the features. ``cap`` explains a fixed-size sample instead of
    all rows.
    """
    if cap is not None:
        df = hash_sample(df, cap, [ROW])
    df = before_assembly(model).transform(df)
    last = model.stages[-1]
    if isinstance(last, (RandomForestRegressionModel, GBTRegressionModel, HistogramModel)):
        return tree_attributions(df, last, names)
    if isinstance(last, LinearRegressionModel):
        coefficients, intercept = raw_coefficients(model, names)
        return linear_attributions(df, coefficients, intercept)
    background = background_rows(df, names) if background is None else background
    tail = after_assembly(model)
    return sampled_attributions(df, names, tail.transform, background, permutations)


def global_importance(long: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    table = (
        long.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
        .orderBy(F.desc("mean_abs_phi"), "feature")
    )
    return table if top is None else table.limit(top)


def dependence(long: DataFrame, top: int = 4) -> DataFrame:
    """Feature value against attribution for the most important features."""
    leading = F.broadcast(global_importance(long, top).select("feature"))
    return long.join(leading, "feature", "left_semi").select("feature", ROW, "value", "phi")


def waterfall(long: DataFrame, row_id: str, top: int | None = None) -> DataFrame:
    """One row's attributions from the base to the prediction, smallest effects first.

    ``top`` keeps the largest effects apart and adds up the others.
    """
    size = Window.partitionBy(ROW).orderBy(F.desc(F.abs("phi")), "feature")
    one = long.where(F.col(ROW) == row_id).withColumn("rank", F.row_number().over(size))
    if top is not None:
        name = F.when(F.col("rank") <= top, F.col("feature")).otherwise(F.lit("other features"))
        one = (
            one.withColumns({"feature": name, "rank": F.least("rank", F.lit(top + 1))})
            .groupBy(ROW, "feature", "rank")
            .agg(
                F.when(F.count("value") == 1, F.first("value")).alias("value"),
                F.sum("phi").alias("phi"),
                F.first("base").alias("base"),
            )
        )
    upward = Window.partitionBy(ROW).orderBy(F.desc("rank"))
    end = F.col("base") + F.sum("phi").over(upward)
    return one.select(
        ROW, "rank", "feature", "value", "phi", (end - F.col("phi")).alias("start"), end.alias("end")
    ).orderBy("rank")
