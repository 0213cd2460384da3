"""Regression metrics and model rankings as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.functions.maths import residual


def metric_columns(actual: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """R2, RMSE, MAE and MAPE (percent, over non-zero actuals) of complete pairs."""
    both = actual.isNotNull() & predicted.isNotNull()
    y, p = F.when(both, actual), F.when(both, predicted)
    n = F.count(y)
    error = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * n
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(spread > 0, 1 - F.try_divide(error, spread))
        .when(error == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return [
        r2.alias(f"{prefix}r2"),
        F.sqrt(F.try_divide(error, n)).alias(f"{prefix}rmse"),
        F.avg(F.abs(y - p)).alias(f"{prefix}mae"),
        (F.avg(F.abs(F.try_divide(y - p, y))) * 100).alias(f"{prefix}mape"),
    ]


def metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", prefix: str = ""
) -> DataFrame:
    return df.agg(*metric_columns(F.col(actual), F.col(predicted), prefix))


def both_scales(df: DataFrame, log_actual: str, log_predicted: str) -> DataFrame:
    """Metrics on the original scale and, prefixed ``log_``, on the log scale."""
    y, p = F.col(log_actual), F.col(log_predicted)
    return df.agg(*metric_columns(F.expm1(y), F.expm1(p)), *metric_columns(y, p, "log_"))


def metrics_by(
    df: DataFrame,
    group: str = "sector",
    actual: str = "actual",
    predicted: str = "predicted",
    min_rows: int = vocab.SECTOR_MIN_ROWS,
) -> DataFrame:
    """Metrics per group, small groups left out, worst R2 first."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_rows"), *metric_columns(F.col(actual), F.col(predicted)))
        .where(F.col("n_rows") >= min_rows)
        .orderBy("r2", group)
    )


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", residual(F.col(actual), F.col(predicted)))


def line_bounds(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Ends of the line on which actual equals predicted."""
    return df.agg(
        F.least(F.min(actual), F.min(predicted)).alias("lo"),
        F.greatest(F.max(actual), F.max(predicted)).alias("hi"),
    )


def ranked_models(results: DataFrame) -> DataFrame:
    """Comparison table, failed models left out, best R2 first."""
    return results.where(F.col("error").isNull()).orderBy(F.desc_nulls_last("r2"), "rmse", "model")


def sorted_by_metric(results: DataFrame, metric: str) -> DataFrame:
    """Best model first: high R2, low error."""
    best_first = F.desc_nulls_last(metric) if metric == "r2" else F.asc_nulls_last(metric)
    return results.select("model", metric).orderBy(best_first, "model")


def best_model(results: DataFrame) -> DataFrame:
    """The model with the highest R2 on the original scale; lower RMSE, then name, on a tie."""
    return ranked_models(results).limit(1)


def long_metrics(results: DataFrame, names: Sequence[str] = ("r2", "rmse", "mae", "mape")) -> DataFrame:
    return results.unpivot(["model"], list(names), "metric", "value")
