"""Keep the most complete row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumarole import vocab


def non_null_count(columns: Sequence[str]) -> Column:
    """Number of columns of a row that hold a value."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def most_complete(df: DataFrame, keys: Sequence[str] = vocab.KEYS) -> DataFrame:
    """One row per key: most non-null cells first, then the smallest remaining columns.

    Spark keeps one row per key in each task before the shuffle (a window group limit), so a
    key with very many copies sends at most one row per task.
    """
    present = [k for k in keys if k in df.columns]
    rest = [c for c in df.columns if c not in present]
    order = [non_null_count(df.columns).desc(), *[F.col(c).asc_nulls_last() for c in rest]]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*present).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
