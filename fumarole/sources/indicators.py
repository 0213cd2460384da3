"""Country indicators: the latest value per country, one column per indicator."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.sources import schemas
from fumarole.sources.files import load_or_empty


def latest_wide(
    long: DataFrame,
    names: Mapping[str, str] = vocab.INDICATORS,
    key: str = "country",
    order: str = "year",
) -> DataFrame:
    """Most recent non-null value of each named indicator, the largest of one year, per key.

    Equals joining one table per indicator with full outer joins, in a single grouped pass
    with partial aggregation: a key with any of the indicators keeps a row.
    """
    known = long.where(F.col("indicator").isin(list(names)) & F.col("value").isNotNull())
    return known.groupBy(key).agg(
        *[
            F.max_by(
                "value", F.when(F.col("indicator") == code, F.struct(order, "value"))
            ).alias(name)
            for code, name in names.items()
        ]
    )


def outer_wide(
    long: DataFrame,
    names: Mapping[str, str] = vocab.INDICATORS,
    key: str = "country",
    order: str = "year",
) -> DataFrame:
    """The same table as a chain of full outer joins of one table per indicator."""
    parts = [
        long.where((F.col("indicator") == code) & F.col("value").isNotNull())
        .groupBy(key)
        .agg(F.max_by("value", F.struct(order, "value")).alias(name))
        for code, name in names.items()
    ]
    return reduce(lambda left, right: left.join(right, key, "full"), parts)


def load_indicators(spark: SparkSession, path: str | None, long: bool = False) -> DataFrame:
    """The landed indicator table, wide as stored or pivoted from (country, indicator, year)."""
    if long:
        return latest_wide(load_or_empty(spark, path, schemas.INDICATORS_LONG))
    return load_or_empty(spark, path, schemas.INDICATORS)
