"""Raw tables to one merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.operators.cleaning import normalise_countries
from fumarole.operators.joins import merge_financials, merge_indicators
from fumarole.sources.files import load_emissions, load_financials, nulls_only
from fumarole.sources.indicators import load_indicators


def merge_sources(
    emissions: DataFrame,
    financials: DataFrame | None = None,
    indicators: DataFrame | None = None,
    fill: bool = True,
    normalise_first: bool = True,
    null_safe: bool = False,
    unique_right: bool = False,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Emissions, left joined with financials on ticker and with indicators on country.

    ``fill`` takes nulls of shared columns from the financials. ``normalise_first`` brings
    country texts of both sides to codes before the indicator join, so that "US" finds the row
    of USA; ``aliases`` adds texts (alias, code), such as a landed ISO 3166 table.
    ``null_safe`` lets null keys match null keys.
    """
    df = nulls_only(emissions)
    if financials is not None:
        df = merge_financials(df, nulls_only(financials), fill, null_safe, unique_right)
    if normalise_first:
        df = normalise_countries(df, aliases)
    if indicators is not None:
        right = nulls_only(indicators)
        df = merge_indicators(df, by_code(right, aliases) if normalise_first else right, null_safe)
    return df


def by_code(indicators: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Indicators with country codes for texts, one row a code.

    Where several texts stand for one code, each indicator is taken from the first that has it:
    the code itself before other texts, then in alphabetical order.
    """
    spelled = indicators.withColumn("_text", F.col("country"))
    coded = normalise_countries(spelled, aliases)
    order = F.struct(F.col("_text") != F.col("country"), F.col("_text"))
    figures = [c for c in indicators.columns if c != "country"]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in figures]
    return coded.groupBy("country").agg(*first)


def ingest(
    spark: SparkSession,
    emissions_path: str,
    financials_path: str | None = None,
    indicators_path: str | None = None,
    long_indicators: bool = False,
    multi_line: bool = False,
    aliases: DataFrame | None = None,
    **options: bool,
) -> DataFrame:
    """Landed files as one merged table; only the two companions may be absent."""
    return merge_sources(
        load_emissions(spark, emissions_path, multi_line),
        load_financials(spark, financials_path),
        load_indicators(spark, indicators_path, long_indicators),
        aliases=aliases,
        **options,
    )
