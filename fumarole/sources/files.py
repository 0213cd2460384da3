"""CSV and Parquet scans and sinks, and the landed emissions and financials tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumarole import vocab
from fumarole.functions.maths import null_nan
from fumarole.sources import schemas

# fixed values: cell texts read as missing
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Scan a CSV file with a header; a missing path raises ``AnalysisException``.

    Columns are found by header name, so their order is free and optional ones may be
    absent. Columns outside ``schema`` stay text. Nothing is inferred from the data.
    ``multi_line`` reads cells that hold line breaks, at the price of one task for each file;
    without it files are split, and a line break always ends a row.
    """
    raw = spark.read.options(header=True, escape="\"", multiLine=multi_line).csv(path)
    kinds = {f.name: f.dataType for f in schema.fields}
    return raw.select([_typed(name, kinds.get(name, T.StringType())) for name in raw.columns])


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.col(f"`{name}`")
    known = F.when(~text.isin(MISSING_TEXTS), text)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        # an integer column with gaps may have been written as "2021.0"
        known = known.cast("double")
    return known.cast(kind).alias(name)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file per partition with a header; an earlier table at ``path`` is replaced.

    Cells with line breaks are quoted; ``read_csv`` needs ``multi_line`` for them.
    """
    df.write.mode("overwrite").options(
        header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def require_columns(df: DataFrame, required: Iterable[str], context: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"[{context}] missing columns: {missing}")


def emissions_summary(df: DataFrame) -> DataFrame:
    """Row count and year range of a table that has the required columns."""
    require_columns(df, vocab.REQUIRED, "emissions")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("reporting_year").alias("first_year"),
        F.max("reporting_year").alias("last_year"),
    )


def load_emissions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The landed emissions table; a missing path or column raises."""
    df = read_csv(spark, path, schemas.EMISSIONS, multi_line)
    require_columns(df, vocab.REQUIRED, "emissions")
    return df


def load_or_empty(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """A landed CSV table, or an empty one with the same schema."""
    if path is not None:
        try:
            return read_csv(spark, path, schema)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def load_financials(
    spark: SparkSession, path: str | None, tickers: Iterable[str] | None = None
) -> DataFrame:
    """The landed financials extract, for all tickers or the named ones."""
    df = load_or_empty(spark, path, schemas.FINANCIALS)
    return df if tickers is None else df.where(F.col("ticker").isin(list(tickers)))


def nulls_only(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_nan(F.col(c)) for c in floats})


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the narrowest type that holds every value.

    One pass collects the ranges: integers go to byte, short or int; doubles to float where
    each value survives the round trip to within 1e-5 of itself.
    """
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not ints and not doubles:
        return df
    probes = []
    for c in ints:
        probes += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    for c in doubles:
        back = F.col(c).cast("float").cast("double")
        close = F.abs(back - F.col(c)) <= F.abs(F.col(c)) * 1e-5 + 1e-8
        probes.append(F.bool_and(F.coalesce(close, F.col(c).isNull())).alias(f"ok_{c}"))
    seen = df.agg(*probes).first()
    casts = {}
    for c in ints:
        lo, hi = seen[f"lo_{c}"], seen[f"hi_{c}"]
        if lo is None:
            continue
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if -(1 << bits) <= lo and hi < (1 << bits):
                casts[c] = F.col(c).cast(kind)
                break
    for c in doubles:
        if seen[f"ok_{c}"]:
            casts[c] = F.col(c).cast("float")
    return df.withColumns(casts) if casts else df
