"""Profiling tables: distributions, correlations, group medians, gaps, mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumarole import vocab
from fumarole.functions.maths import safe_log1p
from fumarole.operators.quantiles import bin_of, quantile_table, quantile_values
from fumarole.operators.split import hash_sample
from fumarole.sources.dimensions import local_table


def numeric_columns(df: DataFrame, flags: bool = False) -> list[str]:
    """Numeric columns in table order, without the missingness flags unless asked for."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in names if flags or not c.endswith("_missing")]


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least two different values, so neither empty nor constant."""
    seen = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c]]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, one row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(cells).alias("s")).select("s.column", "s.value").distinct()
    return values.groupBy("column").agg(F.count("value").alias("n_distinct"))


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


# --- distributions -----------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value, empty ones too.

    A constant column gets bins of total width one around its value.
    """
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    value = F.col(column).cast("double")
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    number = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    # a bin's number in each of its rows and once more, so that no bin is missing
    counts = (
        df.where(F.col(column).isNotNull())
        .select(number.cast("int").alias("bin"), F.lit(1).alias("one"))
        .unionByName(
            df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("one"))
        )
        .groupBy("bin")
        .agg(F.sum("one").alias("n"))
    )
    return counts.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        "n",
    )


def describe(df: DataFrame, columns: Sequence[str], digits: int = 3, approx: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per column."""
    quartiles = quantile_values(df, columns, [0.25, 0.5, 0.75], approx)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.round(F.avg(c), digits).alias("mean"),
            F.round(F.when(F.count(c) > 1, F.stddev_samp(c)), digits).alias("std"),
            F.round(F.min(c).cast("double"), digits).alias("min"),
            *[
                F.round(F.lit(q).cast("double"), digits).alias(name)
                for q, name in zip(quartiles[c], ("q25", "q50", "q75"))
            ],
            F.round(F.max(c).cast("double"), digits).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def adjusted_skewness(c: Column) -> Column:
    """Sample skewness with the small-sample correction; null under three values."""
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.when(F.var_pop(c) > 0, F.skewness(c) * factor).otherwise(F.lit(0.0)))


def skew_before_after(df: DataFrame, logs: dict[str, str] | None = None) -> DataFrame:
    """Skewness of each raw column and of its log column."""
    logs = vocab.LOG_OF if logs is None else logs
    cells = [
        F.struct(
            F.lit(raw).alias("column"),
            adjusted_skewness(F.col(raw)).alias("raw_skew"),
            adjusted_skewness(F.col(log)).alias("log_skew"),
        )
        for raw, log in logs.items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


# --- relations ---------------------------------------------------------------------------


def correlations(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present.

    One pass; only the upper triangle is aggregated, as partial moments in each task. A row gives
    one cell a pair, so the aggregate stays small however many columns there are. A constant column
    has no correlation, with itself included.
    """
    upper = [*combinations(columns, 2), *[(c, c) for c in columns]]
    cells = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
        for i, (x, y) in enumerate(upper)
    ])
    moments = F.try_divide(F.regr_sxy("a", "b"), F.sqrt(F.regr_sxx("a", "b")) * F.sqrt(F.regr_syy("a", "b")))
    sums = df.select(F.inline(cells)).groupBy("pair").agg(
        moments.alias("moments"), F.when(F.min("a") < F.max("a"), F.lit(1.0)).alias("own")
    )
    names = local_table(df.sparkSession, [(i, x, y) for i, (x, y) in enumerate(upper)], ["pair", "x", "y"])
    half = names.join(F.broadcast(sums), "pair", "left")
    half = half.select("x", "y", F.when(F.col("x") == F.col("y"), F.col("own")).otherwise(F.col("moments")).alias("r"))
    both = F.when(
        F.col("x") == F.col("y"), F.array(F.struct("x", "y"))
    ).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    full = half.select(F.explode(both).alias("s"), "r").select("s.x", "s.y", "r")
    return full if digits is None else full.withColumn("r", F.round("r", digits))


def group_medians(
    df: DataFrame, group: str = "sector", columns: Sequence[str] = vocab.TARGETS, approx: bool = False
) -> DataFrame:
    """Median per group, ordered by the first column."""
    kept = df.where(F.col(group).isNotNull())
    table = quantile_table(kept, columns, [0.5], by=[group], approx=approx)
    return table.select(group, *[F.get(c, 0).alias(c) for c in columns]).orderBy(columns[0], group)


def box_stats(
    df: DataFrame, column: str, group: str = "sector", log: bool = True, approx: bool = False
) -> DataFrame:
    """Quartiles, whiskers at 1.5 times the quartile distance, extremes and outlier count."""
    value = F.log1p(F.col(column)) if log else F.col(column)
    kept = df.where(F.col(group).isNotNull() & F.col(column).isNotNull()).select(
        group, value.cast("double").alias("v")
    )
    quartiles = quantile_table(kept, ["v"], [0.25, 0.5, 0.75], by=[group], approx=approx).select(
        group, *[F.get("v", i).alias(name) for i, name in enumerate(("q1", "med", "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        kept.join(quartiles, group)
        .groupBy(group)
        .agg(
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
            *[F.first(c).alias(c) for c in ("q1", "med", "q3")],
            F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
            F.max("v").alias("hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    keys: Sequence[str] = vocab.KEYS,
    rows: int | None = None,
    seed: int = vocab.SEED,
) -> DataFrame:
    """Points with a place on two log axes, all of them or a fixed-size sample."""
    shown = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, "sector", x, y)
    return shown if rows is None else hash_sample(shown, rows, keys, seed)


def pair_sample(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = vocab.KEYS,
    rows: int = vocab.PAIR_ROWS,
    seed: int = vocab.SEED,
) -> DataFrame:
    """A fixed-size sample of rows that hold every plotted column."""
    columns = list(columns or [*vocab.LOG_OF.values(), vocab.SCOPE1])
    columns = [c for c in columns if c in df.columns]
    complete = df.na.drop(subset=columns)
    return hash_sample(complete, rows, keys, seed).select(*keys, *columns)


# --- gaps --------------------------------------------------------------------------------


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and percentage of each column that has any, most first."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
            F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, F.count(F.lit(1))).alias("pct_missing"),
        )
        for c in df.columns
    ]
    table = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return table.where("n_missing > 0").orderBy(F.desc("n_missing"), "column")


# --- mutual information ------------------------------------------------------------------


def mutual_information(
    df: DataFrame,
    columns: Sequence[str],
    target: str = vocab.SCOPE1,
    bins: int = 10,
    min_rows: int = vocab.MI_MIN_ROWS,
    approx: bool = False,
) -> DataFrame:
    """Binned mutual information (nats) of each column with the target, highest first.

    Every column is cut at its quantiles. Rows are counted per (column, bin, target bin), so
    at most ``bins`` squared counts per column leave a task. Fewer than ``min_rows`` complete
    rows give an empty table.
    """
    names = varying_columns(df, columns)
    complete = df.select(*names, target).na.drop()
    edges = {
        c: sorted(set(values))
        for c, values in quantile_values(
            complete, [*names, target], [i / bins for i in range(bins + 1)], approx
        ).items()
        if None not in values
    }
    if target not in edges:
        return df.sparkSession.createDataFrame([], "column string, mi double")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), bin_of(F.col(c), edges[c]).alias("bx")) for c in names]
    )
    joint = (
        complete.select(F.explode(pairs).alias("s"), bin_of(F.col(target), edges[target]).alias("by"))
        .groupBy("s.column", "s.bx", "by")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # joint holds at most columns x bins x bins rows
    cells = joint.groupBy("column").agg(F.collect_list(F.struct("bx", "by", "n")).alias("cells"))

    def marginal(axis: str, cell: Column) -> Column:
        same = F.filter("cells", lambda other: other[axis] == cell[axis])
        return F.aggregate(same, F.lit(0).cast("bigint"), lambda total, other: total + other["n"])

    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda t, cell: t + cell["n"])
    terms = F.transform(
        "cells",
        lambda cell: cell["n"]
        * (
            F.ln(cell["n"].cast("double"))
            + F.ln(F.col("total").cast("double"))
            - F.ln(marginal("bx", cell).cast("double"))
            - F.ln(marginal("by", cell).cast("double"))
        ),
    )
    scored = (
        cells.withColumn("total", total)
        .where(F.col("total") >= min_rows)
        .select(
            "column",
            (F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / F.col("total")).alias("mi"),
        )
    )
    return scored.orderBy(F.desc("mi"), "column")
