"""Name, sector and country standardisation, flags, imputation, clipping and logs.

Fitting functions run small aggregations and return plain values; the others only add
expressions to the plan. A column that is absent is skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.functions.maths import clip, safe_divide, safe_log1p
from fumarole.functions.text import company_key, country_code, strip
from fumarole.operators.quantiles import medians, modes, quantile_values
from fumarole.sources.dimensions import country_aliases, sector_names


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def normalise_names(df: DataFrame) -> DataFrame:
    """Replace company_name by its key and keep the text as company_name_raw."""
    if "company_name" not in df.columns:
        return df
    return df.withColumns(
        {"company_name_raw": F.col("company_name"), "company_name": company_key(F.col("company_name"))}
    )


def changed_names(df: DataFrame) -> DataFrame:
    """How many names differ from their lower-case original."""
    differs = ~F.col("company_name").eqNullSafe(F.lower("company_name_raw"))
    return df.agg(F.count_if(differs).alias("n_changed"))


def canonical_sectors(df: DataFrame) -> DataFrame:
    """Sector in its canonical spelling; a text outside the list stays, trimmed."""
    text = strip(F.col("sector"))
    named = df.withColumns({"sector": text, "sector_text": F.lower(text)})
    found = named.join(sector_names(df.sparkSession), "sector_text", "left")
    return found.withColumn("sector", F.coalesce("canonical", "sector")).select(
        *df.columns, F.col("canonical").isNotNull().alias("_known")
    )


def category_modes(
    df: DataFrame, columns: Sequence[str] = vocab.CATEGORICAL
) -> dict[str, str | None]:
    """Mode per text column in one pass; of the sectors only the recognised ones count.

    Filling unrecognised and missing sectors with their mode leaves the mode as it is, so the
    same value serves both.
    """
    names = present(df, columns)
    if "sector" in names:
        known = F.when(F.col("_known"), F.col("sector")).alias("sector")
        df = canonical_sectors(df).select(known, *[c for c in names if c != "sector"])
    return modes(df, names) if names else {}


def sector_mode(df: DataFrame) -> str | None:
    """Most frequent recognised sector."""
    return category_modes(df, ["sector"])["sector"]


def validate_sectors(df: DataFrame, mode: str | None = None) -> DataFrame:
    """Canonical sectors; an unrecognised text becomes the most frequent recognised one."""
    if "sector" not in df.columns:
        return df
    mode = sector_mode(df) if mode is None else mode
    unknown = ~F.col("_known") & F.col("sector").isNotNull()
    fixed = F.when(unknown, F.lit(mode)).otherwise(F.col("sector"))
    return canonical_sectors(df).withColumn("sector", fixed).drop("_known")


def normalise_countries(
    df: DataFrame, aliases: DataFrame | None = None, column: str = "country"
) -> DataFrame:
    """Alpha-3 country codes from codes, numbers or names."""
    if column not in df.columns:
        return df
    table = country_aliases(df.sparkSession, aliases)
    text = strip(F.col(column))
    keyed = df.withColumns({column: text, "alias": F.lower(text)})
    found = keyed.join(table, "alias", "left")
    return found.withColumn(column, country_code(F.col(column), F.col("code"))).select(*df.columns)


def add_flags(df: DataFrame) -> DataFrame:
    """0/1 flags for missing financials and targets."""
    return df.withColumns(
        {f"{c}_missing": F.col(c).isNull().cast("int") for c in present(df, vocab.FLAGGED)}
    )


def flag_totals(df: DataFrame) -> DataFrame:
    flags = [c for c in df.columns if c.endswith("_missing")]
    return df.agg(*[F.sum(c).alias(c) for c in flags])


def fit_fill(
    df: DataFrame,
    numeric: Sequence[str] = vocab.FLAGGED,
    categorical: Sequence[str] = vocab.CATEGORICAL,
    approx: bool = False,
) -> dict[str, float | str | None]:
    """Median per numeric and mode per text column ("Unknown" if all are null)."""
    fill: dict[str, float | str | None] = {}
    if number_columns := present(df, numeric):
        fill.update(medians(df, number_columns, approx))
    if text_columns := present(df, categorical):
        fill.update({c: v if v is not None else "Unknown" for c, v in modes(df, text_columns).items()})
    return fill


def apply_fill(df: DataFrame, fill: Mapping[str, float | str | None]) -> DataFrame:
    known = {c: v for c, v in fill.items() if v is not None and c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()})


def fit_bounds(
    df: DataFrame,
    columns: Sequence[str] = vocab.FLAGGED,
    lower: float = 0.01,
    upper: float = 0.99,
    approx: bool = False,
) -> dict[str, list[float | None]]:
    """Lower and upper clipping quantile per column."""
    names = present(df, columns)
    return quantile_values(df, names, [lower, upper], approx) if names else {}


def apply_bounds(df: DataFrame, bounds: Mapping[str, Sequence[float | None]]) -> DataFrame:
    return df.withColumns(
        {c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items() if lo is not None}
    )


def add_logs(df: DataFrame, targets: bool = True, overwrite: bool = True) -> DataFrame:
    """log1p columns of the financials (and targets); existing ones stay if not ``overwrite``."""
    wanted = dict(vocab.LOG_OF)
    if targets:
        wanted.update({t: f"log_{t}" for t in vocab.TARGETS})
    return df.withColumns(
        {
            log: safe_log1p(F.col(raw))
            for raw, log in wanted.items()
            if raw in df.columns and (overwrite or log not in df.columns)
        }
    )


def add_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: safe_divide(F.col(top), F.col(bottom)) for name, (top, bottom) in vocab.RATIO_OF.items()}
    )


class Cleaning(NamedTuple):
    """What cleaning learned from its rows: the sector mode, fill values and clipping bounds."""

    sector: str | None
    fill: dict[str, float | str | None]
    bounds: dict[str, list[float | None]]


def fit_cleaning(rows: DataFrame, impute_targets: bool = True, approx: bool = False) -> Cleaning:
    """Fitted on deduplicated rows; medians come before the bounds, which see imputed values."""
    top = category_modes(rows)
    flagged = add_flags(validate_sectors(rows, top.get("sector")))
    fill = fit_fill(flagged, categorical=[], approx=approx)
    if not impute_targets:
        fill = {c: v for c, v in fill.items() if c not in vocab.TARGETS}
    fill.update({c: "Unknown" if v is None else v for c, v in top.items()})
    return Cleaning(top.get("sector"), fill, fit_bounds(apply_fill(flagged, fill), approx=approx))


def apply_cleaning(rows: DataFrame, fitted: Cleaning) -> DataFrame:
    """Sectors, flags, fill values, clipping and logs, for the fitted rows or later ones."""
    flagged = add_flags(validate_sectors(rows, fitted.sector))
    present_bounds = {c: b for c, b in fitted.bounds.items() if c in rows.columns}
    return add_logs(apply_bounds(apply_fill(flagged, fitted.fill), present_bounds))
