"""Scoring whole company tables: feature rows, predictions, intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.functions.maths import back_transform, floor_at, round_even, share_of
from fumarole.operators.cleaning import (
    Cleaning,
    add_logs,
    add_ratios,
    apply_cleaning,
    normalise_countries,
)
from fumarole.operators.encode import GroupMeanModel, OrdinalCodeModel
from fumarole.sources.dimensions import country_macro, sector_profile

#: A prediction on the log scale: an expression, or a function that adds a column to a table.
Predictor = Column | Callable[[DataFrame, str], DataFrame]


def default_macro(df: DataFrame) -> DataFrame:
    """Fill the country indicators from the macro table, or with the defaults."""
    macro = country_macro(df.sparkSession).select(
        "country", F.col("gdp_per_capita").alias("_gdp"), F.col("energy_intensity").alias("_energy")
    )
    found = df.join(macro, "country", "left")
    gdp, energy = F.coalesce("_gdp", F.lit(vocab.DEFAULT_GDP)), F.coalesce("_energy", F.lit(vocab.DEFAULT_ENERGY))
    if "gdp_per_capita" in df.columns:
        gdp = F.coalesce("gdp_per_capita", gdp)
    if "energy_intensity" in df.columns:
        energy = F.coalesce("energy_intensity", energy)
    return found.withColumns({"gdp_per_capita": gdp, "energy_intensity": energy}).drop("_gdp", "_energy")


def prior_means(df: DataFrame) -> DataFrame:
    """Sector means from the emission factors, country means from the defaults."""
    factors = sector_profile(df.sparkSession).select(
        "sector", F.col("s1_factor").alias("_scope1"), F.col("s2_factor").alias("_scope2")
    )
    found = df.join(factors, "sector", "left")
    columns = {}
    for scope, fallback in vocab.DEFAULT_COUNTRY_MEAN.items():
        factor = F.coalesce(f"_{scope}", F.lit(vocab.DEFAULT_FACTOR))
        columns[f"sector_mean_log_{scope}"] = F.log1p(factor * 50)
        columns[f"country_mean_log_{scope}"] = F.lit(fallback)
    return found.withColumns(columns).drop("_scope1", "_scope2")


def score_features(
    companies: DataFrame,
    means: Sequence[GroupMeanModel] = (),
    codes: Sequence[OrdinalCodeModel] = (),
    cleaning: Cleaning | None = None,
) -> DataFrame:
    """Model features of raw company rows.

    With ``cleaning``, as fitted on the training rows, the rows take the training rows' steps:
    country codes, canonical sectors, flags, medians, bounds. Flags of the targets are 0, since
    these are to be estimated. Without it financials are floored at 1 and no flag is set. Group
    means and codes come from the fitted encoders; where none is given, means take the priors
    and codes are -1 (unseen).
    """
    if cleaning is None:
        floors = {c: F.coalesce(floor_at(F.col(c), 1.0), F.lit(1.0)) for c in vocab.NUMERIC}
        df = companies.withColumns({f"_{c}": F.col(c) for c in vocab.NUMERIC}).withColumns(floors)
        df = add_ratios(add_logs(df, targets=False)).withColumns({c: F.col(f"_{c}") for c in vocab.NUMERIC})
        df = df.drop(*[f"_{c}" for c in vocab.NUMERIC])
        df = df.withColumns({c: F.lit(0) for c in vocab.FLAGS})
    else:
        rows = normalise_countries(companies.drop(*vocab.TARGETS))
        df = add_ratios(apply_cleaning(rows, cleaning))
        df = df.withColumns({f"{t}_missing": F.lit(0) for t in vocab.TARGETS})
    df = prior_means(default_macro(df)).withColumns({c: F.lit(-1) for c in vocab.CODES})
    for model in [*means, *codes]:
        df = model.transform(df)
    return df


def with_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table with any named feature that it lacks, as 0."""
    return df.withColumns({c: F.lit(0.0) for c in names if c not in df.columns})


def aligned(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the named features in order, 0 where the table lacks one."""
    columns = [F.col(c) if c in df.columns else F.lit(0).alias(c) for c in names]
    return df.select(*keep, *columns)


def predict_targets(
    features: DataFrame, predictors: Mapping[str, Predictor]
) -> DataFrame:
    """Add scope1, scope2 on the original scale; a target without a predictor gets 0."""
    for target in vocab.TARGETS:
        scope = target.removesuffix("_emissions")
        predictor = predictors.get(target)
        if predictor is None:
            features = features.withColumn(scope, F.lit(0.0))
        elif isinstance(predictor, Column):
            features = features.withColumn(scope, back_transform(predictor))
        else:
            features = predictor(features, f"_log_{scope}").withColumn(
                scope, back_transform(F.col(f"_log_{scope}"))
            ).drop(f"_log_{scope}")
    return features


def confidence_of(r2: Mapping[str, float | None]) -> float:
    """Mean R2 of both targets within [0, 1]; an unknown one counts as the default."""
    known = [r2.get(t) for t in vocab.TARGETS]
    values = [vocab.DEFAULT_R2 if v is None else v for v in known]
    return min(max(sum(values) / len(values), 0.0), 1.0)


def interval(value: Column, spread: float) -> Column:
    return F.struct(
        round_even(F.greatest(value * (1 - spread), F.lit(0.0)), 2).alias("lo"),
        round_even(value * (1 + spread), 2).alias("hi"),
    )


def score(
    features: DataFrame,
    predictors: Mapping[str, Predictor],
    r2: Mapping[str, float | None],
    keep: Sequence[str] = vocab.KEYS,
    names: Sequence[str] = (*vocab.FEATURES, *vocab.FLAGS),
) -> DataFrame:
    """Scored records: emissions, their total, confidence, intervals and the feature map."""
    confidence = confidence_of(r2)
    spread = 1.0 - confidence + vocab.MIN_SPREAD
    predicted = predict_targets(features, predictors)
    one, two = F.col("scope1"), F.col("scope2")
    pairs = [cell for c in names for cell in (F.lit(c), F.col(c).cast("double"))]
    return predicted.select(
        *keep,
        round_even(one, 2).alias("scope1"),
        round_even(two, 2).alias("scope2"),
        round_even(one + two, 2).alias("total"),
        F.lit(round(confidence, 3)).alias("confidence_score"),
        interval(one, spread).alias("scope1_interval"),
        interval(two, spread).alias("scope2_interval"),
        F.create_map(*pairs).alias("feature_values"),
    )


def scope_shares(scored: DataFrame) -> DataFrame:
    """Percentage of each scope in the total."""
    return scored.withColumns(
        {f"{s}_share": share_of(F.col(s), F.col("scope1") + F.col("scope2")) for s in ("scope1", "scope2")}
    )
