"""Merged rows to the clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fumarole.operators.cleaning import (
    apply_cleaning,
    fit_cleaning,
    normalise_countries,
    normalise_names,
)
from fumarole.operators.dedup import most_complete
from fumarole.session import materialise


def clean(
    merged: DataFrame,
    second_dedup: bool = False,
    impute_targets: bool = True,
    approx: bool = False,
    stage: bool = True,
) -> DataFrame:
    """Deduplicate, standardise, flag, impute, clip, log.

    The deduplicated rows are written once as a stage table (``stage``); each fitting pass
    then reads only its columns. Medians come before clipping bounds, which see imputed
    values. ``second_dedup`` deduplicates again once names are normalised;
    ``impute_targets=False`` leaves missing targets missing.
    """
    rows = standard_rows(merged, second_dedup, stage)
    fitted = fit_cleaning(rows, impute_targets, approx)
    return apply_cleaning(rows, fitted)


def standard_rows(merged: DataFrame, second_dedup: bool = False, stage: bool = True) -> DataFrame:
    """One row a key with standard names and countries; what ``fit_cleaning`` is fitted on."""
    rows = most_complete(merged)
    rows = normalise_countries(normalise_names(rows))
    if second_dedup:
        rows = most_complete(rows)
    return materialise(rows, "deduplicated") if stage else rows
