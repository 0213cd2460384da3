"""Clean rows to the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from fumarole import vocab
from fumarole.operators.cleaning import add_logs, add_ratios
from fumarole.operators.encode import GroupMean, GroupMeanModel, OrdinalCodeModel, fit_codes


class Encoders(NamedTuple):
    codes: list[OrdinalCodeModel]
    means: list[GroupMeanModel]


def fit_encoders(
    df: DataFrame,
    categories: Sequence[str] = vocab.CATEGORICAL,
    groups: Sequence[str] = ("sector", "country"),
) -> Encoders:
    return Encoders(
        fit_codes(df, [c for c in categories if c in df.columns]),
        [GroupMean(groupCol=g).fit(df) for g in groups if g in df.columns],
    )


def features(
    clean: DataFrame, fit_group_means: bool = True, encoders: Encoders | None = None
) -> DataFrame:
    """Logs, ratios, codes and (optionally) group means.

    With ``encoders`` the fitted ones are applied, for instance to rows that come later.
    ``fit_group_means=False`` leaves the means to the training pipeline, which fits them on
    the training rows of each fold.
    """
    df = add_ratios(add_logs(clean, targets=False, overwrite=False))
    if encoders is None:
        encoders = fit_encoders(df, groups=("sector", "country") if fit_group_means else ())
    for model in encoders.codes:
        df = model.transform(df)
    if fit_group_means:
        for model in encoders.means:
            df = model.transform(df)
    return df
