"""The exploration tables of a clean table."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame

from fumarole import vocab
from fumarole.operators.profiling import (
    box_stats,
    correlations,
    group_medians,
    histogram,
    missing_profile,
    mutual_information,
    numeric_columns,
    pair_sample,
    scatter_points,
)
from fumarole.sources.files import write_table


def explore(clean: DataFrame, sample: int | None = None) -> dict[str, DataFrame]:
    """One table per exploration view; ``sample`` bounds the scatter points."""
    logs = [f"log_{t}" for t in vocab.TARGETS]
    shown = numeric_columns(clean)
    predictive = [c for c in numeric_columns(clean, flags=True) if c not in [*vocab.TARGETS, *logs]]
    tables = {f"distribution_{t}": histogram(clean, log, 50) for t, log in zip(vocab.TARGETS, logs)}
    tables["correlations"] = correlations(clean, shown, digits=2)
    tables["sector_medians"] = group_medians(clean)
    tables["revenue_vs_scope1"] = scatter_points(clean, "revenue", vocab.SCOPE1, rows=sample)
    tables["assets_vs_scope2"] = scatter_points(clean, "total_assets", vocab.SCOPE2, rows=sample)
    tables.update({f"box_{t}": box_stats(clean, t) for t in vocab.TARGETS})
    tables["missing"] = missing_profile(clean)
    tables["mutual_information"] = mutual_information(clean, predictive)
    tables["pairs"] = pair_sample(clean)
    return tables


def write_exploration(clean: DataFrame, folder: str, sample: int | None = None) -> list[str]:
    tables = explore(clean, sample)
    for name, table in tables.items():
        write_table(table, posixpath.join(folder, name))
    return list(tables)
