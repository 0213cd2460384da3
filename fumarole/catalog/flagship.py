"""The flagship query: from order tables to emissions by sector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.catalog.panel import panel
from fumarole.functions import safe_divide
from fumarole.operators.profiling import group_medians
from fumarole.plans.clean import clean
from fumarole.operators.cleaning import add_ratios
from fumarole.session import materialise


def sector_medians_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median emissions and emissions per revenue by sector, after the whole cleaning job."""
    table = add_ratios(clean(panel(spark, sf_dir)))
    intensity = {
        f"{t.removesuffix('_emissions')}_per_revenue": safe_divide(F.col(t), F.col("revenue"))
        for t in vocab.TARGETS
    }
    rows = table.withColumns(intensity).select("sector", *vocab.TARGETS, *intensity)
    medians = group_medians(materialise(rows, "intensity"), columns=[*vocab.TARGETS, *intensity])
    return medians.select("sector", *[F.round(c, 6).alias(c) for c in medians.columns[1:]])
