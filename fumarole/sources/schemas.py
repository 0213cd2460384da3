"""Explicit schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

from fumarole import vocab


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

EMISSIONS = _struct(
    company_name=_S, ticker=_S, reporting_year=_I, sector=_S, industry=_S, country=_S,
    revenue=_D, total_assets=_D, market_cap=_D, employee_count=_D,
    scope1_emissions=_D, scope2_emissions=_D,
)

FINANCIALS = _struct(
    ticker=_S, revenue=_D, total_assets=_D, market_cap=_D, employee_count=_D,
    sector=_S, industry=_S, country=_S,
)

INDICATORS = _struct(country=_S, gdp_per_capita=_D, energy_intensity=_D)

INDICATORS_LONG = _struct(country=_S, indicator=_S, year=_I, value=_D)

MERGED = T.StructType(EMISSIONS.fields + INDICATORS.fields[1:])

CLEAN = T.StructType(
    MERGED.fields
    + [T.StructField("company_name_raw", _S)]
    + [T.StructField(c, _I) for c in vocab.FLAGS]
    + [T.StructField(c, _D) for c in vocab.LOG_OF.values()]
    + [T.StructField(f"log_{t}", _D) for t in vocab.TARGETS]
)

FEATURES = T.StructType(
    CLEAN.fields
    + [T.StructField(c, _D) for c in vocab.RATIO_OF]
    + [T.StructField(c, _I) for c in vocab.CODES]
    + [T.StructField(c, _D) for c in vocab.GROUP_MEANS]
)


def held_out(target: str) -> T.StructType:
    """Features, flags, the log target and the sector of a held-out snapshot."""
    kinds = {f.name: f.dataType for f in FEATURES.fields}
    names = vocab.FEATURES + vocab.FLAGS + [f"log_{target}", "sector"]
    return T.StructType([T.StructField(n, kinds[n]) for n in names])
