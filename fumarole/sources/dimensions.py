"""Small fixed dimension tables, as local relations hinted for broadcast."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.functions.text import strip
from fumarole.session import small_table


def local_table(spark: SparkSession, rows: Iterable[tuple], columns: list[str]) -> DataFrame:
    """A literal table with known size, hinted for broadcast."""
    data = pa.Table.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=columns)
    return F.broadcast(spark.createDataFrame(data))


def sector_profile(spark: SparkSession) -> DataFrame:
    rows = [(sector, *fields.values()) for sector, fields in vocab.SECTOR_PROFILE.items()]
    names = next(iter(vocab.SECTOR_PROFILE.values()))
    return local_table(spark, rows, ["sector", *names])


def sector_industry(spark: SparkSession) -> DataFrame:
    """One row per sector and industry, numbered within the sector."""
    rows = [(s, i, name) for s in vocab.SECTORS for i, name in enumerate(vocab.INDUSTRIES[s])]
    return local_table(spark, rows, ["sector", "industry_no", "industry"])


def sector_names(spark: SparkSession) -> DataFrame:
    """Lower-case sector text to its canonical spelling."""
    return local_table(spark, [(s.lower(), s) for s in vocab.SECTORS], ["sector_text", "canonical"])


def country_macro(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, vocab.COUNTRIES, ["country", "gdp_per_capita", "energy_intensity"]
    )


def country_aliases(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Lower-case country text to alpha-3 code, one row per text.

    Alpha-2 codes and English names of all countries come from the Java locale data; formal
    names and numeric codes are given for the countries of the macro table. ``extra`` adds
    rows (alias, code), for instance a landed ISO 3166 extract with all numeric codes and
    official names, and wins over the built-in ones; of several codes for one text, after
    trimming and lower-casing, the smallest counts. Its size is checked before any broadcast.
    """
    base = local_table(spark, _locale_aliases(), ["alias", "code"])
    if extra is None:
        return base
    own = extra.select(strip(F.lower("alias")).alias("alias"), F.upper("code").alias("code"))
    own = own.where("alias is not null and code is not null")
    own = small_table(own.groupBy("alias").agg(F.min("code").alias("code")))
    return small_table(base.join(own, "alias", "left_anti").unionByName(own))


@cache
def _locale_aliases() -> tuple[tuple[str, str], ...]:
    locale = SparkSession.active()._jvm.java.util.Locale
    found: dict[str, str] = {}
    for alpha2 in locale.getISOCountries():
        place = locale("", alpha2)
        code = place.getISO3Country()
        found[alpha2.lower()] = code
        found.setdefault(place.getDisplayCountry(locale.ENGLISH).lower(), code)
    for number, name, code in vocab.COUNTRY_FORMAL:
        found[number] = code
        found[name.lower()] = code
    return tuple(sorted(found.items()))
