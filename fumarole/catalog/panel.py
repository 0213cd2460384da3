"""Company-year rows and their companions, made from the order tables.

A customer is a company, an order year a reporting year. Texts are spelled in several ways on
purpose, so that the cleaning steps have work to do; gaps come from years without booked
orders or without matching order lines.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab

#: Sector text per market segment: canonical, padded, upper case, lower case, unrecognised.
SECTOR_OF_SEGMENT = {
    "AUTOMOBILE": "Consumer Discretionary",
    "BUILDING": "  real estate ",
    "FURNITURE": "Furniture",
    "HOUSEHOLD": "CONSUMER STAPLES",
    "MACHINERY": "industrials",
}
#: Country text per nation key.
COUNTRY_OF_NATION = [
    "US", "usa", "Germany", "GBR", "FR", "Japan", "CHN", "in", "Brazil", "Canada", "AUS", "KR",
    "ZAF", "mex", "Norway", "SA", "ITA", "Spain", "NL", "che", "Sweden", "840", "Atlantis", " DE ", "ZZ",
]
#: Legal form per remainder of the nation key.
FORM_OF_NATION = ["Corp", "Inc.", "Group", "Ltd", "Holdings plc"]

#: Order priorities by their leading digit; the smallest number is aggregated, not the text.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and order year in the emissions schema.

    Lines are summed per order before they meet the orders, and orders per customer and year
    before they meet the customers, so that no join fans out and a busy order or customer is
    reduced in the map tasks. Sums are rounded to the digits of their terms, so that their
    order does not show.
    """
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("reporting_year"),
        "o_totalprice", "o_orderstatus", "o_orderpriority",
    )
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    lines = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(price).alias("market_cap"),
            F.sum(F.when(F.col("l_returnflag") != "R", quantity)).alias("employee_count"),
            F.sum(price * F.col("l_discount")).alias(vocab.SCOPE1),
            F.sum(price * F.col("l_tax")).alias(vocab.SCOPE2),
        )
    )
    booked = F.col("o_orderstatus") != "P"
    years = (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        .groupBy("o_custkey", "reporting_year")
        .agg(
            F.min(F.when(booked, F.substring("o_orderpriority", 1, 1).cast("int"))).alias("priority"),
            F.round(F.sum(F.when(booked, F.col("o_totalprice"))), 2).alias("revenue"),
            F.round(F.sum("market_cap"), 2).alias("market_cap"),
            F.sum("employee_count").alias("employee_count"),
            *[F.round(F.sum(t), 4).alias(t) for t in vocab.TARGETS],
        )
    )
    customers = read(spark, sf_dir, "customer")
    segments = F.create_map(*[F.lit(x) for pair in SECTOR_OF_SEGMENT.items() for x in pair])
    return years.join(customers, years["o_custkey"] == customers["c_custkey"]).select(
        F.concat_ws(" ", "c_name", _pick(FORM_OF_NATION, F.col("c_nationkey") % len(FORM_OF_NATION)))
        .alias("company_name"),
        F.col("c_custkey").cast("string").alias("ticker"),
        "reporting_year",
        F.try_element_at(segments, F.col("c_mktsegment")).alias("sector"),
        _pick(PRIORITIES, F.col("priority") - 1).alias("industry"),
        _pick(COUNTRY_OF_NATION, F.col("c_nationkey")).alias("country"),
        "revenue",
        F.col("c_acctbal").alias("total_assets"),
        "market_cap",
        "employee_count",
        "scope1_emissions",
        "scope2_emissions",
    )


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A financials extract: lifetime figures per customer that ordered, without the years."""
    orders = read(spark, sf_dir, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        F.max("o_orderpriority").alias("industry"),
        F.count(F.lit(1)).cast("double").alias("employee_count"),
        F.max("o_orderdate").alias("last_order"),
    )
    return per_customer.select(
        F.col("o_custkey").cast("string").alias("ticker"), "revenue", "industry", "employee_count",
        F.year("last_order").alias("last_order_year"),
    )


def nation_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country indicators by country text, from the suppliers of each nation."""
    return (
        read(spark, sf_dir, "supplier")
        .groupBy("s_nationkey")
        .agg(
            F.round(F.sum("s_acctbal"), 2).alias("gdp_per_capita"),
            F.count(F.lit(1)).cast("double").alias("energy_intensity"),
        )
        .select(
            _pick(COUNTRY_OF_NATION, F.col("s_nationkey")).alias("country"),
            "gdp_per_capita", "energy_intensity",
        )
    )


def user_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long indicator rows: a user is a country, an event type an indicator."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("country"), F.col("event_type").alias("indicator"), "ts", "value"
    )


def degraded(rows: DataFrame) -> DataFrame:
    """Each row twice: as it is, and with gaps where its figures are high."""
    gaps = rows.withColumns(
        {
            "industry": F.lit(None).cast("string"),
            "revenue": F.when(F.col("revenue") < 200_000, F.col("revenue")),
            "market_cap": F.when(F.col("market_cap") < 100_000, F.col("market_cap")),
            "total_assets": F.lit(0.0),
        }
    )
    return rows.unionByName(gaps)
