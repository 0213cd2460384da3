"""SQL building blocks of the checks: the panel, the clean table, the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from fumarole import vocab
from fumarole.catalog.panel import COUNTRY_OF_NATION, FORM_OF_NATION, SECTOR_OF_SEGMENT

COLUMNS = [
    "company_name", "ticker", "reporting_year", "sector", "industry", "country", "revenue",
    "total_assets", "market_cap", "employee_count", "scope1_emissions", "scope2_emissions",
]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values: Sequence[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def literal(value: str | int | float) -> str:
    """A literal; the exponent makes it a double rather than a decimal."""
    if isinstance(value, str):
        return text(value)
    return f"{value!r}e0" if isinstance(value, float) else repr(value)


def values(rows: Sequence[tuple]) -> str:
    """A VALUES list."""
    return "VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


_SECTOR = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in SECTOR_OF_SEGMENT.items())

PANEL = f"""
per_order AS (
  SELECT l_orderkey, sum(l_extendedprice) AS cap,
         sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS emp,
         sum(l_extendedprice * l_discount) AS s1, sum(l_extendedprice * l_tax) AS s2
  FROM lineitem GROUP BY l_orderkey),
per_year AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS reporting_year,
         min(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) AS industry,
         round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS revenue,
         round(sum(cap), 2) AS market_cap, sum(emp) AS employee_count,
         round(sum(s1), 4) AS scope1_emissions, round(sum(s2), 4) AS scope2_emissions
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey GROUP BY ALL),
panel AS MATERIALIZED (
  SELECT concat_ws(' ', c_name, {texts(FORM_OF_NATION)}[c_nationkey % {len(FORM_OF_NATION)} + 1]) AS company_name,
         CAST(c_custkey AS VARCHAR) AS ticker, reporting_year,
         CASE c_mktsegment {_SECTOR} END AS sector, industry,
         {texts(COUNTRY_OF_NATION)}[c_nationkey + 1] AS country,
         revenue, c_acctbal AS total_assets, market_cap, employee_count,
         scope1_emissions, scope2_emissions
  FROM per_year JOIN customer ON o_custkey = c_custkey)"""


def on_panel(body: str, *more: str) -> str:
    """A query over the panel, after any further named subqueries."""
    return "WITH " + ",".join([PANEL, *(f"\n{m.strip()}" for m in more)]) + "\n" + body.strip()


# the country texts of the panel that are not plain three-letter codes
ALIASES = [
    ("us", "USA"), ("germany", "DEU"), ("fr", "FRA"), ("japan", "JPN"), ("in", "IND"),
    ("brazil", "BRA"), ("canada", "CAN"), ("kr", "KOR"), ("norway", "NOR"), ("sa", "SAU"),
    ("spain", "ESP"), ("nl", "NLD"), ("sweden", "SWE"), ("840", "USA"), ("de", "DEU"),
]
ALIAS_TABLE = f"alias_of(alias, code) AS ({values(ALIASES)})"
COUNTRY_CODE = (
    "CASE WHEN regexp_full_match(trim(country), '[A-Za-z]{3}') THEN upper(trim(country)) "
    "ELSE coalesce((SELECT code FROM alias_of WHERE alias = lower(trim(country))), "
    "substr(upper(trim(country)), 1, 3)) END"
)

SECTOR_TABLE = f"sector_of(low, canonical) AS ({values([(s.lower(), s) for s in vocab.SECTORS])})"

SUFFIX = (
    r"\b(inc\.?|ltd\.?|corp\.?|plc\.?|co\.?|llc|sa|ag|nv|se|"
    r"group|holdings|international|global|solutions|systems|"
    r"partners|industries)\b"
)
NAME_KEY = (
    f"regexp_replace(trim(regexp_replace(lower(company_name), '{SUFFIX}', '', 'g')), '\\s+', ' ', 'g')"
)

SECTOR_MODE = """sector_mode AS (
  SELECT canonical AS sector FROM panel JOIN sector_of ON low = lower(trim(sector))
  GROUP BY canonical ORDER BY count(*) DESC, canonical LIMIT 1)"""

FIXED_SECTOR = (
    "CASE WHEN sector IS NULL THEN NULL ELSE coalesce((SELECT canonical FROM sector_of "
    "WHERE low = lower(trim(panel.sector))), (SELECT sector FROM sector_mode)) END"
)

_FLAGS = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in vocab.FLAGGED)
_MEDIANS = ", ".join(f"median({c}) AS {c}" for c in vocab.FLAGGED)
_FILL = ", ".join(f"coalesce(f.{c}, m.{c}) AS {c}" for c in vocab.FLAGGED)
_MODES = ", ".join(
    f"coalesce(f.{c}, (SELECT {c} FROM flagged WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1), 'Unknown') AS {c}"
    for c in vocab.CATEGORICAL
)
_BOUNDS = ", ".join(
    f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in vocab.FLAGGED
)
_CLIP = ", ".join(f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" for c in vocab.FLAGGED)
_LOGS = ", ".join(
    f"ln(1 + greatest({raw}, 0)) AS {log}"
    for raw, log in [*vocab.LOG_OF.items(), *[(t, f"log_{t}") for t in vocab.TARGETS]]
)

# the panel has one row per name and year, so deduplication leaves it as it is
CLEAN = [
    ALIAS_TABLE,
    SECTOR_TABLE,
    SECTOR_MODE,
    f"""flagged AS MATERIALIZED (
  SELECT {NAME_KEY} AS company_name, company_name AS company_name_raw, ticker, reporting_year,
         {FIXED_SECTOR} AS sector, industry, {COUNTRY_CODE} AS country,
         {', '.join(vocab.FLAGGED)}, {_FLAGS}
  FROM panel)""",
    f"medians AS (SELECT {_MEDIANS} FROM flagged)",
    f"""filled AS MATERIALIZED (
  SELECT company_name, company_name_raw, ticker, reporting_year, {_MODES}, {_FILL},
         {', '.join(vocab.FLAGS)}
  FROM flagged f, medians m)""",
    f"bounds AS (SELECT {_BOUNDS} FROM filled)",
    f"""clipped AS (
  SELECT company_name, company_name_raw, ticker, reporting_year, sector, industry, country,
         {_CLIP}, {', '.join(vocab.FLAGS)}
  FROM filled, bounds)""",
    f"clean AS MATERIALIZED (SELECT *, {_LOGS} FROM clipped)",
]

_RATIOS = ", ".join(
    f"CASE WHEN {bottom} = 0 OR {top} IS NULL OR {bottom} IS NULL THEN 0.0 ELSE {top} / {bottom} END AS {name}"
    for name, (top, bottom) in vocab.RATIO_OF.items()
)
RATIOS = _RATIOS
_CODES = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_encoded" for c in vocab.CATEGORICAL
)
_MEANS = ", ".join(
    f"avg(log_{t}) OVER (PARTITION BY {g}) AS {g}_mean_log_{t.removesuffix('_emissions')}"
    for g in ("sector", "country")
    for t in vocab.TARGETS
)
FEATURES = [*CLEAN, f"features AS (SELECT *, {_RATIOS}, {_CODES}, {_MEANS} FROM clean)"]


def rounded(columns: Sequence[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
