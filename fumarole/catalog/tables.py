"""Queries: scans, sinks, cleaning, joins and encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.catalog import sql as S
from fumarole.catalog.panel import (
    COUNTRY_OF_NATION,
    degraded,
    financials,
    nation_indicators,
    panel as make_panel,
    read,
    user_indicators,
)
from fumarole.catalog.registry import query
from fumarole.functions import safe_log1p
from fumarole.functions.text import country_upper
from fumarole.operators import cleaning, encode, joins
from fumarole.operators.dedup import most_complete, non_null_count
from fumarole.operators.scoring import default_macro, prior_means
from fumarole.operators.split import row_fold
from fumarole.plans.clean import clean
from fumarole.operators.cleaning import add_ratios
from fumarole.plans.features import features
from fumarole.plans.ingest import ingest, merge_sources
from fumarole.session import materialise, stage_path
from fumarole.sources import files, indicators, schemas
from fumarole.sources.dimensions import sector_industry

KEYED = ["company_name", "reporting_year"]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def staged_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a stage table, for queries that pass over it several times."""
    return materialise(make_panel(spark, sf), "panel")


# --- scans and sinks ---------------------------------------------------------------------


@query(S.on_panel("SELECT * FROM panel"))
def panel(spark: SparkSession, sf: str) -> DataFrame:
    return make_panel(spark, sf)


@query(S.on_panel("SELECT * FROM panel"))
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "emissions-csv")
    files.write_csv(make_panel(spark, sf), path)
    return files.read_csv(spark, path, schemas.EMISSIONS)


@query(
    S.on_panel(
        """SELECT count(*) AS n_rows, min(reporting_year) AS first_year,
                  max(reporting_year) AS last_year FROM panel"""
    )
)
def emissions_summary(spark: SparkSession, sf: str) -> DataFrame:
    return files.emissions_summary(make_panel(spark, sf))


@query(
    S.on_panel(
        """SELECT CAST(o_custkey AS VARCHAR) AS ticker, round(sum(o_totalprice), 2) AS revenue,
                  max(o_orderpriority) AS industry, CAST(count(*) AS DOUBLE) AS employee_count
           FROM orders GROUP BY o_custkey"""
    )
)
def financials_extract(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "financials-csv")
    files.write_csv(financials(spark, sf).drop("last_order_year"), path)
    return files.load_financials(spark, path)


_EVENT_NAMES = {"click": "click_value", "purchase": "purchase_value"}
_PIVOT_SQL = """
SELECT user_id AS country,
       arg_max(value, ts) FILTER (WHERE event_type = 'click') AS click_value,
       arg_max(value, ts) FILTER (WHERE event_type = 'purchase') AS purchase_value
FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL GROUP BY user_id"""


@query(_PIVOT_SQL)
def indicator_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.latest_wide(user_indicators(spark, sf), _EVENT_NAMES, order="ts")


@query(
    """
WITH c AS (SELECT user_id, arg_max(value, ts) AS click_value FROM events
           WHERE event_type = 'click' GROUP BY user_id),
     p AS (SELECT user_id, arg_max(value, ts) AS purchase_value FROM events
           WHERE event_type = 'purchase' GROUP BY user_id)
SELECT coalesce(c.user_id, p.user_id) AS country, click_value, purchase_value
FROM c FULL JOIN p ON c.user_id = p.user_id"""
)
def indicator_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.outer_wide(user_indicators(spark, sf), _EVENT_NAMES, order="ts")


def _int_type(column: str) -> str:
    return (
        f"CASE WHEN (SELECT max({column}) FROM part) < 128 THEN 'tinyint' "
        f"WHEN (SELECT max({column}) FROM part) < 32768 THEN 'smallint' ELSE 'int' END"
    )


@query(
    f"""SELECT p_partkey, p_size, round(p_retailprice, 2) AS p_retailprice,
               {_int_type('p_partkey')} AS key_type, {_int_type('p_size')} AS size_type,
               'float' AS price_type FROM part"""
)
def narrow_types(spark: SparkSession, sf: str) -> DataFrame:
    df = files.narrow_types(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))
    return df.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        F.col("p_size").cast("int").alias("p_size"),
        F.round(F.col("p_retailprice").cast("double"), 2).alias("p_retailprice"),
        F.typeof("p_partkey").alias("key_type"),
        F.typeof("p_size").alias("size_type"),
        F.typeof("p_retailprice").alias("price_type"),
    )


# --- cleaning ----------------------------------------------------------------------------


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, company_name AS company_name_raw,
                   {S.NAME_KEY} AS company_name FROM panel"""
    )
)
def company_names(spark: SparkSession, sf: str) -> DataFrame:
    named = cleaning.normalise_names(make_panel(spark, sf))
    return named.select("ticker", "reporting_year", "company_name_raw", "company_name")


@query(
    S.on_panel(
        f"SELECT count(*) FILTER (WHERE {S.NAME_KEY} <> lower(company_name)) AS n_changed FROM panel"
    )
)
def changed_names(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.changed_names(cleaning.normalise_names(make_panel(spark, sf)))


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, {S.COUNTRY_CODE} AS country,
                   upper(trim(country)) AS country_upper FROM panel""",
        S.ALIAS_TABLE,
    )
)
def country_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = make_panel(spark, sf).withColumn("country_upper", country_upper(F.col("country")))
    coded = cleaning.normalise_countries(rows)
    return coded.select("ticker", "reporting_year", "country", "country_upper")


@query(
    S.on_panel(
        f"SELECT ticker, reporting_year, {S.FIXED_SECTOR} AS sector FROM panel",
        S.SECTOR_TABLE, S.SECTOR_MODE,
    )
)
def sector_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = make_panel(spark, sf)
    return cleaning.validate_sectors(rows).select("ticker", "reporting_year", "sector")


@query(
    S.on_panel(
        f"""SELECT s.sector, i.industry, count(*) AS n_companies
            FROM (SELECT DISTINCT ticker, {S.FIXED_SECTOR} AS sector FROM panel) s
            JOIN industry_of i ON i.sector = s.sector GROUP BY ALL""",
        S.SECTOR_TABLE,
        S.SECTOR_MODE,
        "industry_of(sector, industry) AS ("
        + S.values([(s, i) for s in vocab.SECTORS for i in vocab.INDUSTRIES[s]]) + ")",
    )
)
def sector_industries(spark: SparkSession, sf: str) -> DataFrame:
    """The industries each company may belong to, counted per sector and industry."""
    per_sector = (
        cleaning.validate_sectors(make_panel(spark, sf))
        .select("ticker", "sector").distinct()
        .groupBy("sector").agg(F.count(F.lit(1)).alias("n_companies"))
    )
    return per_sector.join(sector_industry(spark), "sector").select("sector", "industry", "n_companies")


_DEGRADED = """copies AS (
  SELECT * FROM panel UNION ALL
  SELECT company_name, ticker, reporting_year, sector, NULL, country,
         CASE WHEN revenue < 200000 THEN revenue END, 0.0,
         CASE WHEN market_cap < 100000 THEN market_cap END, employee_count,
         scope1_emissions, scope2_emissions FROM panel)"""
_FILLED_CELLS = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in S.COLUMNS)
_REST = ", ".join(f"{c} ASC NULLS LAST" for c in S.COLUMNS if c not in KEYED)


@query(
    S.on_panel(
        f"""SELECT * EXCLUDE (place, n_cells) FROM (
              SELECT *, row_number() OVER (PARTITION BY company_name, reporting_year
                                           ORDER BY n_cells DESC, {_REST}) AS place
              FROM (SELECT *, {_FILLED_CELLS} AS n_cells FROM copies)) WHERE place = 1""",
        _DEGRADED,
    )
)
def dedup_complete(spark: SparkSession, sf: str) -> DataFrame:
    return most_complete(degraded(make_panel(spark, sf)))


@query(S.on_panel(f"SELECT ticker, reporting_year, {_FILLED_CELLS} AS n_cells FROM panel"))
def row_completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = make_panel(spark, sf)
    return rows.select("ticker", "reporting_year", non_null_count(rows.columns).alias("n_cells"))


_FLAG_SQL = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in vocab.FLAGGED)


@query(S.on_panel(f"SELECT ticker, reporting_year, {_FLAG_SQL} FROM panel"))
def missing_flags(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.add_flags(make_panel(spark, sf)).select("ticker", "reporting_year", *vocab.FLAGS)


@query(
    S.on_panel(
        "SELECT "
        + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_missing" for c in vocab.FLAGGED)
        + " FROM panel"
    )
)
def flag_totals(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.flag_totals(cleaning.add_flags(make_panel(spark, sf)))


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year,
                   {', '.join(f'coalesce({c}, (SELECT median({c}) FROM panel)) AS {c}' for c in vocab.FLAGGED)}
            FROM panel"""
    )
)
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged_panel(spark, sf)
    filled = cleaning.apply_fill(rows, cleaning.fit_fill(rows, categorical=[]))
    return filled.select("ticker", "reporting_year", *vocab.FLAGGED)


def _mode_sql(column: str) -> str:
    return (
        f"coalesce({column}, (SELECT {column} FROM panel WHERE {column} IS NOT NULL "
        f"GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT 1), 'Unknown') AS {column}"
    )


@query(
    S.on_panel(
        f"SELECT ticker, reporting_year, {', '.join(map(_mode_sql, vocab.CATEGORICAL))} FROM panel"
    )
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = make_panel(spark, sf)
    filled = cleaning.apply_fill(rows, cleaning.fit_fill(rows, numeric=[]))
    return filled.select("ticker", "reporting_year", *vocab.CATEGORICAL)


def _clip_sql(c: str) -> str:
    lo, hi = (f"(SELECT quantile_cont({c}, {q}) FROM panel)" for q in (0.01, 0.99))
    return f"round(CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END, 6) AS {c}"


@query(
    S.on_panel(
        f"SELECT ticker, reporting_year, {', '.join(map(_clip_sql, vocab.FLAGGED))} FROM panel"
    )
)
def winsorise(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged_panel(spark, sf)
    clipped = cleaning.apply_bounds(rows, cleaning.fit_bounds(rows))
    return rounded(clipped.select("ticker", "reporting_year", *vocab.FLAGGED), vocab.FLAGGED)


_LOG_SQL = ", ".join(
    f"CASE WHEN {raw} IS NOT NULL THEN round(ln(1 + greatest({raw}, 0)), 6) END AS {log}"
    for raw, log in [*vocab.LOG_OF.items(), *[(t, f"log_{t}") for t in vocab.TARGETS]]
)


@query(S.on_panel(f"SELECT ticker, reporting_year, {_LOG_SQL} FROM panel"))
def log_features(spark: SparkSession, sf: str) -> DataFrame:
    logs = [*vocab.LOG_OF.values(), *[f"log_{t}" for t in vocab.TARGETS]]
    table = cleaning.add_logs(make_panel(spark, sf)).select("ticker", "reporting_year", *logs)
    return rounded(table, logs)


_RATIO_SQL = ", ".join(
    f"CASE WHEN {b} = 0 OR {t} IS NULL OR {b} IS NULL THEN 0.0 ELSE {t} / {b} END AS {name}"
    for name, (t, b) in vocab.RATIO_OF.items()
)


@query(S.on_panel(f"SELECT ticker, reporting_year, {_RATIO_SQL} FROM panel"))
def ratios(spark: SparkSession, sf: str) -> DataFrame:
    return add_ratios(make_panel(spark, sf)).select("ticker", "reporting_year", *vocab.RATIO_OF)


_CLEAN_NUMBERS = [*vocab.FLAGGED, *vocab.LOG_OF.values(), *[f"log_{t}" for t in vocab.TARGETS]]


@query(
    S.on_panel(
        f"""SELECT company_name, company_name_raw, ticker, reporting_year, sector, industry, country,
                   {', '.join(vocab.FLAGS)}, {S.rounded(_CLEAN_NUMBERS, 6)} FROM clean""",
        *S.CLEAN,
    )
)
def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean(make_panel(spark, sf)), _CLEAN_NUMBERS)


_FEATURE_NUMBERS = [*vocab.LOG_OF.values(), *vocab.RATIO_OF, *vocab.GROUP_MEANS]


# a quotient may lie halfway between two roundings; both sides add the same tiny amount first
_NUDGE = 1e-10


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, {', '.join(vocab.CODES)},
                   {', '.join(f'round({c} + 1e-10, 6) AS {c}' for c in _FEATURE_NUMBERS)} FROM features""",
        *S.FEATURES,
    )
)
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    table = features(clean(make_panel(spark, sf)))
    return table.select(
        "ticker", "reporting_year", *vocab.CODES,
        *[F.round(F.col(c) + _NUDGE, 6).alias(c) for c in _FEATURE_NUMBERS],
    )


# --- joins and lookups -------------------------------------------------------------------

_FIN = """fin AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ticker, round(sum(o_totalprice), 2) AS f_revenue,
         max(o_orderpriority) AS f_industry, CAST(count(*) AS DOUBLE) AS f_employees,
         CAST(year(max(o_orderdate)) AS INTEGER) AS last_order_year
  FROM orders GROUP BY o_custkey)"""


@query(
    S.on_panel(
        """SELECT p.* REPLACE (coalesce(revenue, f_revenue) AS revenue,
                               coalesce(industry, f_industry) AS industry,
                               coalesce(employee_count, f_employees) AS employee_count),
                  last_order_year FROM panel p LEFT JOIN fin USING (ticker)""",
        _FIN,
    )
)
def merge_fill(spark: SparkSession, sf: str) -> DataFrame:
    return joins.merge_financials(make_panel(spark, sf), financials(spark, sf), fill=True)


@query(
    S.on_panel("SELECT p.*, last_order_year FROM panel p LEFT JOIN fin USING (ticker)", _FIN)
)
def merge_drop(spark: SparkSession, sf: str) -> DataFrame:
    return joins.merge_financials(make_panel(spark, sf), financials(spark, sf), fill=False)


_NATION = f"""nation_figures AS (
  SELECT {S.texts(COUNTRY_OF_NATION)}[s_nationkey + 1] AS country,
         round(sum(s_acctbal), 2) AS gdp_per_capita, CAST(count(*) AS DOUBLE) AS energy_intensity
  FROM supplier GROUP BY s_nationkey)"""


@query(
    S.on_panel(
        "SELECT p.*, gdp_per_capita, energy_intensity FROM panel p LEFT JOIN nation_figures USING (country)",
        _NATION,
    )
)
def merge_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return joins.merge_indicators(make_panel(spark, sf), nation_indicators(spark, sf))


@query(
    S.on_panel(
        """SELECT p.* REPLACE (CASE WHEN reporting_year < 1998 THEN NULL ELSE p.country END AS country),
                  gdp_per_capita FROM panel p LEFT JOIN gaps
           ON CASE WHEN reporting_year < 1998 THEN NULL ELSE p.country END IS NOT DISTINCT FROM gaps.country""",
        _NATION,
        """gaps AS (SELECT CASE WHEN country = 'ZZ' THEN NULL ELSE country END AS country, gdp_per_capita
                    FROM nation_figures)""",
    )
)
def merge_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Null keys match a null key: older rows lost their country, one indicator row its own."""
    country = F.col("country")
    rows = make_panel(spark, sf).withColumn("country", F.when(F.col("reporting_year") >= 1998, country))
    figures = (
        nation_indicators(spark, sf)
        .withColumn("country", F.when(country != "ZZ", country))
        .drop("energy_intensity")
    )
    return joins.merge_indicators(rows, figures, null_safe=True)


# several country texts stand for one code: the code itself, then the first text, gives the row
_BY_CODE = f"""by_code AS (
  SELECT code, first(gdp_per_capita ORDER BY country <> code, country) AS gdp_per_capita,
         first(energy_intensity ORDER BY country <> code, country) AS energy_intensity
  FROM (SELECT *, {S.COUNTRY_CODE} AS code FROM nation_figures) GROUP BY code)"""


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, code AS country, coalesce(revenue, f_revenue) AS revenue,
                   last_order_year, gdp_per_capita, energy_intensity
            FROM (SELECT *, {S.COUNTRY_CODE} AS code FROM panel) p
            LEFT JOIN fin USING (ticker)
            LEFT JOIN by_code USING (code)""",
        _FIN, _NATION, S.ALIAS_TABLE, _BY_CODE,
    )
)
def merge_all(spark: SparkSession, sf: str) -> DataFrame:
    """All three sources, countries brought to codes before the indicator join."""
    merged = merge_sources(make_panel(spark, sf), financials(spark, sf), nation_indicators(spark, sf))
    return merged.select(
        "ticker", "reporting_year", "country", "revenue", "last_order_year", "gdp_per_capita",
        "energy_intensity",
    )


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, code AS country, coalesce(revenue, f_revenue) AS revenue,
                   gdp_per_capita, energy_intensity
            FROM (SELECT *, {S.COUNTRY_CODE} AS code FROM panel) p
            LEFT JOIN fin USING (ticker) LEFT JOIN by_code USING (code)""",
        _FIN, _NATION, S.ALIAS_TABLE, _BY_CODE,
    )
)
def ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """The ingest job over landed CSV files, one cell with a line break included."""
    paths = [stage_path(spark, name) for name in ("emissions", "financials", "indicators")]
    noted = make_panel(spark, sf).withColumn("note", F.lit("two\nlines"))
    files.write_csv(noted, paths[0])
    files.write_csv(financials(spark, sf), paths[1])
    files.write_csv(nation_indicators(spark, sf), paths[2])
    merged = ingest(spark, *paths, multi_line=True)
    return merged.select(
        "ticker", "reporting_year", "country", "revenue", "gdp_per_capita", "energy_intensity"
    )



@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, round(ln(1 + coalesce(f1, 100.0) * 50), 8) AS sector_mean_log_scope1,
                   round(ln(1 + coalesce(f2, 100.0) * 50), 8) AS sector_mean_log_scope2
            FROM (SELECT *, {S.FIXED_SECTOR} AS fixed FROM panel) LEFT JOIN factor ON factor.name = fixed""",
        S.SECTOR_TABLE, S.SECTOR_MODE,
        f"factor(name, f1, f2) AS ({S.values([(s, p['s1_factor'], p['s2_factor']) for s, p in vocab.SECTOR_PROFILE.items()])})",
    )
)
def sector_prior(spark: SparkSession, sf: str) -> DataFrame:
    table = prior_means(cleaning.validate_sectors(make_panel(spark, sf)))
    names = ["sector_mean_log_scope1", "sector_mean_log_scope2"]
    return rounded(table.select("ticker", "reporting_year", *names), names, 8)


@query(
    S.on_panel(
        f"""SELECT ticker, reporting_year, coalesce(gdp, 50000.0) AS gdp_per_capita,
                   coalesce(energy, 4.5) AS energy_intensity
            FROM (SELECT *, {S.COUNTRY_CODE} AS code FROM panel) LEFT JOIN macro ON macro.name = code""",
        S.ALIAS_TABLE,
        f"macro(name, gdp, energy) AS ({S.values([r[:3] for r in vocab.COUNTRIES])})",
    )
)
def country_macro_lookup(spark: SparkSession, sf: str) -> DataFrame:
    table = default_macro(cleaning.normalise_countries(make_panel(spark, sf)))
    return table.select("ticker", "reporting_year", *vocab.MACRO)


# --- encoders ----------------------------------------------------------------------------


@query(
    S.on_panel(
        "SELECT ticker, reporting_year, "
        + ", ".join(
            f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Unknown')) - 1 AS INTEGER) AS {c}_encoded"
            for c in vocab.CATEGORICAL
        )
        + " FROM panel"
    )
)
def ordinal_codes(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_all(make_panel(spark, sf)).select("ticker", "reporting_year", *vocab.CODES)


@query(
    """
WITH known AS (SELECT p_type AS v, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 3 AND p_retailprice < 950))
SELECT p_partkey, p_type, coalesce(code, -1) AS p_type_encoded FROM part LEFT JOIN known ON v = p_type"""
)
def ordinal_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Codes fitted on the small cheap parts, applied to all parts; unseen types get -1."""
    parts = read(spark, sf, "part")
    fitted = encode.OrdinalCode(inputCol="p_type").fit(
        parts.where((F.col("p_size") < 3) & (F.col("p_retailprice") < 950))
    )
    return fitted.transform(parts).select("p_partkey", "p_type", "p_type_encoded")


def logged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"log_{t}": safe_log1p(F.col(t)) for t in vocab.TARGETS})


_LOGGED = """logged AS (
  SELECT *, CASE WHEN scope1_emissions IS NOT NULL THEN ln(1 + greatest(scope1_emissions, 0)) END AS l1,
         CASE WHEN scope2_emissions IS NOT NULL THEN ln(1 + greatest(scope2_emissions, 0)) END AS l2
  FROM panel)"""
_MEAN_NAMES = vocab.GROUP_MEANS


@query(
    S.on_panel(
        """SELECT ticker, reporting_year,
                  round(avg(l1) OVER (PARTITION BY sector), 6) AS sector_mean_log_scope1,
                  round(avg(l2) OVER (PARTITION BY sector), 6) AS sector_mean_log_scope2,
                  round(avg(l1) OVER (PARTITION BY country), 6) AS country_mean_log_scope1,
                  round(avg(l2) OVER (PARTITION BY country), 6) AS country_mean_log_scope2
           FROM logged""",
        _LOGGED,
    )
)
def group_mean_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = logged(make_panel(spark, sf))
    for group in ("sector", "country"):
        rows = encode.GroupMean(groupCol=group).fit(rows).transform(rows)
    return rounded(rows.select("ticker", "reporting_year", *_MEAN_NAMES), _MEAN_NAMES)


@query(
    S.on_panel(
        """SELECT ticker, reporting_year,
                  round(coalesce(m1, (SELECT avg(l1) FROM logged WHERE reporting_year < 1995)), 6) AS industry_mean_log_scope1,
                  round(coalesce(m2, (SELECT avg(l2) FROM logged WHERE reporting_year < 1995)), 6) AS industry_mean_log_scope2
           FROM logged LEFT JOIN fitted USING (industry)""",
        _LOGGED,
        """fitted AS (SELECT industry, avg(l1) AS m1, avg(l2) AS m2 FROM logged
                      WHERE reporting_year < 1995 GROUP BY industry)""",
    )
)
def group_mean_train(spark: SparkSession, sf: str) -> DataFrame:
    """Means fitted on the early years, applied to all; a null group gets the global mean."""
    rows = logged(make_panel(spark, sf))
    fitted = encode.GroupMean(groupCol="industry").fit(rows.where(F.col("reporting_year") < 1995))
    names = fitted.names()
    return rounded(fitted.transform(rows).select("ticker", "reporting_year", *names), names)


FOLD_SQL = (
    "CAST((('0x' || substr(md5('42|' || company_name || '|' || reporting_year), 1, 13))::BIGINT) % 5 AS INTEGER)"
)


@query(
    S.on_panel(
        """SELECT a.ticker, a.reporting_year, a.fold,
                  round(CASE WHEN g.n1 > f.n1 THEN (g.s1 - f.s1) / (g.n1 - f.n1) END, 6) AS country_mean_log_scope1,
                  round(CASE WHEN g.n2 > f.n2 THEN (g.s2 - f.s2) / (g.n2 - f.n2) END, 6) AS country_mean_log_scope2
           FROM folded a JOIN per_fold f USING (country, fold)
           JOIN (SELECT country, sum(s1) AS s1, sum(s2) AS s2, sum(n1) AS n1, sum(n2) AS n2
                 FROM per_fold GROUP BY country) g USING (country)""",
        _LOGGED,
        f"folded AS (SELECT *, {FOLD_SQL} AS fold FROM logged)",
        """per_fold AS (SELECT country, fold, coalesce(sum(l1), 0) AS s1, coalesce(sum(l2), 0) AS s2,
                               count(l1) AS n1, count(l2) AS n2 FROM folded GROUP BY ALL)""",
    )
)
def group_mean_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = logged(make_panel(spark, sf)).withColumn("fold", row_fold([F.col(k) for k in KEYED]))
    names = ["country_mean_log_scope1", "country_mean_log_scope2"]
    table = encode.out_of_fold_means(rows, "country", "fold")
    return rounded(table.select("ticker", "reporting_year", "fold", *names), names)
