"""Queries: profiling, splits, metrics, scoring by formula and attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.catalog import flagship
from fumarole.catalog import sql as S
from fumarole.catalog.panel import panel as make_panel
from fumarole.catalog.panel import read
from fumarole.catalog.registry import query
from fumarole.catalog.tables import FOLD_SQL, KEYED, rounded, staged_panel
from fumarole.functions import confidence_band
from fumarole.operators import attribution, cleaning, metrics, neighbours, profiling, scoring, split
from fumarole.operators.learners import prepare
from fumarole.operators.quantiles import quantile_table
from fumarole.plans.features import add_ratios
from fumarole.session import materialise, stage_path
from fumarole.sources.files import read_table, write_table

MEASURES = [*vocab.FLAGGED, "reporting_year"]


def _log(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN ln(1 + greatest({column}, 0)) END"


_LOGGED = (
    "logged AS (SELECT *, "
    + ", ".join(f"{_log(raw)} AS {log}" for raw, log in vocab.LOG_OF.items())
    + ", "
    + ", ".join(f"{_log(t)} AS log_{t}" for t in vocab.TARGETS)
    + " FROM panel)"
)
BITS_SQL = (
    "('0x' || substr(md5('42|' || company_name || '|' || reporting_year), 1, 13))::BIGINT"
)


# --- profiling ---------------------------------------------------------------------------


@query(
    S.on_panel(
        f"""SELECT sector, {', '.join(f'round(median({c}), 6) AS {c}' for c in vocab.TARGETS)},
                   round(median(scope1_emissions / revenue), 6) AS scope1_per_revenue,
                   round(median(scope2_emissions / revenue), 6) AS scope2_per_revenue
            FROM clean GROUP BY sector""",
        *S.CLEAN,
    )
)
def sector_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return flagship.sector_medians_of(spark, sf)


@query(
    S.on_panel(
        "SELECT sector, median(scope1_emissions) AS scope1_emissions, "
        "median(scope2_emissions) AS scope2_emissions FROM panel GROUP BY sector"
    )
)
def sector_medians(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.group_medians(staged_panel(spark, sf))


_UNBOUNDED = """CASE WHEN total_assets < 0 THEN '-infinity'::DOUBLE WHEN reporting_year = 1995 THEN 'infinity'::DOUBLE
              WHEN reporting_year = 1996 THEN revenue * 1e-320 ELSE revenue END"""


@query(
    S.on_panel(
        f"""SELECT sector, {', '.join(f'quantile_cont(v, {p}) AS q{round(100 * p)}' for p in (0.01, 0.25, 0.5, 0.75, 0.99))}
            FROM (SELECT sector, {_UNBOUNDED} AS v FROM panel) GROUP BY sector
            UNION ALL SELECT 'all', {', '.join(f'quantile_cont(v, {p})' for p in (0.01, 0.25, 0.5, 0.75, 0.99))}
            FROM (SELECT {_UNBOUNDED} AS v FROM panel)"""
    )
)
def unbounded_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of a column with both infinities and denormal numbers, overall and by sector."""
    year = F.col("reporting_year")
    v = F.when(F.col("total_assets") < 0, float("-inf")).when(year == 1995, float("inf"))
    v = v.when(year == 1996, F.col("revenue") * 1e-320).otherwise(F.col("revenue"))
    rows = make_panel(spark, sf).select("sector", v.alias("v"))
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    overall = quantile_table(rows, ["v"], probs).withColumn("sector", F.lit("all"))
    table = quantile_table(rows, ["v"], probs, by=["sector"]).unionByName(overall)
    return table.select("sector", *[F.get("v", i).alias(f"q{round(100 * p)}") for i, p in enumerate(probs)])


@query(
    S.on_panel(
        """SELECT CAST(k AS INTEGER) AS bin, round(lo + k * width, 6) AS lo,
                  round(lo + (k + 1) * width, 6) AS hi, count(log_scope1_emissions) AS n
           FROM span CROSS JOIN range(50) r(k)
           LEFT JOIN logged ON least(floor((log_scope1_emissions - lo) / width), 49) = k
           GROUP BY k, lo, width""",
        _LOGGED,
        """span AS (SELECT min(log_scope1_emissions) AS lo,
                    (max(log_scope1_emissions) - min(log_scope1_emissions)) / 50 AS width FROM logged)""",
    )
)
def emissions_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.add_logs(make_panel(spark, sf))
    return rounded(profiling.histogram(rows, "log_scope1_emissions", 50), ["lo", "hi"])


def _corr_sql(x: str, y: str) -> str:
    r = f"round(corr({x}, {y}), 6)" if x != y else f"CASE WHEN min({x}) < max({x}) THEN 1.0::DOUBLE END"
    return f"SELECT '{x}' AS x, '{y}' AS y, {r} AS r FROM panel"


@query(S.on_panel(" UNION ALL ".join(_corr_sql(x, y) for x in MEASURES for y in MEASURES)))
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.correlations(make_panel(spark, sf), MEASURES, digits=6)


@query(
    S.on_panel(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 3) AS mean,
                       round(stddev_samp({c}), 3) AS std, round(min({c})::DOUBLE, 3) AS min,
                       round(quantile_cont({c}, 0.25)::DOUBLE, 3) AS q25, round(median({c})::DOUBLE, 3) AS q50,
                       round(quantile_cont({c}, 0.75)::DOUBLE, 3) AS q75, round(max({c})::DOUBLE, 3) AS max FROM panel"""
            for c in ["total_assets", "employee_count", "reporting_year"]
        )
    )
)
def describe(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged_panel(spark, sf)
    return profiling.describe(rows, ["total_assets", "employee_count", "reporting_year"])


@query(
    S.on_panel(
        " UNION ALL ".join(
            f"""SELECT '{raw}' AS "column", round(skewness({raw}), 6) AS raw_skew,
                       round(skewness({log}), 6) AS log_skew FROM logged"""
            for raw, log in vocab.LOG_OF.items()
        ),
        _LOGGED,
    )
)
def skewness(spark: SparkSession, sf: str) -> DataFrame:
    table = profiling.skew_before_after(cleaning.add_logs(make_panel(spark, sf)))
    return rounded(table, ["raw_skew", "log_skew"])


@query(
    S.on_panel(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_distinct FROM panel'
            for c in [*vocab.CATEGORICAL, "ticker", "reporting_year"]
        )
    )
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.distinct_counts(
        make_panel(spark, sf), [*vocab.CATEGORICAL, "ticker", "reporting_year"]
    )


@query(
    S.on_panel(
        " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM panel'
            for c in MEASURES
        )
    )
)
def column_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.column_ranges(make_panel(spark, sf), MEASURES)


@query(S.on_panel("SELECT ticker, reporting_year, revenue, market_cap FROM panel"))
def varying_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A constant and an empty column are dropped, the others stay."""
    rows = make_panel(spark, sf).select(
        "ticker", "reporting_year", "revenue", "market_cap",
        F.lit(4.5).alias("constant"), F.lit(None).cast("double").alias("empty"),
    )
    kept = profiling.varying_columns(rows, ["revenue", "market_cap", "constant", "empty"])
    return rows.select("ticker", "reporting_year", *kept)


_BOX_SQL = """
SELECT sector, count(v) AS n, round(min(v), 6) AS lo,
       round(min(v) FILTER (WHERE inside), 6) AS whisker_lo, round(any_value(q1), 6) AS q1,
       round(any_value(med), 6) AS med, round(any_value(q3), 6) AS q3,
       round(max(v) FILTER (WHERE inside), 6) AS whisker_hi, round(max(v), 6) AS hi,
       count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM points JOIN box USING (sector))
GROUP BY sector"""


@query(
    S.on_panel(
        _BOX_SQL,
        "points AS (SELECT sector, ln(1 + scope1_emissions) AS v FROM panel WHERE scope1_emissions IS NOT NULL)",
        """box AS (SELECT sector, quantile_cont(v, 0.25) AS q1, median(v) AS med,
                          quantile_cont(v, 0.75) AS q3 FROM points GROUP BY sector)""",
    )
)
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    table = profiling.box_stats(staged_panel(spark, sf), vocab.SCOPE1)
    return rounded(table, ["lo", "whisker_lo", "q1", "med", "q3", "whisker_hi", "hi"])


@query(
    S.on_panel(
        "SELECT company_name, reporting_year, sector, total_assets, scope2_emissions FROM panel "
        "WHERE total_assets > 0 AND scope2_emissions > 0"
    )
)
def scatter_points(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.scatter_points(make_panel(spark, sf), "total_assets", vocab.SCOPE2)


_PAIRS = [*vocab.LOG_OF.values(), vocab.SCOPE1]


@query(
    S.on_panel(
        f"""SELECT company_name, reporting_year, {S.rounded(_PAIRS, 6)} FROM logged
            WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _PAIRS)}
            ORDER BY {BITS_SQL}, company_name, reporting_year LIMIT {vocab.PAIR_ROWS}""",
        _LOGGED,
    )
)
def pair_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiling.pair_sample(cleaning.add_logs(make_panel(spark, sf))), _PAIRS)


@query(S.on_panel("SELECT * FROM panel ORDER BY company_name, reporting_year LIMIT 5"))
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return make_panel(spark, sf).orderBy(*KEYED).limit(5)


@query(
    S.on_panel(
        """SELECT "column", n_missing, round(n_missing * 100.0 / (SELECT count(*) FROM panel), 6) AS pct_missing FROM ("""
        + " UNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM panel'
            for c in S.COLUMNS
        )
        + ") WHERE n_missing > 0"
    )
)
def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiling.missing_profile(make_panel(spark, sf)), ["pct_missing"])


_MI_COLUMNS = ["revenue", "total_assets", "market_cap", "employee_count", "reporting_year"]
_TENTHS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


def _bin_sql(column: str, edges: str) -> str:
    inner = f"list_sort(list_distinct({edges}))"
    return f"len(list_filter({inner}[2:len({inner}) - 1], lambda e: e < {column}))"


def _mi_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS "column", round(sum(n * ln(n * t / (nx * ny))) / any_value(t), 6) AS mi FROM (
  SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY bx)::DOUBLE AS nx,
         sum(n) OVER (PARTITION BY bt)::DOUBLE AS ny
  FROM (SELECT {_bin_sql(c, 'e_' + c)} AS bx, {_bin_sql('scope1_emissions', 'e_scope1_emissions')} AS bt, count(*) AS n
        FROM complete, edges GROUP BY ALL))"""


@query(
    S.on_panel(
        " UNION ALL ".join(_mi_sql(c) for c in _MI_COLUMNS),
        f"""complete AS MATERIALIZED (SELECT {', '.join(_MI_COLUMNS)}, scope1_emissions FROM panel
            WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_MI_COLUMNS, 'scope1_emissions'])})""",
        "edges AS MATERIALIZED (SELECT "
        + ", ".join(f"quantile_cont({c}, {_TENTHS}) AS e_{c}" for c in [*_MI_COLUMNS, "scope1_emissions"])
        + " FROM complete)",
    )
)
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    table = profiling.mutual_information(staged_panel(spark, sf), _MI_COLUMNS)
    return rounded(table, ["mi"])


_NEAR_COLUMNS = ["revenue", "market_cap", "employee_count", "reporting_year"]


def _near_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", id, {c}::DOUBLE AS x, scope1_emissions::DOUBLE AS y,
               stddev_pop({c}::DOUBLE) OVER () AS sx, stddev_pop(scope1_emissions::DOUBLE) OVER () AS sy FROM complete"""


@query(
    S.on_panel(
        """SELECT "column", round(greatest(avg(hn.psi + hk.psi - hx.psi - hy.psi), 0), 6) AS mi
           FROM counted JOIN harmonic hn ON hn.n = counted.n JOIN harmonic hk ON hk.n = counted.k
           JOIN harmonic hx ON hx.n = counted.nx JOIN harmonic hy ON hy.n = counted.ny GROUP BY 1""",
        f"""complete AS MATERIALIZED (SELECT row_number() OVER () AS id, {', '.join(_NEAR_COLUMNS)}, scope1_emissions FROM panel
            WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_NEAR_COLUMNS, 'scope1_emissions'])})""",
        f"placed AS MATERIALIZED ({' UNION ALL '.join(_near_sql(c) for c in _NEAR_COLUMNS)})",
        """reach AS MATERIALIZED (
             SELECT a."column", a.id, min(greatest(abs(a.x - b.x) / a.sx, abs(a.y - b.y) / a.sy), 3)[3] AS r
             FROM placed a JOIN placed b ON a."column" = b."column" AND a.id <> b.id GROUP BY ALL)""",
        """counted AS MATERIALIZED (
             SELECT a."column", a.id, count(*) AS n,
                    CASE WHEN r = 0 THEN count(*) FILTER (a.x = b.x AND a.y = b.y) ELSE 3 END AS k,
                    count(*) FILTER (abs(a.x - b.x) / a.sx < r OR (r = 0 AND a.x = b.x)) AS nx,
                    count(*) FILTER (abs(a.y - b.y) / a.sy < r OR (r = 0 AND a.y = b.y)) AS ny
             FROM placed a JOIN reach USING ("column", id) JOIN placed b ON a."column" = b."column" GROUP BY a."column", a.id, r)""",
        """harmonic AS MATERIALIZED (
             SELECT i AS n, coalesce(sum(1.0::DOUBLE / (i - 1)) FILTER (i > 1) OVER (ORDER BY i), 0) - 0.5772156649015329 AS psi
             FROM range(1, (SELECT count(*) + 1 FROM complete)) t(i))""",
    )
)
def nearest_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbours.nearest_information(staged_panel(spark, sf), _NEAR_COLUMNS), ["mi"])


# --- splits and samples ------------------------------------------------------------------

_BINNED = f"""edges AS (SELECT quantile_cont(scope1_emissions, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM panel),
binned AS MATERIALIZED (
  SELECT panel.*, CASE WHEN scope1_emissions IS NOT NULL
         THEN CAST({_bin_sql('scope1_emissions', 'e')} AS INTEGER) END AS bin FROM panel, edges)"""
_SPLIT = f"""drawn AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {BITS_SQL}) <=
            (count(*) OVER (PARTITION BY bin) + 3) // 5 AS is_test FROM binned)"""


@query(S.on_panel("SELECT ticker, reporting_year, bin FROM binned", _BINNED))
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratify(staged_panel(spark, sf), vocab.SCOPE1).select("ticker", "reporting_year", "bin")


@query(S.on_panel("SELECT ticker, reporting_year, bin, is_test FROM drawn", _BINNED, _SPLIT))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    table = split.stratified_split(staged_panel(spark, sf), vocab.SCOPE1)
    return table.select("ticker", "reporting_year", "bin", "is_test")


@query(
    S.on_panel(
        "SELECT company_name, reporting_year, revenue, market_cap, sector FROM drawn WHERE is_test",
        _BINNED, _SPLIT,
    )
)
def held_out_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out rows as stored; the feature order is that of the stored columns."""
    rows = staged_panel(spark, sf).select(*KEYED, "revenue", "market_cap", vocab.SCOPE1, "sector")
    _, test = split.train_and_test(split.stratified_split(rows, vocab.SCOPE1))
    path = stage_path(spark, "test")
    write_table(test, path)
    stored = read_table(spark, path)
    names = [c for c in stored.columns if c not in (*KEYED, vocab.SCOPE1, "sector")]
    return stored.select(*KEYED, *names, "sector")


def _greedy(group: str) -> str:
    return _GREEDY.replace("country", group)


_GREEDY = """sizes AS (
  SELECT country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, country DESC) AS k
  FROM panel GROUP BY country),
walk(k, loads, country, n, fold) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, 0::BIGINT, 0::INTEGER
  UNION ALL
  SELECT s.k, list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads))
                                                        THEN x + s.n ELSE x END),
         s.country, s.n, CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INTEGER)
  FROM walk w JOIN sizes s ON s.k = w.k + 1)"""


@query(
    S.on_panel("SELECT country, n AS n_rows, fold FROM walk WHERE k > 0", _GREEDY).replace(
        "WITH", "WITH RECURSIVE", 1
    )
)
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return split.group_folds(make_panel(spark, sf), "country")


@query(
    S.on_panel("SELECT ticker, n AS n_rows, fold FROM walk WHERE k > 0", _greedy("ticker")).replace(
        "WITH", "WITH RECURSIVE", 1
    )
)
def group_folds_many(spark: SparkSession, sf: str) -> DataFrame:
    """Many groups of few sizes, dealt in closed form size by size."""
    return split.group_folds(make_panel(spark, sf), "ticker", max_rows=100)


@query(S.on_panel(f"SELECT ticker, reporting_year, {FOLD_SQL} AS fold FROM panel"))
def row_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Without groups the folds come from the key hash."""
    rows, _ = split.add_folds(make_panel(spark, sf), None)
    return rows.select("ticker", "reporting_year", "fold")


@query(
    S.on_panel(
        f"SELECT company_name, reporting_year, revenue FROM panel ORDER BY {BITS_SQL}, 1, 2 LIMIT 200"
    )
)
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = make_panel(spark, sf).select(*KEYED, "revenue")
    return split.hash_sample(rows, vocab.EXPLAIN_ROWS, KEYED)


# --- projections -------------------------------------------------------------------------

_PROJECTED = [*vocab.LOG_OF.values(), *vocab.RATIO_OF]


@query(
    S.on_panel(
        f"""SELECT company_name, reporting_year,
                   {', '.join(f'round({c} + 1e-10, 6) AS {c}' for c in _PROJECTED)},
                   {', '.join(f'CAST({c} IS NULL AS INTEGER) AS {c}_missing' for c in vocab.FLAGGED)},
                   round(log_scope2_emissions + 1e-10, 6) AS log_scope2_emissions, sector
            FROM (SELECT *, {S.RATIOS} FROM logged)""",
        _LOGGED,
    )
)
def feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Listed features that exist, the flags, the target made on the way, and the sector."""
    rows = add_ratios(cleaning.add_logs(make_panel(spark, sf), targets=False))
    table = prepare(cleaning.add_flags(rows), vocab.SCOPE2, keys=KEYED)
    return table.withColumns(
        {c: F.round(F.col(c) + 1e-10, 6) for c in [*_PROJECTED, "log_scope2_emissions"]}
    )


@query(
    S.on_panel(
        """SELECT ticker, reporting_year, market_cap, 0 AS gdp_per_capita, revenue, 0 AS revenue_missing
           FROM panel"""
    )
)
def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["market_cap", "gdp_per_capita", "revenue", "revenue_missing"]
    return scoring.aligned(make_panel(spark, sf), names, keep=["ticker", "reporting_year"])


# --- metrics -----------------------------------------------------------------------------

_FORMULAS = {
    "flat": (0.0, 17000.0),
    "discounted": (0.05, 0.0),
    "mixed": (0.04, 3000.0),
}


def _formula(name: str):
    slope, level = _FORMULAS[name]
    return F.col("market_cap") * slope + level


def _formula_sql(name: str) -> str:
    slope, level = _FORMULAS[name]
    return f"(market_cap * {slope!r}e0 + {level!r}e0)"


def _points(rows: DataFrame, name: str = "mixed") -> DataFrame:
    return rows.select(
        *KEYED, "sector", "industry", F.col(vocab.SCOPE1).alias("actual"), _formula(name).alias("predicted")
    )


def _points_sql(name: str = "mixed") -> str:
    return (
        "(SELECT company_name, reporting_year, sector, industry, scope1_emissions AS actual, "
        f"{_formula_sql(name)} AS predicted FROM panel)"
    )


_METRIC_NAMES = ["r2", "rmse", "mae", "mape"]


def _metric_sql(y: str = "actual", p: str = "predicted", prefix: str = "") -> str:
    cells = {
        "r2": f"1 - sum(({y} - {p}) ** 2) / (var_pop(CASE WHEN {p} IS NOT NULL THEN {y} END) * count({y} - {p}))",
        "rmse": f"sqrt(avg(({y} - {p}) ** 2))",
        "mae": f"avg(abs({y} - {p}))",
        "mape": f"avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) END) * 100",
    }
    return ", ".join(f"round({cell} + 1e-9, 6) AS {prefix}{name}" for name, cell in cells.items())


def _shown(df: DataFrame, names: list[str] = _METRIC_NAMES) -> DataFrame:
    """Metrics to six digits; means of few rows lie halfway, so both sides add a little first."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in names})


@query(S.on_panel(f"SELECT {_metric_sql()} FROM {_points_sql()}"))
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(metrics.metrics(_points(make_panel(spark, sf))))


@query(
    S.on_panel(
        f"""SELECT {_metric_sql('(exp(y) - 1)', '(exp(p) - 1)')}, {_metric_sql('y', 'p', 'log_')}
            FROM (SELECT log_scope1_emissions AS y, 0.9 * log_market_cap - 2.0 AS p FROM logged)""",
        _LOGGED,
    )
)
def metrics_both_scales(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.add_logs(make_panel(spark, sf)).select(
        F.col("log_scope1_emissions").alias("y"), (0.9 * F.col("log_market_cap") - 2.0).alias("p")
    )
    names = [f"{prefix}{m}" for prefix in ("", "log_") for m in _METRIC_NAMES]
    return _shown(metrics.both_scales(rows, "y", "p"), names)


@query(
    S.on_panel(
        f"""SELECT industry, count(*) AS n_rows, {_metric_sql()} FROM {_points_sql()}
            WHERE industry IS NOT NULL GROUP BY industry HAVING count(*) >= 5"""
    )
)
def metrics_by_industry(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(metrics.metrics_by(_points(make_panel(spark, sf)), "industry"))


@query(
    S.on_panel(
        f"""SELECT sector, reporting_year, count(*) AS n_rows, {_metric_sql()} FROM {_points_sql()}
            GROUP BY ALL"""
    )
)
def metrics_by_sector_year(spark: SparkSession, sf: str) -> DataFrame:
    """The metric columns under any grouping."""
    points = _points(make_panel(spark, sf))
    cells = metrics.metric_columns(F.col("actual"), F.col("predicted"))
    table = points.groupBy("sector", "reporting_year").agg(F.count(F.lit(1)).alias("n_rows"), *cells)
    return _shown(table)


@query(
    S.on_panel(
        f"""SELECT company_name, reporting_year, actual, round(predicted, 6) AS predicted,
                   round(actual - predicted, 6) AS residual FROM {_points_sql()}"""
    )
)
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    table = metrics.residuals(_points(make_panel(spark, sf)))
    return rounded(table.drop("sector", "industry"), ["predicted", "residual"])


@query(
    S.on_panel(
        """SELECT CAST(k AS INTEGER) AS bin, round(lo + k * width, 4) AS lo,
                  round(lo + (k + 1) * width, 4) AS hi, count(r) AS n
           FROM span CROSS JOIN range(40) b(k) LEFT JOIN res ON least(floor((r - lo) / width), 39) = k
           GROUP BY k, lo, width""",
        f"""res AS (SELECT actual - predicted AS r FROM {_points_sql()}
            WHERE actual IS NOT NULL AND predicted IS NOT NULL)""",
        "span AS (SELECT min(r) AS lo, (max(r) - min(r)) / 40 AS width FROM res)",
    )
)
def residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    table = metrics.residuals(_points(make_panel(spark, sf)))
    return rounded(profiling.histogram(table, "residual", 40), ["lo", "hi"], 4)


@query(
    S.on_panel(
        f"""SELECT round(least(min(actual), min(predicted)), 4) AS lo,
                   round(greatest(max(actual), max(predicted)), 4) AS hi FROM {_points_sql()}"""
    )
)
def ideal_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.line_bounds(_points(make_panel(spark, sf))), ["lo", "hi"], 4)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the three formulas in one pass, and a model that failed."""
    rows = make_panel(spark, sf)
    cells = [
        F.struct(
            F.lit(name).alias("model"), *metrics.metric_columns(F.col(vocab.SCOPE1), _formula(name)),
            F.lit(None).cast("string").alias("error"),
        )
        for name in _FORMULAS
    ]
    failed = F.struct(
        F.lit("failed").alias("model"), *[F.lit(None).cast("double").alias(m) for m in _METRIC_NAMES],
        F.lit("no convergence").alias("error"),
    )
    return rows.agg(F.array(*cells).alias("cells")).select(
        F.inline(F.concat("cells", F.array(failed)))
    )


_COMPARED = " UNION ALL ".join(
    f"SELECT '{name}' AS model, {_metric_sql()} FROM {_points_sql(name)}" for name in _FORMULAS
)


@query(S.on_panel(_COMPARED))
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(metrics.ranked_models(_results(spark, sf))).drop("error")


@query(S.on_panel(f"SELECT model, r2, rmse FROM ({_COMPARED}) ORDER BY r2 DESC, rmse, model LIMIT 1"))
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    best = metrics.best_model(_results(spark, sf)).select("model", "r2", "rmse")
    return _shown(best, ["r2", "rmse"])


@query(
    S.on_panel(
        f"""SELECT metric, model, value, row_number() OVER (
               PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END, model) AS place
            FROM (UNPIVOT ({_COMPARED}) ON r2, rmse, mae, mape INTO NAME metric VALUE value)"""
    )
)
def models_per_metric(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the models under each metric."""
    results = materialise(metrics.ranked_models(_results(spark, sf)).drop("error"), "results")
    parts = []
    for metric in _METRIC_NAMES:
        ordered = metrics.sorted_by_metric(results, metric).withColumnRenamed(metric, "value")
        rows = [(metric, r["model"], r["value"], i + 1) for i, r in enumerate(ordered.collect())]
        parts.append(spark.createDataFrame(rows, "metric string, model string, value double, place bigint"))
    return _shown(reduce(DataFrame.unionByName, parts), ["value"])


# --- scoring by formula ------------------------------------------------------------------


def _floored(column: str) -> str:
    return f"greatest(coalesce({column}, 1.0), 1.0)"


_SCORED = f"""floors AS (
  SELECT company_name, reporting_year, {_floored('revenue')} AS rev, {_floored('total_assets')} AS ast,
         {_floored('employee_count')} AS emp, {_floored('market_cap')} AS cap FROM panel),
scored AS (
  SELECT *, greatest(exp(0.6 * ln(1 + cap) + 0.2 * ln(1 + emp)) - 1, 0) AS s1 FROM floors)"""


def _score_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_features(make_panel(spark, sf))


@query(
    S.on_panel(
        """SELECT company_name, reporting_year, round(ln(1 + rev), 8) AS log_revenue,
                  round(ln(1 + ast), 8) AS log_assets, round(ln(1 + emp), 8) AS log_employees,
                  round(ln(1 + cap), 8) AS log_market_cap, ast / emp AS asset_per_employee,
                  rev / emp AS revenue_per_employee, ast / rev AS asset_to_revenue,
                  emp / ast AS employee_density, cap / rev AS market_cap_to_revenue,
                  ast / rev AS capital_intensity, 10.0::DOUBLE AS country_mean_log_scope1,
                  9.0::DOUBLE AS country_mean_log_scope2, -1 AS sector_encoded, 0 AS revenue_missing
           FROM floors""",
        _SCORED,
    )
)
def score_features(spark: SparkSession, sf: str) -> DataFrame:
    table = _score_rows(spark, sf).select(
        *KEYED, *vocab.LOG_OF.values(), *vocab.RATIO_OF, "country_mean_log_scope1",
        "country_mean_log_scope2", "sector_encoded", "revenue_missing",
    )
    return rounded(table, list(vocab.LOG_OF.values()), 8)


@query(
    S.on_panel(
        """SELECT company_name, reporting_year, round(s1, 2) AS scope1, 0.0::DOUBLE AS scope2,
                  round(s1, 2) AS total, 0.65::DOUBLE AS confidence_score,
                  round(greatest(s1 * (1 - 0.45), 0), 2) AS lo, round(s1 * (1 + 0.45), 2) AS hi,
                  100.0::DOUBLE AS scope1_share, 'medium' AS band FROM scored""",
        _SCORED,
    )
)
def score_formula(spark: SparkSession, sf: str) -> DataFrame:
    """Scope 1 by a formula with a known R2, scope 2 without a model."""
    formula = 0.6 * F.col("log_market_cap") + 0.2 * F.col("log_employees")
    scored = scoring.score(_score_rows(spark, sf), {vocab.SCOPE1: formula}, {vocab.SCOPE1: 0.8})
    shares = scoring.scope_shares(scored)
    return shares.select(
        *KEYED, "scope1", "scope2", "total", "confidence_score",
        F.col("scope1_interval.lo").alias("lo"), F.col("scope1_interval.hi").alias("hi"),
        "scope1_share", confidence_band(F.col("confidence_score")).alias("band"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 70 THEN 'high' WHEN c_acctbal / 100 >= 40 THEN 'medium'
              ELSE 'low' END AS band FROM customer"""
)
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    confidence = F.col("c_acctbal") / 10_000
    return read(spark, sf, "customer").select("c_custkey", confidence_band(confidence).alias("band"))


# --- attribution -------------------------------------------------------------------------

COEFFICIENTS = {"log_revenue": 0.8, "log_assets": -0.3, "log_employees": 0.25, "log_market_cap": 0.5}


def explained_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row id and log financials, gaps as 0, as a stage table."""
    rows = cleaning.add_logs(make_panel(spark, sf)).na.fill(0.0, list(COEFFICIENTS))
    return materialise(
        attribution.with_row_id(rows).select("row_id", *COEFFICIENTS), "explained"
    )


_EXPLAINED = (
    "rows_in AS MATERIALIZED (SELECT company_name || '|' || reporting_year AS row_id, "
    + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in COEFFICIENTS)
    + " FROM logged)"
)
_MEANS = "means AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in COEFFICIENTS) + " FROM rows_in)"
_BASE = "(1.5 + " + " + ".join(f"{k!r}e0 * m_{c}" for c, k in COEFFICIENTS.items()) + ")"
_PHI = "long AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, {c} AS value, {k!r}e0 * ({c} - m_{c}) AS phi, {_BASE} AS base "
    "FROM rows_in, means"
    for c, k in COEFFICIENTS.items()
) + ")"
_LINEAR = [_LOGGED, _EXPLAINED, _MEANS, _PHI]


def _linear(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.linear_attributions(explained_rows(spark, sf), COEFFICIENTS, 1.5)


@query(
    S.on_panel(
        """SELECT row_id, feature, round(value, 6) AS value, round(phi, 6) AS phi, round(base, 6) AS base
           FROM long""",
        *_LINEAR,
    )
)
def linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_linear(spark, sf), ["value", "phi", "base"])


@query(
    S.on_panel(
        """SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM long GROUP BY feature
           ORDER BY avg(abs(phi)) DESC LIMIT 3""",
        *_LINEAR,
    )
)
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(attribution.global_importance(_linear(spark, sf), top=3), ["mean_abs_phi"])


@query(
    S.on_panel(
        """SELECT feature, row_id, round(value, 6) AS value, round(phi, 6) AS phi FROM long
           WHERE feature IN (SELECT feature FROM long GROUP BY feature ORDER BY avg(abs(phi)) DESC LIMIT 2)""",
        *_LINEAR,
    )
)
def dependence_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(attribution.dependence(_linear(spark, sf), top=2), ["value", "phi"])


@query(
    S.on_panel(
        """SELECT row_id, rank, feature, round(value, 6) AS value, round(phi, 6) AS phi,
                  round(upto - phi, 6) AS "start", round(upto, 6) AS "end"
           FROM (SELECT *, base + sum(phi) OVER (ORDER BY rank DESC) AS upto FROM (
                 SELECT *, CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank
                 FROM long WHERE row_id = (SELECT min(row_id) FROM rows_in)))""",
        *_LINEAR,
    )
)
def row_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    long = _linear(spark, sf)
    first = long.agg(F.min("row_id")).first()[0]
    return rounded(attribution.waterfall(long, first), ["value", "phi", "start", "end"])


_SWITCHED = ["log_revenue", "log_assets", "log_market_cap"]


def _interaction(df: DataFrame) -> DataFrame:
    """0.5 a + 0.2 b + 0.1 a b - 0.3 c on the inputs."""
    a, b, c = (F.get("inputs", F.lit(i)) for i in range(3))
    return df.withColumn("prediction", 0.5 * a + 0.2 * b + 0.1 * a * b - 0.3 * c)


@query(
    S.on_panel(
        """SELECT row_id, feature, round(value, 6) AS value, round(avg(phi), 6) AS phi,
                  (SELECT round(avg(0.5 * a + 0.2 * b + 0.1 * a * b - 0.3 * c), 6) FROM ground) AS base
           FROM (
             SELECT x.row_id, 'log_revenue' AS feature, x.a AS value,
                    (x.a - g.a) * (0.5 + 0.05 * (x.b + g.b)) AS phi FROM x, ground g
             UNION ALL
             SELECT x.row_id, 'log_assets', x.b, (x.b - g.b) * (0.2 + 0.05 * (x.a + g.a)) FROM x, ground g
             UNION ALL
             SELECT x.row_id, 'log_market_cap', x.c, -0.3 * (x.c - g.c) FROM x, ground g)
           GROUP BY row_id, feature, value""",
        _LOGGED, _EXPLAINED,
        "x AS (SELECT row_id, log_revenue AS a, log_assets AS b, log_market_cap AS c FROM rows_in)",
        """ground AS (SELECT * FROM x ORDER BY
             ('0x' || substr(md5('42|' || row_id), 1, 13))::BIGINT, row_id LIMIT 50)""",
    )
)
def sampled_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Any-model attribution of every row; one order and its reverse are exact for pairs."""
    rows = explained_rows(spark, sf)
    background = attribution.background_rows(rows, _SWITCHED)
    long = attribution.sampled_attributions(rows, _SWITCHED, _interaction, background, permutations=2)
    return rounded(long, ["value", "phi", "base"])
