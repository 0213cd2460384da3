"""Queries: fits, cross-validation, search, training jobs and tree attribution.

Searches and ensembles are small here; their sizes are parameters of the library calls.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.catalog import sql as S
from fumarole.catalog.analysis import _BINNED, _LOGGED, _SPLIT, BITS_SQL
from fumarole.catalog.panel import panel as make_panel
from fumarole.catalog.registry import query
from fumarole.catalog.tables import KEYED, logged, rounded, staged_panel
from fumarole.functions.hashing import key_bits
from fumarole.operators import attribution, cleaning, encode, learners, split
from fumarole.plans import train as jobs
from fumarole.plans.clean import clean
from fumarole.plans.explore import write_exploration
from fumarole.plans.features import features, fit_encoders
from fumarole.session import materialise, stage_path
from fumarole.sources.files import read_table

LABEL = "log_scope1_emissions"
INPUTS = ["log_market_cap", "log_employees"]
TREE_INPUTS = [*vocab.LOG_OF.values(), "revenue_missing", "reporting_year"]


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a scope 1 figure; gaps in the logs are 0. A stage table."""
    rows = cleaning.add_flags(cleaning.add_logs(make_panel(spark, sf)))
    return materialise(
        rows.where(F.col(LABEL).isNotNull()).na.fill(0.0, list(vocab.LOG_OF.values())), "model-rows"
    )


_ROWS = f"""fit_rows AS MATERIALIZED (
  SELECT sector, {LABEL} AS y, coalesce(log_market_cap, 0.0) AS x1, coalesce(log_employees, 0.0) AS x2
  FROM logged WHERE {LABEL} IS NOT NULL)"""


@query(
    S.on_panel(
        """SELECT round(b1, 6) AS log_market_cap, round(b2, 6) AS log_employees,
                  round(my - b1 * m1 - b2 * m2, 6) AS intercept
           FROM (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                        (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM moments)""",
        _LOGGED,
        _ROWS,
        """moments AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
                              covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1,
                              avg(x2) AS m2, avg(y) AS my FROM fit_rows)""",
    )
)
def linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The standardised linear baseline, saved and loaded, on the original feature scale."""
    rows = model_rows(spark, sf)
    fitted = learners.pipeline(learners.learners(LABEL)["LinearRegression"], INPUTS).fit(rows)
    path = stage_path(spark, "linear")
    fitted.write().save(path)
    coefficients, intercept = attribution.raw_coefficients(PipelineModel.load(path), INPUTS)
    row = [(*[coefficients[c] for c in INPUTS], intercept)]
    names = [*INPUTS, "intercept"]
    return rounded(spark.createDataFrame(row, ", ".join(f"{n} double" for n in names)), names)


@query(
    S.on_panel(
        """SELECT round(avg(mse), 6) AS cv_mse FROM (
             SELECT held.sector, avg((held.y - (slope * held.x1 + start)) ** 2) AS mse
             FROM fit_rows held JOIN (
               SELECT s.sector, regr_slope(y, x1) AS slope, regr_intercept(y, x1) AS start
               FROM (SELECT DISTINCT sector FROM fit_rows) s JOIN fit_rows r ON r.sector <> s.sector
               GROUP BY s.sector) f USING (sector)
             GROUP BY held.sector)""",
        _LOGGED,
        _ROWS,
    )
)
def cross_validated_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error of the baseline over folds that hold out whole sectors."""
    rows, folds = split.add_folds(model_rows(spark, sf), "sector")
    baseline = learners.learners(LABEL)["LinearRegression"]
    fit = learners.fit_learner(baseline, rows, LABEL, INPUTS[:1], folds)
    return rounded(spark.createDataFrame([(fit.cv_mse,)], "cv_mse double"), ["cv_mse"])


@query(
    S.on_panel(
        """SELECT ticker, reporting_year, round(coalesce(m, g), 6) AS sector_mean_log_scope1
           FROM drawn LEFT JOIN per_sector USING (sector), overall WHERE is_test""",
        _BINNED,
        _SPLIT,
        """train_rows AS (SELECT sector, CASE WHEN scope1_emissions IS NOT NULL
                            THEN ln(1 + greatest(scope1_emissions, 0)) END AS l
                          FROM drawn WHERE NOT is_test)""",
        "per_sector AS (SELECT sector, avg(l) AS m FROM train_rows GROUP BY sector)",
        "overall AS (SELECT avg(l) AS g FROM train_rows)",
    )
)
def train_only_means(spark: SparkSession, sf: str) -> DataFrame:
    """Sector means of the training rows, applied to the held-out rows."""
    rows = split.stratified_split(logged(staged_panel(spark, sf)), vocab.SCOPE1)
    train, test = split.train_and_test(materialise(rows, "split"))
    fitted = encode.GroupMean(groupCol="sector", targets=[vocab.SCOPE1]).fit(train)
    names = fitted.names()
    return rounded(fitted.transform(test).select("ticker", "reporting_year", *names), names)


def small_forest(label: str, inputs: list[str]):
    one = learners.learners(label)["RandomForest"]
    one.regressor._set(numTrees=5, maxDepth=4)
    return learners.pipeline(one, inputs)


def small_boost(name: str, label: str, inputs: list[str]):
    one = learners.learners(label)[name]
    one.regressor._set(maxIter=4, maxDepth=3)
    return learners.pipeline(one, inputs)


@query()
def forest_importances(spark: SparkSession, sf: str) -> DataFrame:
    fitted = small_forest(LABEL, TREE_INPUTS).fit(model_rows(spark, sf))
    return learners.importances(fitted, TREE_INPUTS)


@query()
def boosting_importances(spark: SparkSession, sf: str) -> DataFrame:
    """Importances under the four boosted-tree presets."""
    rows = model_rows(spark, sf)
    tables = None
    for name in ("GradientBoosting", "HistogramBoosting", "OrderedBoosting", "LeafwiseBoosting"):
        fitted = small_boost(name, LABEL, TREE_INPUTS).fit(rows)
        table = learners.importances(fitted, TREE_INPUTS).withColumn("model", F.lit(name))
        tables = table if tables is None else tables.unionByName(table)
    return tables


@query()
def random_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two of the settings of a small forest grid, by cross-validated error."""
    rows = model_rows(spark, sf)
    folded, folds = split.add_folds(rows, "sector")
    one = learners.learners(LABEL, smoke=True)["RandomForest"]
    grid = {"numTrees": [4, 8], "maxDepth": [2, 4], "featureSubsetStrategy": ["sqrt", "0.5"]}
    searched = learners.Learner(one.name, one.regressor, grid)
    fit = learners.fit_learner(searched, folded, LABEL, TREE_INPUTS, folds, draws=2)
    return spark.createDataFrame(
        [(str(fit.settings), float(fit.cv_mse), len(learners.draw_settings(grid, 2)))],
        "settings string, cv_mse double, n_draws int",
    )


SPLIT_INPUTS = ["reporting_year", "revenue_missing"]


def _split_sql(name: str, rows: str, target: str) -> list[str]:
    """The best single split of ``rows`` by squared error, with both means, as subqueries."""
    return [
        f"""{name}_cut AS (
  SELECT feature, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 AS threshold
  FROM (SELECT DISTINCT 'reporting_year' AS feature, reporting_year AS x FROM {rows}
        UNION SELECT DISTINCT 'revenue_missing', revenue_missing FROM {rows})
  QUALIFY threshold IS NOT NULL)""",
        f"""{name} AS (
  SELECT feature, threshold, avg({target}) FILTER (x <= threshold) AS low_mean,
         avg({target}) FILTER (x > threshold) AS high_mean
  FROM {name}_cut JOIN (
    SELECT 'reporting_year' AS feature, reporting_year AS x, {target} FROM {rows}
    UNION ALL SELECT 'revenue_missing', revenue_missing, {target} FROM {rows}) USING (feature)
  GROUP BY feature, threshold
  ORDER BY count(*) FILTER (x <= threshold) * low_mean ** 2
         + count(*) FILTER (x > threshold) * high_mean ** 2 DESC LIMIT 1)""",
    ]


_SPLIT_ROWS = f"""split_rows AS MATERIALIZED (
  SELECT CAST(reporting_year AS DOUBLE) AS reporting_year, {LABEL} AS y,
         CAST(revenue IS NULL AS DOUBLE) AS revenue_missing FROM logged WHERE {LABEL} IS NOT NULL)"""


@query(
    S.on_panel(
        """SELECT feature, threshold, round(low_mean, 6) AS low_mean, round(high_mean, 6) AS high_mean
           FROM first""",
        _LOGGED, _SPLIT_ROWS, *_split_sql("first", "split_rows", "y"),
    )
)
def single_split(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of one tree of depth one: the split with the least squared error."""
    one = learners.learners(LABEL)["RandomForest"]
    one.regressor._set(numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False)
    fitted = learners.pipeline(one, SPLIT_INPUTS).fit(model_rows(spark, sf))
    low, high = sorted(attribution.tree_leaves(fitted.stages[-1]), key=lambda leaf: leaf.lo)
    row = (SPLIT_INPUTS[low.features[0]], low.hi[0], low.value, high.value)
    found = spark.createDataFrame([row], "feature string, threshold double, low_mean double, high_mean double")
    return rounded(found, ["low_mean", "high_mean"])


def _side(name: str) -> str:
    return (
        f"CASE WHEN CASE {name}.feature WHEN 'reporting_year' THEN r.reporting_year "
        f"ELSE r.revenue_missing END <= {name}.threshold THEN {name}.low_mean ELSE {name}.high_mean END"
    )


# --- histogram trees ---------------------------------------------------------------------

STEP_INPUTS = ["reporting_year", "revenue_missing", "cap_step"]
_STEP_ROWS = f"""step_rows AS MATERIALIZED (
  SELECT {BITS_SQL} AS id, CAST(reporting_year AS DOUBLE) AS reporting_year, {LABEL} AS y,
         CAST(revenue IS NULL AS DOUBLE) AS revenue_missing, floor(2 * coalesce(log_market_cap, 0)) AS cap_step
  FROM logged WHERE {LABEL} IS NOT NULL)"""
_CUTS = "cuts AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS feature, x, (x + lead(x) OVER (ORDER BY x)) / 2 AS threshold
        FROM (SELECT DISTINCT {c} AS x FROM step_rows)"""
    for i, c in enumerate(STEP_INPUTS)
) + ")"


def step_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with three features of few values, and the key bits that order them."""
    rows = model_rows(spark, sf).withColumn("cap_step", F.floor(2 * F.col("log_market_cap")).cast("double"))
    return rows.withColumn("id", key_bits([F.col(k) for k in vocab.KEYS], vocab.SEED))


def _soft(g: str, alpha: float) -> str:
    return f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"


def _gain_sql(name: str, rows: str, alpha: float, penalty: float) -> str:
    """(leaf, feature, threshold, gain) of every possible split of ``rows`` (leaf, g, features)."""
    part = lambda g, h: f"{_soft(g, alpha)} ** 2 / ({h} + {penalty})"
    long = " UNION ALL ".join(f"SELECT leaf, {i} AS feature, {c} AS x, g FROM {rows}" for i, c in enumerate(STEP_INPUTS))
    return f"""{name} AS MATERIALIZED (
  SELECT leaf, feature, threshold, {part("gl", "hl")} + {part("(gt - gl)", "(ht - hl)")} - {part("gt", "ht")} AS gain
  FROM (SELECT leaf, feature, x, sum(g) OVER below AS gl, sum(h) OVER below AS hl,
               sum(g) OVER (PARTITION BY leaf, feature) AS gt, sum(h) OVER (PARTITION BY leaf, feature) AS ht
        FROM (SELECT leaf, feature, x, sum(g) AS g, count(*) AS h FROM ({long}) GROUP BY ALL)
        WINDOW below AS (PARTITION BY leaf, feature ORDER BY x))
  JOIN cuts USING (feature, x) WHERE threshold IS NOT NULL AND hl < ht)"""


_FEATURE_VALUE = "CASE s.feature " + " ".join(f"WHEN {i} THEN r.{c}" for i, c in enumerate(STEP_INPUTS)) + " END"


def _grown_sql(steps: int, pick: str, alpha: float, penalty: float) -> list[str]:
    """Subqueries that grow a tree: each step applies the splits that ``pick`` chooses."""
    parts = ["r0 AS MATERIALIZED (SELECT '' AS leaf, *, avg(y) OVER () - y AS g FROM step_rows)"]
    for k in range(steps):
        parts += [
            _gain_sql(f"gains{k}", f"r{k}", alpha, penalty),
            f"s{k} AS MATERIALIZED (SELECT * FROM gains{k} WHERE gain > 1e-9 {pick})",
            f"""r{k + 1} AS MATERIALIZED (
              SELECT r.leaf || CASE WHEN s.leaf IS NULL THEN '' WHEN {_FEATURE_VALUE} <= s.threshold THEN 'L' ELSE 'R' END AS leaf,
                     r.* EXCLUDE (leaf) FROM r{k} r LEFT JOIN s{k} s ON r.leaf = s.leaf)""",
        ]
    return parts


_LEAF_BEST = "QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, feature, threshold) = 1"
_BEST = "ORDER BY gain DESC, leaf, feature, threshold LIMIT 1"


def _tree_sql(steps: int, alpha: float, penalty: float, rate: float) -> str:
    splits = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(steps))
    return f"""SELECT leaf AS path, feature, threshold, CAST(NULL AS DOUBLE) AS weight FROM ({splits})
      UNION ALL SELECT leaf, -1, 0.0, round(-{rate} * {_soft("sum(g)", alpha)} / (count(*) + {penalty}), 6)
      FROM r{steps} GROUP BY leaf"""


def tree_table(model: PipelineModel) -> DataFrame:
    """The first tree as (path, feature, threshold, weight); the weight of leaves only."""
    tree = model.stages[-1].nodes().query("tree == 0").set_index("node")
    rows, open_nodes = [], [(0, "")]
    while open_nodes:
        node, path = open_nodes.pop()
        one = tree.loc[node]
        leaf = one["feature"] < 0
        rows.append((path, int(one["feature"]), float(one["threshold"]), round(float(one["value"]), 6) if leaf else None))
        if not leaf:
            open_nodes += [(int(one["left"]), path + "L"), (int(one["right"]), path + "R")]
    schema = "path string, feature int, threshold double, weight double"
    return SparkSession.active().createDataFrame(rows, schema)


def _one_tree(spark: SparkSession, sf: str, name: str, **settings) -> DataFrame:
    one = learners.learners(LABEL)[name]
    one.regressor._set(maxIter=1, **settings)
    return tree_table(learners.pipeline(one, STEP_INPUTS).fit(step_rows(spark, sf)))


@query(S.on_panel(_tree_sql(2, 40.0, 5.0, 0.3), _LOGGED, _STEP_ROWS, _CUTS, *_grown_sql(2, _LEAF_BEST, 40.0, 5.0)))
def regularised_splits(spark: SparkSession, sf: str) -> DataFrame:
    """One round of regularised histogram boosting, depth two, with both penalties."""
    return _one_tree(spark, sf, "HistogramBoosting", maxDepth=2, alpha=40.0, lambda_=5.0, stepSize=0.3)


@query(S.on_panel(_tree_sql(3, 0.0, 1.0, 0.1), _LOGGED, _STEP_ROWS, _CUTS, *_grown_sql(3, _BEST, 0.0, 1.0)))
def leafwise_splits(spark: SparkSession, sf: str) -> DataFrame:
    """One leaf-wise tree with a budget of four leaves: the best leaf is split first."""
    return _one_tree(spark, sf, "LeafwiseBoosting", numLeaves=4, lambda_=1.0, minInstancesPerNode=1)


def _level_sql(k: int, penalty: float) -> list[str]:
    return [
        _gain_sql(f"gains{k}", f"r{k}", 0.0, penalty),
        f"""s{k} AS MATERIALIZED (SELECT feature, threshold, sum(greatest(gain, 0)) AS total FROM gains{k}
              GROUP BY feature, threshold ORDER BY total DESC, feature, threshold LIMIT 1)""",
        f"""r{k + 1} AS MATERIALIZED (SELECT r.leaf || CASE WHEN {_FEATURE_VALUE} <= s.threshold THEN 'L' ELSE 'R' END AS leaf,
              r.* EXCLUDE (leaf) FROM r{k} r, s{k} s)""",
    ]


@query(
    S.on_panel(
        """SELECT id, round(mean - 0.5 * coalesce(sum(g) OVER whole / (count(*) OVER whole + 3.0), 0), 6) AS plain,
                  round(mean - 0.5 * coalesce(sum(g) OVER before / (count(*) OVER before + 3.0), 0), 6) AS ordered
           FROM (SELECT *, g + y AS mean FROM r2)
           WINDOW whole AS (PARTITION BY leaf),
                  before AS (PARTITION BY leaf ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        _LOGGED, _STEP_ROWS, _CUTS,
        "r0 AS MATERIALIZED (SELECT '' AS leaf, *, avg(y) OVER () - y AS g FROM step_rows)",
        *_level_sql(0, 3.0), *_level_sql(1, 3.0),
    )
)
def ordered_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """A two-level symmetric tree, and what each row sees of it: the weight its leaf has from all
    rows, and from the rows before it in the order of the key bits."""
    rows = VectorAssembler(inputCols=STEP_INPUTS, outputCol="features").transform(step_rows(spark, sf))
    one = learners.learners(LABEL)["OrderedBoosting"].regressor
    one._set(maxIter=1, maxDepth=2, stepSize=0.5, lambda_=3.0, orderCol="id")
    made = one.booster(rows)[0]
    one.trees(made)
    return made.rows().select("id", F.round("plain", 6).alias("plain"), F.round("ordered", 6).alias("ordered"))


# (preset, L2 penalty, fewest rows of a leaf, gradients from the rows before)
HISTOGRAM_STUMPS = [
    ("HistogramBoosting", 1.0, 1, False), ("OrderedBoosting", 3.0, 1, True), ("LeafwiseBoosting", 0.0, 20, False),
]
BOOSTED = ["GradientBoosting", *[name for name, *_ in HISTOGRAM_STUMPS]]


def _stumps_sql(name: str, penalty: float, least: int, ordered: bool) -> list[str]:
    """Subqueries of two rounds of penalised stumps: the rows with their predictions in ``{name}2``."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT *, avg(y) OVER () AS plain, avg(y) OVER () AS seen FROM step_rows)"]
    for k in range(2):
        rows = f"{name}{k}"
        long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, seen - y AS g FROM {rows}" for c in SPLIT_INPUTS)
        weight = lambda at, over: f"0.1 * coalesce(sum({at} - y) OVER {over} / (count(*) OVER {over} + {penalty}), 0)"  # noqa: E731, B023
        parts += [
            f"""{rows}_split AS MATERIALIZED (
  SELECT feature, threshold, gl ** 2 / (nl + {penalty}) + (gt - gl) ** 2 / (n - nl + {penalty}) - gt ** 2 / (n + {penalty}) AS gain
  FROM (SELECT feature, threshold, count(*) FILTER (x <= threshold) AS nl, count(*) AS n,
               coalesce(sum(g) FILTER (x <= threshold), 0) AS gl, sum(g) AS gt
        FROM first_cut JOIN ({long}) USING (feature) GROUP BY feature, threshold)
  WHERE least(nl, n - nl) >= {least} AND gain > 1e-9 ORDER BY gain DESC, feature, threshold LIMIT 1)""",
            f"""{name}{k + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (plain, seen, low), plain - CASE WHEN low IS NULL THEN 0 ELSE {weight("plain", "whole")} END AS plain,
         seen - CASE WHEN low IS NULL THEN 0 ELSE {weight("seen", "before") if ordered else weight("plain", "whole")} END AS seen
  FROM (SELECT r.*, CASE s.feature WHEN 'reporting_year' THEN reporting_year ELSE revenue_missing END <= threshold AS low
        FROM {rows} r LEFT JOIN {rows}_split s ON true)
  WINDOW whole AS (PARTITION BY low),
         before AS (PARTITION BY low ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        ]
    return parts


@query(
    S.on_panel(
        f"""SELECT DISTINCT 'GradientBoosting' AS model, r.reporting_year, r.revenue_missing,
                   round({_side("first")} + 0.1 * {_side("second")}, 6) AS predicted
            FROM split_rows r, first, second"""
        + "".join(
            f" UNION ALL SELECT DISTINCT '{name}', reporting_year, revenue_missing, round(plain, 6) FROM {name}2"
            for name, *_ in HISTOGRAM_STUMPS
        ),
        _LOGGED, _SPLIT_ROWS, *_split_sql("first", "split_rows", "y"),
        # the gradient of the squared error is twice the residual
        f"""rest AS MATERIALIZED (SELECT r.reporting_year, r.revenue_missing,
              2 * (y - ({_side("first")})) AS gradient FROM split_rows r, first)""",
        *_split_sql("second", "rest", "gradient"),
        _STEP_ROWS, *[part for stumps in HISTOGRAM_STUMPS for part in _stumps_sql(*stumps)],
    )
)
def boosting_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of stumps under each boosted preset: the second fits what the first left."""
    rows, tables = step_rows(spark, sf), None
    places = rows.select(*[F.col(c).cast("double").alias(c) for c in SPLIT_INPUTS]).distinct()
    for name in BOOSTED:
        one = learners.learners(LABEL)[name]
        one.regressor._set(maxIter=2, maxDepth=1, stepSize=0.1, subsamplingRate=1.0)
        if name == "GradientBoosting":
            one.regressor._set(featureSubsetStrategy="all")
        if name == "OrderedBoosting":
            one.regressor._set(orderCol="id")
        fitted = learners.pipeline(one, SPLIT_INPUTS).fit(rows)
        table = fitted.transform(places).select(
            F.lit(name).alias("model"), *SPLIT_INPUTS, F.round("prediction", 6).alias("predicted")
        )
        tables = table if tables is None else tables.unionByName(table)
    return tables


@query(
    "SELECT unnest(['GradientBoosting', 'LinearRegression', 'RandomForest']) AS model, 6 AS n_features, "
    "true AS all_sums_right, true AS in_order"
)
def importance_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature has its importance, largest first; those of trees add up to one."""
    rows, found = model_rows(spark, sf), []
    baseline = learners.pipeline(learners.learners(LABEL)["LinearRegression"], TREE_INPUTS)
    plans = {
        "GradientBoosting": small_boost("GradientBoosting", LABEL, TREE_INPUTS),
        "LinearRegression": baseline,
        "RandomForest": small_forest(LABEL, TREE_INPUTS),
    }
    for name, plan in plans.items():
        weights = [r["importance"] for r in learners.importances(plan.fit(rows), TREE_INPUTS).collect()]
        right = name == "LinearRegression" or abs(sum(weights) - 1) < 1e-9
        found.append((name, len(weights), right, weights == sorted(weights, reverse=True)))
    return spark.createDataFrame(found, "model string, n_features int, all_sums_right boolean, in_order boolean")


_LOCAL_ACCURACY = S.on_panel(
    "SELECT count(*) AS n_rows, count(*) AS n_exact FROM panel WHERE scope1_emissions IS NOT NULL"
)


def _local_accuracy(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows whose base and attributions add up to the prediction."""
    explained = attribution.with_row_id(rows)
    long = attribution.attributions(model, explained, TREE_INPUTS)
    sums = long.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("total"))
    both = model.transform(explained).select("row_id", "prediction").join(sums, "row_id")
    exact = F.abs(F.col("total") - F.col("prediction")) < 1e-6
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(exact).alias("n_exact"))


@query(_LOCAL_ACCURACY)
def forest_local_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_rows(spark, sf)
    return _local_accuracy(rows, small_forest(LABEL, TREE_INPUTS).fit(rows))


@query(_LOCAL_ACCURACY)
def boosting_local_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_rows(spark, sf)
    return _local_accuracy(rows, small_boost("GradientBoosting", LABEL, TREE_INPUTS).fit(rows))


@query()
def tree_attribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_rows(spark, sf)
    fitted = small_forest(LABEL, TREE_INPUTS).fit(rows)
    return attribution.attributions(fitted, attribution.with_row_id(rows), TREE_INPUTS)


SMALL = {
    "RandomForest": {"numTrees": 4, "maxDepth": 4, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"},
    "GradientBoosting": {
        "maxIter": 3, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0, "minInstancesPerNode": 1,
    },
}


def _clean_features(spark: SparkSession, sf: str, group_means: bool = False) -> DataFrame:
    return materialise(features(clean(make_panel(spark, sf)), fit_group_means=group_means), "features")


@query()
def train_models(spark: SparkSession, sf: str) -> DataFrame:
    """The training job for scope 1: baseline, a small forest and small boosted trees."""
    folder = stage_path(spark, "models")
    results = jobs.train(
        _clean_features(spark, sf), folder, [vocab.SCOPE1],
        ["LinearRegression", "RandomForest", "GradientBoosting"], smoke=True, overrides=SMALL,
    )
    return results.drop("model_path")


@query()
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-sector metrics of the best stored model on its held-out rows."""
    folder = stage_path(spark, "models")
    jobs.train(_clean_features(spark, sf), folder, [vocab.SCOPE1], ["LinearRegression"])
    return jobs.evaluate(spark, folder, [vocab.SCOPE1])[vocab.SCOPE1]["by_sector"]


@query()
def score_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """All panel rows scored with the stored models of both targets."""
    folder = stage_path(spark, "models")
    cleaned = materialise(clean(make_panel(spark, sf)), "clean")
    encoders = fit_encoders(cleaned)
    table = materialise(features(cleaned, encoders=encoders), "features")
    jobs.train(table, folder, names=["LinearRegression"])
    scored = jobs.score_companies(cleaned.select(*KEYED, *vocab.CATEGORICAL, *vocab.NUMERIC), folder, encoders)
    return scored.drop("feature_values")


@query()
def explain_models(spark: SparkSession, sf: str) -> DataFrame:
    """Stored attributions of the best scope 1 model for every held-out row."""
    folder = stage_path(spark, "models")
    jobs.train(
        _clean_features(spark, sf), folder, [vocab.SCOPE1], ["RandomForest"], smoke=True, overrides=SMALL,
    )
    return jobs.explain(spark, folder, [vocab.SCOPE1])[vocab.SCOPE1]


@query(
    S.on_panel(
        """SELECT 'box_scope1_emissions' AS name, count(DISTINCT sector) AS n_rows FROM clean
           UNION ALL SELECT 'distribution_scope1_emissions', 50
           UNION ALL SELECT 'distribution_scope2_emissions', 50
           UNION ALL SELECT 'missing', 0
           UNION ALL SELECT 'pairs', least(300, count(*)) FROM clean
           UNION ALL SELECT 'revenue_vs_scope1', count(*) FROM clean WHERE revenue > 0 AND scope1_emissions > 0
           UNION ALL SELECT 'sector_medians', count(DISTINCT sector) FROM clean""",
        *S.CLEAN,
    )
)
def exploration_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The exploration job: rows of some of the tables it writes."""
    folder = stage_path(spark, "exploration")
    names = write_exploration(materialise(clean(make_panel(spark, sf)), "clean"), folder)
    shown = [
        "box_scope1_emissions", "distribution_scope1_emissions", "distribution_scope2_emissions",
        "missing", "pairs", "revenue_vs_scope1", "sector_medians",
    ]
    rows = [(name, read_table(spark, f"{folder}/{name}").count()) for name in shown if name in names]
    return spark.createDataFrame(rows, "name string, n_rows long")
