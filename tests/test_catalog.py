import pathlib
import sys
from multiprocessing.pool import ThreadPool

import pytest
from conftest import plan_of
from pyspark.util import inheritable_thread_target

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402

from fumarole.catalog import load  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")

#: Query results whose plan may hold a Python node: tree attribution runs in pandas batches.
PANDAS = {"forest_local_accuracy", "boosting_local_accuracy"}


@pytest.fixture(scope="module")
def duck():
    con = check_oracle.connect(SF)
    yield con
    con.close()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


@pytest.fixture(scope="module")
def answers(spark):
    """Columns, plan and rows of every checked query, run side by side."""

    def run(name):
        try:
            df = entry.queries()[name](spark, SF)
            return df.columns, plan_of(df), [tuple(r) for r in df.collect()]
        except Exception as err:  # noqa: BLE001 - reported by the query's own test
            return err

    names = sorted(load().SQL)
    with ThreadPool(6) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(spark)(run), names, chunksize=1)))


@pytest.mark.parametrize("name", sorted(load().SQL))
def test_query_equals_sql(answers, duck, name):
    if isinstance(answers[name], Exception):
        raise answers[name]
    columns, plan, rows = answers[name]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert name in PANDAS or "InPandas" not in plan
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(columns) == sorted(names)
    assert check_oracle.rows_of(columns, rows) == check_oracle.rows_of(names, result.fetchall())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["scope1_emissions"] > 0 for r in rows)


def test_panel_scans_only_what_it_needs(spark):
    plan = plan_of(entry.queries()["panel"](spark, SF).select("company_name", "revenue"))
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert all("l_extendedprice" not in s and "l_tax" not in s for s in lineitem)
    assert all("o_orderpriority" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    plan = plan_of(entry.queries()["indicator_pivot"](spark, SF))
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull(value), In(event_type" in plan


def test_two_rounds_cover_every_boosted_preset(answers, duck):
    if isinstance(answers["boosting_two_rounds"], Exception):
        raise answers["boosting_two_rounds"]
    columns, _, rows = answers["boosting_two_rounds"]
    presets = {"GradientBoosting", "HistogramBoosting", "OrderedBoosting", "LeafwiseBoosting"}
    at = columns.index("model")
    assert {row[at] for row in rows} == presets
    named = duck.execute(f"SELECT DISTINCT model FROM ({entry.oracle_sql()['boosting_two_rounds']})").fetchall()
    assert {name for name, in named} == presets
    of = {(r["model"], r["reporting_year"], r["revenue_missing"]): r["predicted"] for r in (dict(zip(columns, r)) for r in rows)}
    # the presets differ in penalty and gradients, so their figures are their own
    assert len({round(sum(v for k, v in of.items() if k[0] == name), 6) for name in presets}) == len(presets)
