import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from fumarole import vocab  # noqa: E402
from fumarole.catalog.panel import panel  # noqa: E402
from fumarole.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plan_of(df):
    """The formatted physical plan as text."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def companies(spark, n):
    """The first company-years of the driver tables, with sectors and countries in full spelling."""

    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("ticker").cast("int") % len(values))

    rows = panel(spark, SF).orderBy(F.col("ticker").cast("int"), "reporting_year").limit(n)
    return rows.withColumns(
        {"sector": pick(vocab.SECTORS), "country": pick([c[0] for c in vocab.COUNTRIES])}
    )
