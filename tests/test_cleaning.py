import random
from collections import Counter

import numpy as np
import pytest
from conftest import companies, plan_of
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.operators import cleaning
from fumarole.operators.dedup import most_complete
from fumarole.plans.clean import clean
from fumarole.sources import schemas
from fumarole.sources.dimensions import country_macro


def test_most_complete_row_wins(spark):
    rows = [("a", 2020, None, None), ("a", 2020, 1.0, None), ("a", 2020, 1.0, "x"), ("a", 2021, None, None), (None, 2020, 1.0, "y"), (None, 2020, None, "y")]
    df = spark.createDataFrame(rows, "company_name string, reporting_year int, v double, w string")
    assert set(map(tuple, most_complete(df).collect())) == {rows[2], rows[3], rows[4]}


def test_equal_completeness_takes_the_smallest_row(spark):
    rows = [("a", 2020, 2.0, "x"), ("a", 2020, 1.0, "z"), ("a", 2020, 1.0, "y")]
    df = spark.createDataFrame(rows, "company_name string, reporting_year int, v double, w string")
    for parts in (1, 3):
        assert [tuple(r) for r in most_complete(df.repartition(parts)).collect()] == [rows[2]]


def test_copies_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2020, 1.0)] * 50, "company_name string, reporting_year int, v double")
    plan = plan_of(most_complete(df))
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in plan[plan.index(line):] for line in limits) and len(limits) >= 2


def test_sector_rules(spark):
    texts = [" energy ", "ENERGY", "Crypto", None, "Utilities", "utilities", "Materials"]
    df = spark.createDataFrame([(t,) for t in texts], "sector string").coalesce(1)
    got = Counter(r[0] for r in cleaning.validate_sectors(df).collect())
    # Energy and Utilities tie, the smaller name replaces the unknown text
    assert got == {"Energy": 3, "Utilities": 2, "Materials": 1, None: 1}


def test_no_recognised_sector(spark):
    df = spark.createDataFrame([("Crypto",), (None,)], "sector string")
    rows = cleaning.validate_sectors(df)
    assert [r[0] for r in rows.collect()] == [None, None]
    assert cleaning.fit_fill(rows, numeric=[])["sector"] == "Unknown"


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "revenue double")
    for step in (cleaning.normalise_names, cleaning.validate_sectors, cleaning.normalise_countries):
        assert step(df).columns == ["revenue"]
    assert cleaning.add_flags(df).columns == ["revenue", "revenue_missing"]
    assert cleaning.fit_fill(df) == {"revenue": 2.5}


def test_logs_only_where_absent(spark):
    df = spark.createDataFrame([(9.0, -1.0)], "revenue double, log_revenue double")
    assert cleaning.add_logs(df, overwrite=False).first()["log_revenue"] == -1.0
    assert cleaning.add_logs(df).first()["log_revenue"] == pytest.approx(np.log(10))


def raw(spark, n=300):
    df = companies(spark, n)
    messy = df.withColumn("sector", F.when(F.length("company_name") % 7 == 0, F.lit("Crypto")).otherwise(F.upper("sector")))
    return messy.join(country_macro(spark), "country").select(*schemas.MERGED.names)


def test_clean_equals_pandas(spark):
    merged = raw(spark).cache()
    doubled = merged.unionByName(merged.withColumn("revenue", F.lit(None).cast("double")))
    got = clean(doubled).toPandas().set_index("company_name_raw").sort_index()
    want = merged.toPandas().set_index("company_name").sort_index()
    assert list(got.reset_index()[schemas.CLEAN.names].columns) == schemas.CLEAN.names and len(got) == len(want)
    known = {s.lower(): s for s in vocab.SECTORS}
    sector = want["sector"].str.lower().map(known)
    want["sector"] = sector.fillna(sector.mode().iloc[0])
    for c in vocab.FLAGGED:
        assert (got[f"{c}_missing"] == want[c].isna().astype(int)).all()
        want[c] = want[c].fillna(want[c].median())
        want[c] = want[c].clip(want[c].quantile(0.01), want[c].quantile(0.99))
        np.testing.assert_allclose(got[c], want[c], rtol=1e-12)
        log = vocab.LOG_OF.get(c, f"log_{c}")
        np.testing.assert_allclose(got[log], np.log1p(want[c].clip(lower=0)), rtol=1e-12)
    want["industry"] = want["industry"].fillna(want["industry"].mode().iloc[0])
    for c in vocab.CATEGORICAL:
        assert (got[c] == want[c]).all()


def test_targets_may_stay_missing(spark):
    merged = raw(spark, 40).withColumn("scope1_emissions", F.lit(None).cast("double"))
    rows = clean(merged, impute_targets=False)
    assert rows.where("scope1_emissions is not null or log_scope1_emissions is not null").count() == 0


def test_second_dedup_merges_names_that_collide(spark):
    merged = raw(spark, 6)
    two = merged.unionByName(merged.withColumn("company_name", F.concat("company_name", F.lit(" Holdings"))))
    assert clean(two).count() == 12 and clean(two, second_dedup=True).count() == 6


def test_changed_names(spark):
    draw = random.Random(1)
    names = [f"n{i} {draw.choice(['Inc', 'x'])}" for i in range(50)]
    df = cleaning.normalise_names(spark.createDataFrame([(n,) for n in names], "company_name string"))
    assert cleaning.changed_names(df).first()[0] == sum(n.endswith("Inc") for n in names)
