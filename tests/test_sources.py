import pytest
from conftest import companies
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumarole import vocab
from fumarole.operators.cleaning import normalise_countries
from fumarole.plans.ingest import ingest, merge_sources
from fumarole.sources import files, indicators, schemas
from fumarole.sources.dimensions import country_aliases, country_macro, sector_industry, sector_profile


def test_missing_csv_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_csv(spark, str(tmp_path / "none.csv"), schemas.EMISSIONS)


def test_csv_columns_by_name_and_missing_texts(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(
        'scope1_emissions,company_name,reporting_year,note\n1.5,"A ""x"", Inc",2021.0,keep\nNaN,N/A,,\n'
    )
    df = files.read_csv(spark, str(path), schemas.EMISSIONS)
    assert dict(df.dtypes) == {
        "scope1_emissions": "double", "company_name": "string", "reporting_year": "int", "note": "string",
    }
    assert [tuple(r) for r in df.collect()] == [(1.5, 'A "x", Inc', 2021, "keep"), (None, None, None, None)]


def test_missing_emissions_raise(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.load_emissions(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_line_breaks_in_cells(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    rows = [("one\ntwo", 1), ('say "hi",\n', 2), (" padded ", None)]
    files.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "t"))
    read = files.read_csv(spark, str(tmp_path / "t"), schema, multi_line=True)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 2020)], "company_name string, reporting_year int")
    with pytest.raises(ValueError, match="scope1_emissions"):
        files.emissions_summary(df)


def test_financials_absent_or_by_ticker(spark, tmp_path):
    assert files.load_financials(spark, str(tmp_path / "no")).count() == 0
    assert files.load_financials(spark, None).schema == schemas.FINANCIALS
    path = str(tmp_path / "fin")
    rows = [("T1", 1.0), ("T2", 2.0)]
    files.write_csv(spark.createDataFrame(rows, "ticker string, revenue double"), path)
    assert files.load_financials(spark, path, ["T2"]).collect()[0]["revenue"] == 2.0


def test_latest_indicator_per_country(spark):
    rows = [
        ("USA", "NY.GDP.PCAP.CD", 2019, 1.0), ("USA", "NY.GDP.PCAP.CD", 2021, 2.0),
        ("USA", "NY.GDP.PCAP.CD", 2022, None), ("FRA", "EG.USE.PCAP.KG.OE", 2020, 3.0),
        ("DEU", "OTHER", 2020, 9.0),
    ]
    long = spark.createDataFrame(rows, schemas.INDICATORS_LONG)
    want = {("USA", 2.0, None), ("FRA", None, 3.0)}
    for table in (indicators.latest_wide(long), indicators.outer_wide(long)):
        assert {tuple(r) for r in table.select("country", *vocab.MACRO).collect()} == want


def test_narrow_types(spark):
    rows = [(1, 300, 70_000, 1.5, 1e-30, None), (2, -5, 1, 0.1, 1e300, None)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d double, e double, f bigint")
    kinds = dict(files.narrow_types(df).dtypes)
    assert kinds == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float", "e": "double", "f": "bigint"}


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in files.nulls_only(df).collect()] == [None, 1.0]


def test_dimension_sizes(spark):
    assert sector_profile(spark).count() == 11 and sector_industry(spark).count() == 44


def test_country_texts(spark):
    cases = {
        "US": "USA", "usa": "USA", " Germany ": "DEU", "ZZ": "ZZ", "Atlantis": "ATL", None: None,
        "840": "USA", "korea, republic of": "KOR", "Tschland": "TSC", "fr": "FRA",
    }
    df = spark.createDataFrame([(c,) for c in cases], "country string")
    got = [r[0] for r in normalise_countries(df.coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted(cases.values(), key=str)


def test_own_aliases_win(spark):
    extra = spark.createDataFrame([("Atlantis", "ATX"), ("us", "USX")], "alias string, code string")
    table = country_aliases(spark, extra)
    found = {r["alias"]: r["code"] for r in table.where("alias in ('us', 'atlantis', 'fr')").collect()}
    assert found == {"us": "USX", "atlantis": "ATX", "fr": "FRA"}
    assert table.groupBy("alias").count().where("count > 1").count() == 0


def test_ingest_landed_files(spark, tmp_path):
    made = companies(spark, 30)
    files.write_csv(made, str(tmp_path / "e"))
    files.write_csv(country_macro(spark), str(tmp_path / "i"))
    merged = ingest(spark, str(tmp_path / "e"), str(tmp_path / "none"), str(tmp_path / "i"))
    assert merged.columns == schemas.MERGED.names and merged.count() == 30
    assert merged.where("gdp_per_capita is null").count() == 0
    assert files.emissions_summary(made).first()["n_rows"] == 30


def test_country_order_of_merge(spark):
    rows = spark.createDataFrame([("a", 2020, "US", 1.0, 1.0)], "company_name string, reporting_year int, country string, scope1_emissions double, scope2_emissions double")
    macro = country_macro(spark)
    assert merge_sources(rows, None, macro).first()["gdp_per_capita"] == 76330.0
    late = merge_sources(rows, None, macro, normalise_first=False)
    assert late.first()["gdp_per_capita"] is None
    spelled = spark.createDataFrame(
        [("US", 1.0, None), ("840", 2.0, 5.0), ("Germany", 3.0, 3.0)],
        "country string, gdp_per_capita double, energy_intensity double",
    )
    found = merge_sources(rows, None, spelled).collect()
    assert [(r["country"], r["gdp_per_capita"], r["energy_intensity"]) for r in found] == [("USA", 2.0, 5.0)]


def test_latest_value_of_one_year_does_not_depend_on_order(spark):
    rows = [("USA", "NY.GDP.PCAP.CD", 2020, v) for v in (1.0, 2.0, 0.5)]
    for order in (rows, rows[::-1]):
        long = spark.createDataFrame(order, schemas.INDICATORS_LONG)
        for table in (indicators.latest_wide(long), indicators.outer_wide(long)):
            assert table.first()["gdp_per_capita"] == 2.0


def test_aliases_from_a_landed_table(spark):
    extra = spark.createDataFrame(
        [("756", "CHE"), (" 756", "CHX"), ("Swiss Confederation", "che"), (None, "X"), ("y", None)],
        "alias string, code string",
    )
    rows = spark.createDataFrame([("756",), ("swiss confederation",)], "country string")
    assert [r[0] for r in normalise_countries(rows, extra).collect()] == ["CHE", "CHE"]
