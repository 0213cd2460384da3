import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from fumarole import functions as fn
from fumarole import vocab

NAMES = [
    "Acme Inc.", "Acme Inc", "  Global   Systems ", None, "Group", "Co. Ltd. Partners", "Société SA",
    "Income Partners", "A\tB  plc", "corp.x", "Ägypt AG Holdings", "",
]


def key(name):
    bare = re.sub(vocab.COMPANY_SUFFIX, "", name.lower())
    return re.sub(r"\s+", " ", bare.strip())


def test_company_key_follows_the_word_list(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = [r[0] for r in df.select(fn.company_key(F.col("n"))).collect()]
    assert got == [None if n is None else key(n) for n in NAMES]
    assert got[0] == "acme ." and got[1] == "acme" and got[4] == ""


def test_strip_drops_any_white_space(spark):
    df = spark.createDataFrame([("\t a b \n",), (" x ",)], "c string")
    assert [r[0] for r in df.select(fn.strip(F.col("c"))).collect()] == ["a b", "x"]


@pytest.mark.parametrize(
    "n, d, want",
    [(6.0, 3.0, 2.0), (1.0, 0.0, 0.0), (None, 2.0, 0.0), (2.0, None, 0.0), (0.0, 0.0, 0.0), (1e308, 1e-308, 0.0), (-4.0, 2.0, -2.0)],
)
def test_safe_divide(spark, n, d, want):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    assert df.select(fn.safe_divide(F.col("n"), F.col("d"))).first()[0] == want


def test_safe_log1p_clips_and_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,), (9.0,)], "x double")
    got = [r[0] for r in df.select(fn.safe_log1p(F.col("x"))).collect()]
    assert got == [None, 0.0, 0.0, pytest.approx(math.log(10))]


def test_floor_clip_round_and_back_transform(spark):
    row = spark.createDataFrame([(None, 0.125, -3.0)], "a double, b double, c double").select(
        fn.floor_at(F.col("a"), 1.0).alias("floor"),
        fn.round_even(F.col("b"), 2).alias("even"),
        fn.back_transform(F.col("c")).alias("zero"),
        fn.clip(F.col("c"), F.lit(-1.0), F.lit(1.0)).alias("clipped"),
        fn.share_of(F.col("b"), F.lit(0.0)).alias("share"),
        fn.null_nan(F.lit(float("nan"))).alias("nan"),
    ).first()
    assert row["floor"] is None and row["even"] == 0.12 and row["zero"] == 0.0
    assert row["clipped"] == -1.0 and row["share"] is None and row["nan"] is None


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.39,)], "c double")
    got = [r[0] for r in df.select(fn.confidence_band(F.col("c"))).collect()]
    assert got == ["high", "medium", "medium", "low"]


def test_key_bits_are_the_leading_md5_bits(spark):
    df = spark.createDataFrame([("x", 7), (None, 7)], "a string, b int")
    got = [r[0] for r in df.select(fn.key_bits([F.col("a"), F.col("b")], 42)).collect()]
    want = [int(hashlib.md5(t.encode()).hexdigest()[:13], 16) for t in ("42|x|7", "42||7")]
    assert got == want
