import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fumarole.operators import quantiles as q


def table(spark, seed, n, ties):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = draw.choice([1.0, 2.0, 5.0]) if ties and draw.random() < 0.6 else draw.gauss(0, 100)
        rows.append((draw.choice(["a", "b", None]), None if draw.random() < 0.1 else x, float(i)))
    return spark.createDataFrame(rows, "g string, x double, y double")


@pytest.mark.parametrize(
    "n, ties, levels, few",
    [
        (1, False, q.LEVELS, q.FEW_VALUES),
        (2, True, q.LEVELS, 1),
        (500, True, q.LEVELS, q.FEW_VALUES),
        (3000, False, q.LEVELS, 10),
        (7, False, (62, 40, 0), 3),
        (400, True, (60, 56, 52, 44, 0), 3),
    ],
)
def test_quantiles_equal_numpy(spark, n, ties, levels, few):
    df = table(spark, n, n, ties)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    rows = df.collect()
    for by, most in (([], 0), (["g"], q.SMALL_ROWS), (["g"], 0)):
        got = q.quantile_table(df, ["x", "y"], probs, by=by, levels=levels, few=few, max_rows=most).collect()
        groups = {tuple(r[b] for b in by) for r in rows}
        assert {tuple(r[b] for b in by) for r in got} == groups and len(got) == len(groups)
        for r in got:
            for c in ("x", "y"):
                own = [x[c] for x in rows if x[c] is not None and all(x[b] == r[b] for b in by)]
                if own:
                    assert r[c] == pytest.approx(list(np.quantile(own, probs)))
                else:
                    assert r[c] is None


def test_widest_range_nan_and_one_hot_group(spark):
    values = [(0, v) for v in (-1.7e308, 1.7e308, 0.0, 5e-324, 1.0, float("nan"), None)]
    values += [(1, float(i % 7) ** 9) for i in range(5000)] + [(2, 4.0)]
    df = spark.createDataFrame(values, "g int, x double")
    for most in (0, q.SMALL_ROWS):
        table = q.quantile_table(df, ["x"], [0.25, 0.5], by=["g"], levels=(60, 55, 50, 25, 0), few=2, max_rows=most)
        got = {r["g"]: r["x"] for r in table.collect()}
        assert got[0] == [0.0, 5e-324] and got[2] == [4.0, 4.0]
        assert got[1] == list(np.quantile([float(i % 7) ** 9 for i in range(5000)], [0.25, 0.5]))


def test_quantiles_match_numpy(spark):
    values = [3.0, 1.0, 10.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = q.quantile_values(df, ["x"], [0.01, 0.5, 0.99])["x"]
    assert got == pytest.approx(list(np.quantile(values, [0.01, 0.5, 0.99])))
    assert q.medians(df, ["x"], approx=True)["x"] in values


def test_all_null_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert q.medians(df, ["x", "y"]) == {"x": None, "y": 1.0}


def test_mode_ties_and_gaps(spark):
    df = spark.createDataFrame(
        [("b", None), ("b", None), ("a", None), ("a", None), (None, None)], "x string, y string"
    )
    assert q.modes(df, ["x", "y"]) == {"x": "a", "y": None}


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "x double")
    edges = q.bin_edges(df, "x", 5)
    got = df.withColumn("bin", q.bin_of(F.col("x"), edges)).collect()
    assert [r["bin"] for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]


def test_tied_edges_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "x double")
    edges = q.bin_edges(df, "x", 5)
    bins = {r["x"]: r["bin"] for r in df.withColumn("bin", q.bin_of(F.col("x"), edges)).collect()}
    assert len(edges) == 3 and bins[1.0] == 0 and bins[3.0] == 1
    assert q.bin_edges(df.where("x = 1"), "x", 5) == [1.0]


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, 0.1,
       -1.0, 4096.0, 4095.9999999999995, float("inf"), float("-inf"), 1e22, -1e-300]


def test_keys_keep_order_and_come_back(spark):
    draw = random.Random(11)
    values = ODD + [draw.uniform(-1, 1) * 10.0 ** draw.randint(-320, 308) for _ in range(3000)]
    values += [2.0**e for e in range(-1074, 1024)] + [np.nextafter(2.0**e, 0) for e in range(-1000, 1024)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = q.bit_keys(df, {"k": F.col("x")}, ["x"]).withColumn("back", q.key_value(F.col("k"))).collect()
    assert all(r["back"] == r["x"] and q.plain_value(r["k"]) == r["x"] for r in rows)
    ordered = sorted(rows, key=lambda r: r["k"])
    assert [r["x"] for r in ordered] == sorted(r["x"] for r in rows)
    assert len({r["k"] for r in rows}) == len({r["x"] for r in rows})
    gone = q.bit_keys(spark.createDataFrame([(None,), (float("nan"),)], "x double"), {"k": F.col("x")})
    assert [r["k"] for r in gone.collect()] == [None, None]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_infinities_and_denormals_are_values(spark, by):
    draw = random.Random(7)
    values = [float("inf")] + [float("-inf")] * 3 + ODD + [draw.gauss(0, 1) for _ in range(6000)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, x double")
    probs = [0.0, 0.0001, 0.25, 0.5, 0.9, 1.0]
    got = q.quantile_table(df, ["x"], probs, by=by, few=50).first()["x"]
    ranked = sorted(values)
    for p, v in zip(probs, got):
        at = (len(values) - 1) * p
        a, b = ranked[int(np.floor(at))], ranked[int(np.ceil(at))]
        assert v == pytest.approx(a if a == b else a + (b - a) * (at - np.floor(at)))
    both = spark.createDataFrame([(1, float("inf")), (1, float("-inf"))], "g int, x double")
    assert q.quantile_table(both, ["x"], [0.5], by=by).first()["x"] == [None]


def test_rounds_are_bounded(spark, monkeypatch):
    """The worst case, values that share all but their last bits, takes one round a level."""
    rounds = []
    real = q._counted
    monkeypatch.setattr(q, "_counted", lambda *a: rounds.append(a[2]) or real(*a))
    near = [1.0 + i * 2.0**-52 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in near], "x double")
    assert q.medians(df.withColumn("y", F.col("x")), ["x"]) == {"x": float(np.median(near))}
    assert rounds == [48, 0]  # few enough values: one round and the count by value
    rounds.clear()
    assert q.quantile_table(df, ["x"], [0.5], few=1).first()["x"] == [float(np.median(near))]
    assert rounds == list(q.LEVELS) and all(a - b <= 12 for a, b in zip(q.LEVELS, q.LEVELS[1:]))
