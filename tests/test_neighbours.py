import numpy as np
import pytest
from pyspark.sql import functions as F

from fumarole.operators import neighbours as nb


def psi(n):
    """Digamma of whole numbers from their harmonic sums."""
    sums = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, np.max(n) + 1))])
    return sums[np.asarray(n) - 1] - 0.5772156649015329


def brute(x, y, k=3):
    """The estimate from all pairs of rows."""
    dx = np.abs(x[:, None] - x) / x.std()
    dy = np.abs(y[:, None] - y) / y.std()
    far = np.maximum(dx, dy)
    np.fill_diagonal(far, np.inf)
    r = np.sort(far, axis=1)[:, k - 1 : k]
    nx, ny = (((d < r) | ((r == 0) & (d == 0))).sum(1) for d in (dx, dy))
    joint = np.where(r[:, 0] == 0, (far == 0).sum(1) + 1, k)
    return max(0.0, psi(len(x)) + psi(joint).mean() - psi(nx).mean() - psi(ny).mean())


def tied(n, seed=3):
    """Columns with ties, copies, far outliers and very dense places; a target that follows some."""
    rng = np.random.default_rng(seed)
    a = rng.lognormal(0, 3, n)
    a[: n // 3] = 5.0
    year = rng.integers(2015, 2020, n).astype(float)
    grid = rng.integers(-4, 5, n) / 2.0
    y = np.round(np.log1p(a) + rng.normal(0, 0.3, n), 1)
    y[::7] = y[0]
    a[5], y[5] = 1e12, -40.0
    return {"a": a, "year": year, "grid": grid, "noise": rng.normal(0, 1, n)}, y


def frame(spark, columns, y):
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values(), y)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "y"]))


@pytest.mark.parametrize("cell_rows", [64, 4096])
def test_equals_all_pairs_with_ties(spark, cell_rows):
    columns, y = tied(2000)
    got = nb.nearest_information(frame(spark, columns, y), list(columns), "y", cell_rows=cell_rows).collect()
    assert got[0]["column"] == "a" and sum(r["mi"] > 0 for r in got) > 2
    for row in got:
        assert row["mi"] == pytest.approx(brute(columns[row["column"]], y), abs=1e-9), row["column"]
    assert {r["column"] for r in got} == set(columns)


def test_radii_equal_all_pairs(spark):
    columns, y = tied(600, 4)
    found = nb.points(frame(spark, columns, y), ["a", "noise"], "y")
    got = nb.radii(nb.cells_of(found, 8), 3, 8).collect()
    assert len(got) == found.count()
    for name in ("a", "noise"):
        x = columns[name]
        far = np.maximum(np.abs(x[:, None] - x) / x.std(), np.abs(y[:, None] - y) / y.std())
        np.fill_diagonal(far, np.inf)
        want = dict(zip(zip(x, y), np.sort(far, axis=1)[:, 2]))
        for row in got:
            if row["column"] == name:
                assert row["r"] == pytest.approx(want[row["x"], row["y"]], rel=1e-12)


def test_cells_stay_small(spark):
    columns, y = tied(1500)
    placed = nb.cells_of(nb.points(frame(spark, columns, y), list(columns), "y"), 32)
    assert placed.groupBy(*nb.CELL).count().agg({"count": "max"}).first()[0] <= 32


def test_gaps_infinities_copies_and_small_tables(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, 60), rng.normal(0, 1, 60)
    x[:25], y[:25] = 2.0, 3.0  # copies beyond the number of neighbours
    rows = [(float(a), float(b), 7, 1.0) for a, b in zip(x, y)]
    odd = [(None, 1.0, 7, 1.0), (float("inf"), 2.0, 7, 1.0), (float("nan"), 3.0, 7, 1.0), (1.0, None, 7, 1.0), (1.0, float("-inf"), 7, 1.0)]
    df = spark.createDataFrame(rows + odd, "x double, y double, k int, id double")
    got = nb.nearest_information(df, ["x", "k"], "y", cell_rows=8).collect()
    assert [r["column"] for r in got] == ["x"]
    assert got[0]["mi"] == pytest.approx(brute(x, y), abs=1e-9)
    assert nb.nearest_information(df.limit(19), ["x"], "y").count() == 0
    assert nb.nearest_information(df.limit(0), ["x"], "y").count() == 0
    assert nb.nearest_information(df.limit(3), ["x"], "y", min_rows=1).count() == 0


def test_digamma(spark):
    got = spark.range(1, 200).select(nb.digamma(nb.F.col("id").cast("double"))).collect()
    assert np.allclose([r[0] for r in got], psi(np.arange(1, 200)), atol=1e-12, rtol=0)


def test_ends_are_the_last_values_inside():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 500), rng.integers(-4, 5, 500) / 2.0, [0.0, -0.5, 1e12, -1e300]])
    unit = np.full(len(x), 0.7)
    r = np.concatenate([rng.lognormal(-3, 3, 1000), [1e-300, 0.5 / 0.7, 1e-9, 1.0]])
    r[:50] = 0
    got = nb.ends(x, unit, r)
    assert (got[r == 0] == x[r == 0]).all()
    inside = (got - x) / unit < r
    beyond = (np.nextafter(got, np.inf) - x) / unit >= r
    assert (inside | (r == 0)).all() and (got >= x).all() and (beyond | (r == 0)).all()


def test_a_cell_lists_only_boxes_near_it(spark):
    side = 60
    rows = [(float(i), float(j)) for i in range(side) for j in range(side)]
    found = nb.points(spark.createDataFrame(rows, "a double, t double"), ["a"], "t")
    placed = nb.cells_of(found, 16).withColumn("r", 1.5 / F.col("sx"))
    every = placed.groupBy("column", "strip", "cell").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    lists = nb.reached(placed, every).collect()
    got = {(r["strip"], r["cell"]): {(s["strip"], c["cell"]) for s in r["boxes"] for c in s["cells"]} for r in lists}
    boxes = [(r["strip"], r["cell"], r["x0"], r["x1"], r["y0"], r["y1"]) for r in every.collect()]
    for p in placed.collect():
        near = {
            (s, c) for s, c, x0, x1, y0, y1 in boxes
            if max(x0 - p["x"], p["x"] - x1, y0 - p["y"], p["y"] - y1) < 1.5 and (s, c) != (p["strip"], p["cell"])
        }
        assert near <= got[p["strip"], p["cell"]]
    assert len(boxes) > 200 and max(map(len, got.values())) < 30
