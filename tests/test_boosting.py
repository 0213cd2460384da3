import heapq

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fumarole.operators import attribution, boosting, learners
from fumarole.operators.boosting import HistogramTrees

NAMES = ["a", "b", "c"]


def table(spark, n=900, seed=3):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.integers(0, 12, n), draw.integers(0, 3, n), draw.normal(size=n).round(1)]).astype(float)
    y = x[:, 0] * 0.7 - (x[:, 1] == 1) * 3 + np.sin(3 * x[:, 2]) + draw.normal(size=n) * 0.2
    rows = [(int(i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(4)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df), x, y


def binned(x):
    cuts = [(lambda u: (u[:-1] + u[1:]) / 2)(np.unique(x[:, i])) for i in range(x.shape[1])]
    return np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]), cuts


class Plain:
    """The same trees, row by row: every split is found by trying all of them."""

    def __init__(self, bins, alpha=0.0, penalty=1.0, least=1, step=0.1):
        self.bins, self.alpha, self.penalty, self.least, self.step = bins, alpha, penalty, least, step

    def soft(self, g):
        return np.sign(g) * max(abs(g) - self.alpha, 0)

    def score(self, g, h):
        return self.soft(g) ** 2 / (h + self.penalty) if h > 0 else 0.0

    def gains(self, rows, g, w):
        out = {}
        for f in range(self.bins.shape[1]):
            for cut in range(self.bins[:, f].max()):
                low = rows[self.bins[rows, f] <= cut]
                high = rows[self.bins[rows, f] > cut]
                if min((w[low] > 0).sum(), (w[high] > 0).sum()) < self.least:
                    continue
                parts = [(g[p] @ w[p], w[p].sum()) for p in (low, high, rows)]
                out[f, cut] = self.score(*parts[0]) + self.score(*parts[1]) - self.score(*parts[2])
        return out

    def best(self, rows, g, w):
        gains = self.gains(rows, g, w)
        if not gains or max(gains.values()) <= 1e-9:
            return None
        top = max(gains.values())
        return top, min(k for k, v in gains.items() if v > top - 1e-9)

    def weight(self, rows, g, w):
        return -self.step * self.soft(g[rows] @ w[rows]) / (w[rows].sum() + self.penalty) if w[rows].sum() > 0 else 0.0

    def parts(self, rows, key):
        low = self.bins[rows, key[0]] <= key[1]
        return rows[low], rows[~low]

    def level(self, g, w, depth):
        leaves = [np.arange(len(g))]
        for _ in range(depth):
            found = []
            for rows in leaves:
                best = self.best(rows, g, w)
                found += self.parts(rows, best[1]) if best else [rows]
            leaves = found
        return leaves

    def leafwise(self, g, w, budget, depth):
        heap, done, number = [], [], 0

        def offer(rows, level):
            nonlocal number
            best = self.best(rows, g, w) if level < depth else None
            if best:
                heapq.heappush(heap, (-best[0], number, best[1], rows, level))
            else:
                done.append(rows)
            number += 1

        offer(np.arange(len(g)), 0)
        count = 1
        while heap and count < budget:
            _, _, key, rows, level = heapq.heappop(heap)
            for part in self.parts(rows, key):
                offer(part, level + 1)
            count += 1
        return done + [item[3] for item in heap]

    def symmetric(self, g, w, depth):
        leaves = [np.arange(len(g))]
        for _ in range(depth):
            total = {}
            for rows in leaves:
                for key, gain in self.gains(rows, g, w).items():
                    total[key] = total.get(key, 0) + max(gain, 0)
            top = max(total.values())
            key = min(k for k, v in total.items() if v > top - 1e-9)
            leaves = [part for rows in leaves for part in self.parts(rows, key)]
        return leaves

    def predictions(self, leaves, g, w):
        out = np.zeros(len(g))
        for rows in leaves:
            out[rows] = self.weight(rows, g, w)
        return out


def predicted(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])


@pytest.mark.parametrize("alpha, penalty, depth", [(0.0, 1.0, 3), (15.0, 4.0, 4)])
def test_levels_equal_a_plain_search(spark, alpha, penalty, depth):
    df, x, y = table(spark)
    model = HistogramTrees(labelCol="y", growth="level", maxIter=3, maxDepth=depth, alpha=alpha, lambda_=penalty, minInstancesPerNode=5).fit(df)
    plain = Plain(binned(x)[0], alpha, penalty, 5)
    f = np.full(len(y), y.mean())
    for _ in range(3):
        g = f - y
        f = f + plain.predictions(plain.level(g, np.ones(len(y)), depth), g, np.ones(len(y)))
    assert predicted(model, df) == pytest.approx(f)


@pytest.mark.parametrize("budget, depth", [(4, -1), (9, -1), (7, 3), (40, -1)])
def test_leafwise_equals_a_search_leaf_by_leaf(spark, budget, depth):
    df, x, y = table(spark)
    model = HistogramTrees(labelCol="y", growth="leaf", maxIter=2, numLeaves=budget, maxDepth=depth, minInstancesPerNode=3).fit(df)
    plain, w = Plain(binned(x)[0], least=3), np.ones(len(y))
    f = np.full(len(y), y.mean())
    for _ in range(2):
        g = f - y
        f = f + plain.predictions(plain.leafwise(g, w, budget, depth if depth > 0 else 99), g, w)
    assert predicted(model, df) == pytest.approx(f)
    assert (model.nodes().query("tree >= 0 and feature < 0").groupby("tree").size() <= budget).all()


def test_leafwise_takes_fewer_passes_than_splits(spark, monkeypatch):
    passes = []
    real = boosting.Booster.counted
    monkeypatch.setattr(boosting.Booster, "counted", lambda self, *a: passes.append(1) or real(self, *a))
    df, _, _ = table(spark)
    model = HistogramTrees(labelCol="y", growth="leaf", maxIter=1, numLeaves=32, maxDepth=-1).fit(df)
    assert len(model.nodes().query("tree == 0 and feature < 0")) == 32 and len(passes) < 16


@pytest.mark.parametrize("temperature", [0.0, 1.0])
def test_ordered_boosting_sees_only_rows_before(spark, temperature, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)  # rows of a leaf lie in many blocks
    df, x, y = table(spark, 500)
    one = HistogramTrees(labelCol="y", growth="symmetric", maxIter=3, maxDepth=2, stepSize=0.4, lambda_=2.0, orderCol="id", baggingTemperature=temperature)
    made, cuts, mean = one.booster(df)
    trees = one.trees(made)
    found = {r["id"]: (r["plain"], r["ordered"]) for r in made.rows().collect()}

    plain = Plain(binned(x)[0], penalty=2.0, step=0.4)
    f = seen = np.full(len(y), y.mean())
    for number in range(3):
        w = made.weights(np.arange(len(y)), number)
        g = seen - y
        leaves = plain.symmetric(g, w, 2)
        step = np.zeros(len(y))
        for rows in leaves:
            for at, row in enumerate(rows):
                before = rows[:at]  # ids rise with the row number
                if len(before):
                    step[row] = -0.4 * (g[before] @ w[before]) / (w[before].sum() + 2.0)
        f, seen = f + plain.predictions(leaves, f - y, w), seen + step
    assert [found[i][1] for i in range(len(y))] == pytest.approx(list(seen))
    assert [found[i][0] for i in range(len(y))] == pytest.approx(list(f))
    for tree in trees:  # one split a level
        assert len({(tree.feature[n], tree.cut[n]) for n in (tree.left[0], tree.right[0])}) == 1


def test_samples_are_functions_of_rows_and_trees(spark):
    df, _, y = table(spark)
    settings = dict(labelCol="y", maxIter=20, maxDepth=4, subsamplingRate=0.7, columnShare=0.6)
    one, two = (predicted(HistogramTrees(**settings).fit(d), df) for d in (df, df.repartition(7)))
    assert one == pytest.approx(two)
    assert np.mean((one - y) ** 2) < 0.25 * np.var(y)
    features = HistogramTrees(**settings).fit(df).nodes().query("tree >= 0 and feature >= 0").groupby("tree")["feature"].nunique()
    assert (features <= 2).all() and len(features) == 20  # restaged after 16 trees


@pytest.mark.parametrize("growth", ["level", "leaf", "symmetric"])
def test_models_come_back_and_explain_themselves(spark, growth, tmp_path):
    df, _, _ = table(spark, 300)
    one = HistogramTrees(labelCol="y", growth=growth, maxIter=4, maxDepth=3, baggingTemperature=0.5)
    fitted = learners.pipeline(learners.Learner("x", one), NAMES).fit(df.drop("features"))
    path = str(tmp_path / growth)
    fitted.write().save(path)
    back = PipelineModel.load(path)
    rows = df.drop("features").withColumn("row_id", F.col("id").cast("string"))
    assert predicted(back, rows) == pytest.approx(predicted(fitted, rows))
    long = attribution.attributions(back, rows, NAMES)
    sums = long.groupBy("row_id").agg((F.sum("phi") + F.first("base")).alias("total"))
    both = back.transform(rows).join(sums, "row_id").select("prediction", "total").collect()
    assert len(both) == 300 and all(r["total"] == pytest.approx(r["prediction"]) for r in both)
    assert sum(back.stages[-1].featureImportances.toArray()) == pytest.approx(1.0)


def test_many_values_take_quantile_buckets(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=3000)
    df = spark.createDataFrame([(float(v), float(v > 0.3)) for v in x], "a double, y double")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    rows = df.selectExpr("array(a) AS x")
    cuts = boosting.cut_points(rows, 1, 16)[0]
    assert cuts == pytest.approx(list(np.quantile(x, [i / 16 for i in range(1, 16)])))
    model = HistogramTrees(labelCol="y", maxIter=1, maxDepth=1, maxBins=256).fit(df)
    assert abs(model.nodes().query("tree == 0 and feature == 0")["threshold"].iloc[0] - 0.3) < 0.02


def test_constant_target_one_row_and_none(spark):
    df, _, _ = table(spark, 50)
    flat = HistogramTrees(labelCol="y").fit(df.withColumn("y", F.lit(2.0)))
    assert set(predicted(flat, df)) == {2.0} and flat.featureImportances.toArray().sum() == 0
    assert HistogramTrees(labelCol="y").fit(df.where("id = 1")).base == df.where("id = 1").first()["y"]
    with pytest.raises(ValueError, match="no rows"):
        HistogramTrees(labelCol="y").fit(df.where("false"))
    with pytest.raises(ValueError, match="depth limit"):
        HistogramTrees(labelCol="y", maxDepth=-1).fit(df)
