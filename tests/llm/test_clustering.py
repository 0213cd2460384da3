import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fumarole.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, count=16, rounds=3):
    kept = []
    for key, vector in rows:
        if vector is None or len(vector) != 64 or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(64 * float(np.float32(x))) for x in vector]))
    name = lambda key: hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda kv: (name(kv[0]), kv[1]))[:count]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (n, _) in zip(kept, found) if n == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(k, *f) for (k, _), f in zip(kept, assign())], centroids


def odd_rows():
    rng = random.Random(2)
    spots = [[rng.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(spots)]) for i in range(300)]
    rows += [(i, [0.0] * 64) for i in range(300, 320)] + rows[:5]  # ties and repeated rows
    rows += [(None, spots[0]), (None, spots[1]), (3, spots[2])]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.1] * 63)]
    rows += [(905, [math.nan] + [0.1] * 63), (906, [math.inf] + [0.1] * 63), (907, [1000.0] * 64), (908, [-1000.0] * 64)]
    return rows


@pytest.mark.parametrize("lead", [1, 12, 64])
def test_clusters_equal_a_plain_search(spark, lead):
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"k": F.lit(1), "cluster": F.lit(2)}).repartition(5)
    found, centroids = cl.clusters(table, lead=lead)
    want, final = by_hand(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert centroids.tolist() == final


def test_bound_never_drops_the_nearest():
    rng = np.random.default_rng(1)
    rows = rng.integers(-40, 40, (3000, 64))
    rows[::7] = rows[0]
    axes = cl.rotation((rows.T @ rows).astype(float), 6)
    front, rest, _ = cl.rotated(rows, axes)
    whole = np.concatenate([rows[:8], rows[:8]])  # equal centroids: the smaller number wins
    numbers, distances = cl.Centroids(whole, axes).nearest(rows, front, rest)
    all_ = ((rows[:, None] - whole[None]) ** 2).sum(-1)
    assert (numbers == all_.argmin(1)).all() and (distances == all_.min(1)).all()


def test_the_filter_saves_work():
    rng = np.random.default_rng(4)
    spots = rng.integers(-60, 60, (16, 64))
    rows = spots[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 64))
    axes = cl.rotation((rows.T @ rows).astype(float))
    front, rest, _ = cl.rotated(rows, axes)
    measured = []

    class Counting(cl.Centroids):
        def distances(self, rows, row, number):
            measured.append(len(row))
            return super().distances(rows, row, number)

    Counting(spots, axes).nearest(rows, front, rest)
    assert sum(measured) < 1.1 * len(rows)


def test_few_vectors_none_and_too_large_ones(spark):
    few = spark.createDataFrame([(1, [0.25] * 64), (2, [-0.25] * 64)], SCHEMA)
    found, centroids = cl.clusters(few)
    assert sorted(r.distance for r in found.collect()) == [0, 0] and len(centroids) == 2
    assert cl.clusters(few.where("false"))[0].count() == 0
    large = spark.createDataFrame([(1, [3e7] * 64)], SCHEMA)
    with pytest.raises(Exception, match="no exact distance"):
        cl.clusters(large)
