import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fumarole.operators import split


def rows(spark, n=1000, seed=5):
    draw = random.Random(seed)
    data = [(f"c{i}", 2020, draw.choice(["a"] * 6 + ["b", "c"]), draw.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame(data, "company_name string, reporting_year int, sector string, y double")


def test_split_shares_and_disjointness(spark):
    df = rows(spark)
    table = split.stratified_split(df, "y")
    per_bin = {r["bin"]: (r["n"], r["t"]) for r in table.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert per_bin == {b: (200, 40) for b in range(5)}
    train, test = split.train_and_test(table)
    assert train.columns == df.columns and train.count() + test.count() == 1000
    assert train.join(test, "company_name").count() == 0


def test_split_does_not_depend_on_partitions(spark):
    df = rows(spark, 200)
    one = split.stratified_split(df.coalesce(1), "y").where("is_test").collect()
    many = split.stratified_split(df.repartition(9), "y").where("is_test").collect()
    other = split.stratified_split(df, "y", seed=7).where("is_test").collect()
    assert sorted(one) == sorted(many) and sorted(one) != sorted(other)


def test_constant_target_has_one_bin(spark):
    df = rows(spark, 50).withColumn("y", F.lit(1.0))
    assert {r["bin"] for r in split.stratify(df, "y").collect()} == {0}
    assert split.stratified_split(df, "y").where("is_test").count() == 10


def test_no_group_in_two_folds(spark):
    df = rows(spark)
    table, folds = split.add_folds(df, "sector")
    assert folds == 3
    assert table.groupBy("sector").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1


def greedy(sizes, folds):
    loads, out = [0] * min(folds, len(sizes)), {}
    for name, n in sorted(sorted(sizes.items(), reverse=True), key=lambda kv: -kv[1]):
        at = loads.index(min(loads))
        loads[at] += n
        out[name] = at
    return out


def test_group_folds_by_brute_force(spark):
    draw = random.Random(9)
    sizes = {f"g{i}": draw.randint(3, 12) for i in range(23)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {r["g"]: r["fold"] for r in split.group_folds(df, "g").collect()}
    assert got == greedy(sizes, 5)


def test_row_folds_without_groups(spark):
    df = rows(spark).withColumn("sector", F.lit("only"))
    table, folds = split.add_folds(df, "sector")
    sizes = Counter(r["fold"] for r in table.collect())
    assert folds == 5 and set(sizes) == set(range(5)) and min(sizes.values()) > 150


def test_sample_is_fixed_size_and_stable(spark):
    df = rows(spark, 500)
    a = split.hash_sample(df.coalesce(1), 30, ["company_name"]).collect()
    b = split.hash_sample(df.repartition(8), 30, ["company_name"]).collect()
    assert len(a) == 30 and sorted(a) == sorted(b)
    assert split.hash_sample(df, 900, ["company_name"]).count() == 500


@pytest.mark.parametrize("max_rows", [split.SMALL_ROWS, 1])
@pytest.mark.parametrize("seed, sizes", [(1, [1]), (2, [2, 7]), (3, [1, 2, 3, 50]), (4, list(range(1, 40))), (5, [5, 5, 300])])
def test_every_group_is_dealt_greedily(spark, max_rows, seed, sizes):
    draw = random.Random(seed)
    groups = {f"g{draw.randint(0, 10**6)}": draw.choice(sizes) for _ in range(200)} | {"big": 900, "huge": 4000}
    df = spark.createDataFrame([(g,) for g, n in groups.items() for _ in range(n)] + [(None,)], "g string").repartition(6)
    found = split.group_folds(df, "g", max_rows=max_rows).collect()
    assert {r["g"]: r["n_rows"] for r in found} == groups
    assert {r["g"]: r["fold"] for r in found} == greedy(groups, 5)


def test_phases_deal_like_a_heap():
    draw = random.Random(6)
    for _ in range(300):
        folds = draw.randint(1, 6)
        start = [draw.randint(0, 40) for _ in range(folds)]
        size, count = draw.randint(1, 9), draw.randint(1, 60)
        loads, want = list(start), []
        for _ in range(count):
            at = loads.index(min(loads))
            loads[at] += size
            want.append(at)
        after = list(start)
        phases = split.dealt(after, size, count)
        got = []
        for rank in range(count):
            first, turns = [p for p in phases if p[0] <= rank][-1]
            got.append(turns[(rank - first) % len(turns)])
        assert got == want and after == loads and len(phases) <= folds


def test_folds_of_rows_without_a_group(spark):
    df = rows(spark).withColumn("sector", F.when(F.col("sector") != F.lit("none"), F.col("sector")))
    table, folds = split.add_folds(df, "sector")
    assert folds == 3 and table.count() == df.count()
    two = df.limit(40).withColumn("sector", F.when(F.rand(1) < 0.5, "x").when(F.rand(2) < 0.5, "y"))
    table, folds = split.add_folds(two, "sector")
    assert folds == 2 and {r["fold"] for r in table.where("sector is null").collect()} <= {0}
