"""Stratified splits, fold numbers and fixed-size samples drawn by key hash."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fumarole import vocab
from fumarole.functions.hashing import key_bits
from fumarole.operators.encode import positions
from fumarole.operators.quantiles import bin_edges, bin_of, quantile_table
from fumarole.session import SMALL_ROWS, materialise, small_table


def stratify(df: DataFrame, target: str, bins: int = 5, approx: bool = False) -> DataFrame:
    """Add ``bin``: right-closed quantile bins of the target, duplicate edges merged."""
    # a sketch tells the many-valued case apart, so that only few values are ever made distinct
    distinct = df.agg(F.approx_count_distinct(target)).first()[0]
    if distinct < 20 * bins:
        distinct = df.agg(F.count_distinct(target)).first()[0]
    edges = bin_edges(df, target, max(min(bins, distinct), 1), approx)
    return df.withColumn("bin", bin_of(F.col(target), edges))


def stratified_split(
    df: DataFrame,
    target: str,
    keys: Sequence[str] = vocab.KEYS,
    test_share: float = vocab.TEST_SHARE,
    seed: int = vocab.SEED,
) -> DataFrame:
    """Add ``bin`` and ``is_test``: the test rows of a bin are those with the lowest key hash.

    The cut is the exact quantile of the hash within the bin, found by aggregation, so no bin
    is ever gathered or sorted in one task. Rows that share a key go to the same side.
    """
    drawn = stratify(df, target).withColumn("_bits", key_bits([F.col(k) for k in keys], seed))
    cuts = quantile_table(drawn, ["_bits"], [test_share], by=["bin"]).select(
        F.col("bin").alias("_bin"), F.get("_bits", 0).alias("_cut")
    )
    joined = drawn.join(cuts, F.col("bin").eqNullSafe(F.col("_bin")), "left")
    return joined.withColumn("is_test", F.col("_bits") < F.col("_cut")).drop("_bits", "_bin", "_cut")


def train_and_test(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    plain = split.drop("bin", "is_test")
    return (
        plain.where(~split["is_test"]),
        plain.where(split["is_test"]),
    )


def dealt(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How ``count`` groups of one size go to the lightest folds, as (first rank, turns).

    From each first rank on the named folds take turns. A fold joins when the others have caught
    up with its load, so there are at most as many phases as folds. ``loads`` is brought up to date.
    """
    waiting = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    taking, done, phases = [waiting.pop(0)], 0, []
    while done < count:
        turns = sorted(taking, key=lambda f: (loads[f], f))
        take = count - done
        if waiting:
            other = waiting[0]
            ahead = [loads[other] - loads[f] for f in turns]
            take = min(take, sum(gap // size + 1 if f < other else -(-gap // size) for f, gap in zip(turns, ahead) if gap >= 0))
            taking.append(waiting.pop(0))
        if take:
            phases.append((done, turns))
            for i, f in enumerate(turns):
                loads[f] += size * (take // len(turns) + (i < take % len(turns)))
            done += take
    return phases


def group_folds(
    df: DataFrame, group: str, folds: int = vocab.FOLDS, max_rows: int = SMALL_ROWS
) -> DataFrame:
    """One row per group: the group, its rows and its fold.

    The largest group goes to the fold with the fewest rows so far; groups of equal size are taken
    from the last name to the first. There are as many folds as groups, at most ``folds``. Up to
    ``max_rows`` groups are dealt on the driver. Beyond that only the counts of group sizes reach
    it (n rows have fewer than sqrt(2 n) different sizes): the groups of one size are dealt in
    closed form, and a group's place in its size comes from sorted partitions.
    """
    spark = df.sparkSession
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"))
    held = counts.persist(StorageLevel.DISK_ONLY)
    try:
        few = held.limit(max_rows + 1).toArrow()
        if few.num_rows > max_rows:
            counts = materialise(held, "groups")
    finally:
        held.unpersist()
    schema = StructType([df.schema[group], *StructType.fromDDL("n_rows long, fold int")])
    if few.num_rows <= max_rows:
        rows = sorted(few.to_pylist(), key=lambda r: str(r[group]), reverse=True)
        loads = [(0, fold) for fold in range(min(folds, len(rows)))]
        out = []
        for row in sorted(rows, key=lambda r: -r["n_rows"]):
            load, fold = heapq.heappop(loads)
            heapq.heappush(loads, (load + row["n_rows"], fold))
            out.append((row[group], row["n_rows"], fold))
        return F.broadcast(spark.createDataFrame(out, schema))

    sizes = sorted(((r["n_rows"], r["count"]) for r in counts.groupBy("n_rows").count().collect()), reverse=True)
    loads, at, phases = [0] * min(folds, sum(n for _, n in sizes)), 0, []
    for size, count in sizes:
        phases.append((size, [(at + first, turns) for first, turns in dealt(loads, size, count)]))
        at += count
    table = spark.createDataFrame(phases, "size long, phases array<struct<first: long, turns: array<int>>>")
    placed = positions(counts, F.desc("n_rows"), F.desc(F.col(group).cast("string")))
    joined = placed.join(small_table(table), F.col("n_rows") == F.col("size"))
    known = F.filter("phases", lambda p: p["first"] <= F.col("position"))
    phase = F.element_at(known, -1)
    turn = (F.col("position") - phase["first"]) % F.size(phase["turns"])
    return joined.select(group, "n_rows", F.get(phase["turns"], turn.cast("int")).alias("fold"))


def row_fold(keys: Sequence[Column], folds: int = vocab.FOLDS, seed: int = vocab.SEED) -> Column:
    """Fold number of a row from its key hash."""
    return (key_bits(keys, seed) % folds).cast("int")


def add_folds(
    df: DataFrame,
    group: str | None,
    keys: Sequence[str] = vocab.KEYS,
    folds: int = vocab.FOLDS,
    seed: int = vocab.SEED,
) -> tuple[DataFrame, int]:
    """Add ``fold`` by group, or by row where there are fewer than two groups; rows without a
    group are in fold 0. Returns the table and the number of folds.
    """
    if group is not None and group in df.columns and _two_groups(df, group):
        table = group_folds(df, group, folds).select(F.col(group).alias("_group"), F.col("fold").alias("_fold"))
        joined = df.join(table, F.col(group) == F.col("_group"), "left")
        numbered = joined.withColumn("fold", F.coalesce("_fold", F.lit(0))).drop("_group", "_fold")
        return numbered, min(folds, table.limit(folds).count())
    return df.withColumn("fold", row_fold([F.col(k) for k in keys], folds, seed)), folds


def _two_groups(df: DataFrame, group: str) -> bool:
    return df.select(group).where(F.col(group).isNotNull()).distinct().limit(2).count() == 2


def hash_sample(
    df: DataFrame, rows: int, keys: Sequence[str], seed: int = vocab.SEED
) -> DataFrame:
    """A fixed-size sample: the rows with the lowest key hash (all of them if there are fewer).

    Each task keeps only its own lowest ``rows`` before the final merge.
    """
    by = [F.col(k) for k in keys]
    order = [key_bits(by, seed), *by]
    return df.orderBy(*order).limit(rows)
