"""Centroid clustering of integer vectors with PCA-rotated filtering.

Every component becomes the integer ``floor(64 * x)``. One pass adds up the second moments of all
vectors; their leading eigenvectors rotate the space. A stage table keeps, beside the integers of a
vector, its leading rotated coordinates and the norm of the residual, what they leave out. For a
centroid turned the same way,

    |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2  <=  |x - c|^2,

so this bound, less a slack for rounding, filters the centroids of a vector: the one with the
smallest bound is measured in integers first, and only centroids whose bound does not exceed that
distance are measured too. Distances, sums and means are integers throughout; the rotation decides
how much work is saved, never a result.

Each assignment reads the stage table once. Tasks add up sums and counts by centroid and Spark
adds up the tasks, so the driver sees as many rows as there are centroids.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinite component
are left out; repeated rows count each; of starts with equal hashes (repeated ids) the smaller
vector comes first, and a null id hashes as an empty one; with fewer vectors than centroids there
are as many centroids as vectors; an empty table gives an empty result; other columns are ignored.
An integer beyond 2**27 raises, for its squared distances might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.session import materialise

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Rotated coordinates kept in front of the residual norm.
LEAD = 12
#: Largest integer whose squared distances are sure to fit a long.
LARGEST = 1 << 27
#: Share of the squared norms that a bound may be wrong by.
SLACK = 1e-9
#: Vectors measured at once.
BLOCK = 1 << 14


def integers(vectors: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, and their components as integers, one row each."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    good = np.flatnonzero(np.nan_to_num(lengths, nan=-1) == width)
    values = vectors.take(pa.array(good)).flatten().cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False).reshape(-1, width)  # a null becomes NaN
    whole = np.isfinite(values).all(axis=1)
    scaled = np.floor(SCALE * values[whole])
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // SCALE} leaves no exact distance in a long")
    return good[whole], scaled.astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def moments(vectors: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Second moments of all vectors, added up by tasks and then by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = integers(batch.column(0), width)[1].astype(float)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), lists(total, pa.float64())], ["i", "sums"]
        )

    parts = vectors.mapInArrow(add, "i int, sums array<double>")
    sums = F.array(*[F.sum(F.col("sums")[j]) for j in range(width)])
    found = parts.groupBy("i").agg(sums.alias("sums")).collect()
    out = np.zeros((width, width))
    for row in found:
        out[row["i"]] = row["sums"]
    return out


def rotation(second: np.ndarray, lead: int = LEAD) -> np.ndarray:
    """The leading eigenvectors as columns."""
    return np.linalg.eigh(second)[1][:, ::-1][:, :lead]


def rotated(rows: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, norm of the residual, and squared norm of each row."""
    rows = rows.astype(float)
    front = rows @ axes
    norms = np.einsum("ij,ij->i", rows, rows)
    return front, np.sqrt(np.maximum(norms - np.einsum("ij,ij->i", front, front), 0)), norms


@dataclass(frozen=True)
class Centroids:
    """Centroids in integers and in rotated form."""

    whole: np.ndarray
    axes: np.ndarray

    def nearest(self, rows: np.ndarray, front: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every row (the smaller number on a tie) and its squared distance."""
        lead, residual, norms = rotated(self.whole, self.axes)
        numbers, found = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
        for low in range(0, len(rows), BLOCK):
            part = slice(low, low + BLOCK)
            numbers[part], found[part] = self._block(rows[part], front[part], rest[part], lead, residual, norms)
        return numbers, found

    def _block(self, rows, front, rest, lead, residual, norms) -> tuple[np.ndarray, np.ndarray]:
        own = np.einsum("ij,ij->i", front, front)
        bound = own[:, None] + np.einsum("ij,ij->i", lead, lead) - 2 * (front @ lead.T)
        bound += (rest[:, None] - residual) ** 2
        bound -= SLACK * ((own + rest**2)[:, None] + norms + 1)
        at = np.arange(len(rows))
        best = bound.argmin(axis=1)
        least = self.distances(rows, at, best)
        bound[at, best] = np.inf
        row, other = np.nonzero(bound <= least[:, None])
        measured = self.distances(rows, row, other)
        # all measured pairs by (row, distance, number); the first of each row wins
        row, other = np.concatenate([at, row]), np.concatenate([best, other])
        measured = np.concatenate([least, measured])
        order = np.lexsort((other, measured, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        return other[first].astype(np.int32), measured[first]

    def distances(self, rows: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
        gap = rows[row] - self.whole[number]
        return np.einsum("ij,ij->i", gap, gap)


def prepared(table: DataFrame, vector: str, key: str, axes: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(k, v, lead, rest) of every vector that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = integers(batch.column(1), width)
            front, rest, _ = rotated(rows, axes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(good)),
                    lists(rows, pa.int32()),
                    lists(front, pa.float64()),
                    pa.array(rest),
                ],
                ["k", "v", "lead", "rest"],
            )

    kind = table.schema[key].dataType.simpleString()
    chosen = table.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    return chosen.mapInArrow(run, f"k {kind}, v array<int>, lead array<double>, rest double")


def starts(rows: DataFrame, count: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("name"), "v").orderBy("name", "v").limit(count).collect()
    return np.array([row["v"] for row in first], np.int64)


def assigned(batch: pa.RecordBatch, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integer vectors of a batch, their centroids and squared distances."""
    at = batch.schema.get_field_index
    rows = matrix(batch.column(at("v"))).astype(np.int64)
    front, rest = matrix(batch.column(at("lead"))), batch.column(at("rest")).to_numpy()
    return rows, *centroids.nearest(rows, front, rest)


def moved(rows: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every centroid with vectors moves to the floor of their mean."""
    count, width = centroids.whole.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, numbers, _ = assigned(batch, centroids)
                np.add.at(sums, numbers, vectors)
                sizes += np.bincount(numbers, minlength=count)
        met = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(sizes[met]), lists(sums[met], pa.int64())],
            ["cluster", "n", "sums"],
        )

    parts = rows.select("v", "lead", "rest").mapInArrow(add, "cluster int, n long, sums array<long>")
    sums = [F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(width)]
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums"))
    whole = centroids.whole.copy()
    for row in totals.collect():
        whole[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return Centroids(whole, centroids.axes)


def clusters(
    table: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    lead: int = LEAD,
    width: int = WIDTH,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that counts, and the final centroids."""
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    schema = f"k {kind}, cluster int, distance long"
    axes = rotation(moments(table.select(vector), width), lead)
    rows = materialise(prepared(table, vector, key, axes, width), "vectors")
    centroids = Centroids(starts(rows, count), axes)
    if not len(centroids.whole):
        return spark.createDataFrame([], schema).withColumnRenamed("k", key), centroids.whole
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, numbers, found = assigned(batch, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(numbers), pa.array(found)], ["k", "cluster", "distance"]
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key), centroids.whole


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, whole = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    found = materialise(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    inertia = {row["cluster"]: row["inertia"] for row in sums}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in whole.tolist()]
    # one entry for each centroid, so these arrays have a fixed size
    own = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(names))] or [F.lit(None).cast("long")])
    digest = F.array(*[F.lit(name) for name in names] or [F.lit(None).cast("string")])
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        own[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        digest[F.col("cluster")].alias("centroid_sha256"),
    )
