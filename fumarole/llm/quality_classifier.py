"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass turns every whole text into about twenty transformed statistics, kept as a stage table.
Class counts, sums and cross products of the labelled training rows are added up by Spark; only
those sums reach the driver. Each class covariance is shrunk towards the pooled one and towards a
scaled identity, and its Cholesky factor is inverted once. A score is the logistic of the
difference of the two classes' log densities (by Mahalanobis distance) and log frequencies.

Defined cases: a null text counts as empty and has a score like any other; labels that are null
or not 0 or 1 are ignored; a document labelled twice counts once, with its smaller label; without
training rows of both classes every score is the share of class 1 (one half without labels);
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.llm import textarrays as ta
from fumarole.session import materialise

#: Shares of the pooled covariance, and of the identity, in each class covariance.
POOLING = 0.5
RIDGE = 0.05
THRESHOLD = 0.7
#: Fewest rows a class needs for a covariance of its own.
LEAST_ROWS = 3

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>{}[]\\^~=_+@")] = True
BANG = np.zeros(256, bool)
BANG[list(b"!?")] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:")] = True


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Square root of a share: spreads small shares."""
    return np.sqrt(part / np.maximum(whole, 1))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics a text."""
    data, bounds = ta.flat(texts)
    words = ta.words_of(data, bounds)
    first, n, size = words.first, words.counts, np.diff(bounds)
    count = lambda flags: ta.per_text(flags[data], bounds)
    upper, letters = count(UPPER), count(LETTER)
    lengths = words.end - words.start
    mean = ta.per_text(lengths, first) / np.maximum(n, 1)
    squares = ta.per_text(lengths**2, first) / np.maximum(n, 1)
    hashes = ta.hash_spans(data, words.start, words.end)
    doc = words.doc
    keys, one, times = np.unique(
        hashes ^ ta.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True
    )
    distinct = np.bincount(doc[one], minlength=len(n))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, doc[one], times)
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    starts = ta.window_starts(first, 3)
    owner = ta.mix(doc.astype(np.uint64) + np.uint64(1))
    again = ta.repeated(ta.Sequence(hashes).span(starts, starts + 3) ^ owner[starts])
    grams = ta.covered(len(words), starts[again], starts[again] + 3)
    lines = ta.per_text(data == 10, bounds)
    ends = np.zeros(len(words), bool)
    ends[:] = (STOP | BANG)[data[words.end - 1]]
    short = lengths <= 3
    columns = [
        np.log1p(n),
        np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(squares - mean**2, 0))),
        share(upper, letters),
        share(letters, size),
        share(count(DIGIT), size),
        share(count(SYMBOL), size),
        share(count(BANG), size),
        share(count(STOP), size),
        share(ta.per_text(data >= 128, bounds), size),
        share(distinct, n),
        share(top, n),
        share(ta.per_text(same, first), n),
        share(ta.per_text(grams, first), n),
        np.log1p(lines),
        np.log1p(lines / np.maximum(n, 1)),
        share(ta.per_text(ends, first), n),
        share(ta.per_text(short, first), n),
        share(ta.per_text(UPPER[data[words.start]], first), n),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Discriminant:
    """Two Gaussians with cached inverse Cholesky factors, or a constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]
    constant: float | None = None

    @classmethod
    def fit(
        cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooling: float = POOLING, ridge: float = RIDGE
    ) -> Discriminant:
        """From the count, sum and cross products of each class."""
        rows = {k: sums[k][0] if k in sums else 0 for k in (0, 1)}
        if min(rows.values()) < LEAST_ROWS:
            total = sum(rows.values())
            level = rows[1] / total if total else 0.5
            return cls(np.zeros(0), np.zeros(0), [], [], [], level)
        total = rows[0] + rows[1]
        means = {k: sums[k][1] / rows[k] for k in rows}
        spread = {k: sums[k][2] / rows[k] - np.outer(means[k], means[k]) for k in rows}
        pooled = sum(rows[k] * spread[k] for k in rows) / total
        centre = (sums[0][1] + sums[1][1]) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        factors, logs = [], []
        for k in (0, 1):
            mixed = ((1 - pooling) * spread[k] + pooling * pooled) / np.outer(scale, scale)
            mixed = (1 - ridge) * mixed + ridge * np.eye(len(scale))
            lower = np.linalg.cholesky(mixed)
            factors.append(np.linalg.inv(lower).T)
            logs.append(float(np.log(rows[k] / total) - np.log(np.diag(lower)).sum()))
        return cls(centre, scale, [(means[k] - centre) / scale for k in (0, 1)], factors, logs)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        logs = [
            log - 0.5 * (((z - mean) @ factor) ** 2).sum(axis=1)
            for mean, factor, log in zip(self.means, self.factors, self.logs)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def remainder(key: Column, parts: int) -> Column:
    """CRC-32 of the key's text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def training_labels(labels: DataFrame, key: str, label: str, parts: int, held: int) -> DataFrame:
    """(k, y) of the labelled documents that may be learned from, each once."""
    rows = labels.where(F.col(label).isin(0, 1) & (remainder(F.col(key), parts) != held))
    return rows.groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))


def statistics_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(k, x): the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                x = statistics(part.column("s"))
                flat = pa.array(x.ravel())
                cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.ListArray.from_arrays(cuts, flat)], ["k", "x"]
                )

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("s"))
    return rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and cross products by class of rows (y, x), added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                y = batch.column("y").to_numpy()
                x = matrix(batch.column("x"))
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                for k in (0, 1):
                    part = x[y == k]
                    held[k] = held.get(k, 0) + part.T @ part
        for k, sums in held.items():
            values = sums.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), k, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
                ["y", "i", "v"],
            )

    sums = rows.select("y", "x").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    cells: dict[int, dict[int, float]] = {}
    for row in sums.collect():
        cells.setdefault(row["y"], {})[row["i"]] = row["v"]
    out = {}
    for k, values in cells.items():
        size = int(len(values) ** 0.5)
        table = np.array([values[i] for i in range(size * size)]).reshape(size, size)
        if table[0, 0]:
            out[k] = (table[0, 0], table[0, 1:], table[1:, 1:])
    return out


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    parts: int = 4,
    held: int = 2,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, held_out, score, predicted) of every row; learned from labelled rows whose key has
    another remainder than ``held``."""
    rows = materialise(statistics_rows(docs, text, key), "statistics")
    model = Discriminant.fit(class_sums(rows.join(training_labels(labels, key, label, parts, held), "k")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(model.scores(matrix(batch.column("x"))))
                yield pa.RecordBatch.from_arrays([batch.column("k"), scores], ["k", "score"])

    kind = rows.schema["k"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"k {kind}, score double")
    return scored.select(
        F.col("k").alias(key),
        (remainder(F.col("k"), parts) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
