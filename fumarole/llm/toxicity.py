"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the sum of three hashed embeddings: of the whole word and of its first four and six
bytes, so inflected forms share their stem. Filters of several widths run over the words, each
filter's largest output in the text is kept, and a linear layer scores them. Embeddings that
fewer than ``LEAST_TEXTS`` training texts use, or whose log odds are within their uncertainty, stay zero: rare words neither train
nor count.

The model is trained in numpy on the driver, from hashed words only, on a bounded sample: the
``SAMPLE`` training texts of each class with the smallest key hash, without a fifth of the keys
that is kept aside, and of those the texts of at most ``SAMPLE_WORDS`` words, until a class has
``CLASS_WORDS``. Embeddings start from the classes' log odds and are refined by Adam; only
positions that win the pooling carry gradients. Scores are shifted to the class shares among all
training rows. Scoring is one narrow pass over whole texts; the model has a fixed size.

Each language has its own threshold, which only the column ``flagged`` uses. All labelled training
rows that the network has not seen count for it: Spark counts them by language, label and one of
``BUCKETS`` score buckets, weighted back to the class shares of all training rows, and the cut has
the highest F1 in these counts.

Defined cases: a null or empty text scores like one without any known word; labels that are null
or not 0 or 1 are ignored, and a text labelled twice counts once, with its smaller label; of rows
that share a key the smallest text is learnt; without training rows of both classes every score is
the share of class 1 (one half without labels); null counts as a language; a language without rows
of both classes uses the common threshold; repeated rows are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumarole.llm import textarrays as ta
from fumarole.llm.quality_classifier import remainder, training_labels
from fumarole.session import materialise, small_table

BITS = 18
#: Leading bytes hashed besides the whole word.
STEMS = (4, 6)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
SAMPLE = 1500
SAMPLE_WORDS = 20_000
CLASS_WORDS = 4_000_000
#: Score buckets that the thresholds are chosen from.
BUCKETS = 1000
LEAST_TEXTS = 3
#: Standard errors by which log odds are drawn towards zero.
DOUBT = 1.5
EPOCHS = 6
BATCH = 32
RATE = 0.01
DECAY = 1e-3
THRESHOLD = 0.5
MAX_LOGIT = 30.0

#: What a byte of lower-cased text becomes: letters stay, all else separates words.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of every word (one column for each hash), and where texts begin."""
    data, bounds = ta.flat(pc.utf8_lower(texts))
    data = LETTERS[data]
    words = ta.words_of(data, bounds)
    columns = []
    for salt, size in enumerate((None, *STEMS)):
        end = words.end if size is None else np.minimum(words.end, words.start + size)
        hashes = ta.mix(ta.hash_spans(data, words.start, end) + np.uint64(salt))
        columns.append((hashes >> np.uint64(64 - BITS)).astype(np.int32))
    return np.stack(columns, axis=1), words.first


def pooled_rows(first: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(first))


@dataclass
class Network:
    """Embeddings, filters by width and position, and the output layer."""

    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def begin(cls, odds: np.ndarray, seed: int = 7) -> Network:
        """From log odds of the embedding rows (zero for rows that stay out)."""
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.05, (len(odds), DIM)).astype(np.float32)
        embed[:, 0] = odds
        embed[odds == 0] = 0
        filters, biases = [], []
        for width in WIDTHS:
            weight = rng.normal(0, 0.05, (width, DIM, FILTERS)).astype(np.float32)
            weight[:, 0, : FILTERS // 2] += 1 / width  # half start by looking for class 1,
            weight[:, 0, FILTERS // 2 :] -= 1 / width  # half for class 0
            filters.append(weight)
            biases.append(np.zeros(FILTERS, np.float32))
        signs = np.repeat([1, -1], FILTERS // 2)
        out = np.tile(signs, len(WIDTHS)).astype(np.float32) / (FILTERS * len(WIDTHS))
        return cls(embed, filters, biases, out, 0.0)

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        words = self.embed[buckets[:, 0]]
        for column in range(1, buckets.shape[1]):
            words += self.embed[buckets[:, column]]
        return words

    def pooled(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest output of every filter in every text, where it lies, and the word vectors."""
        words = self.vectors(buckets)
        texts = len(first) - 1
        best = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        place = np.full(best.shape, -1, np.int64)
        rows = pooled_rows(first)
        if not len(rows):
            return best, place, words
        begin = first[:-1][rows]
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
        for w, (weight, bias) in enumerate(zip(self.filters, self.biases)):
            total = words @ weight[0] + bias
            for step in range(1, len(weight)):
                inside = left[:-step] > step
                total[:-step] += np.where(inside[:, None], words[step:] @ weight[step], 0)
            top = np.maximum.reduceat(total, begin, axis=0)
            # the first place in each text that reaches the largest output
            owner = np.repeat(np.arange(len(rows)), np.diff(first)[rows])
            for f in range(FILTERS):
                hits = np.flatnonzero(total[:, f] >= top[owner, f])
                found, at = np.unique(owner[hits], return_index=True)
                place[rows[found], w * FILTERS + f] = hits[at]
            best[rows, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top, 0)
        return best, np.where(best > 0, place, -1), words

    def maxima(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """As ``pooled``, without the places."""
        words = self.vectors(buckets)
        best = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        rows = pooled_rows(first)
        if len(rows):
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
            for w, (weight, bias) in enumerate(zip(self.filters, self.biases)):
                total = words @ weight[0] + bias
                for step in range(1, len(weight)):
                    more = words[step:] @ weight[step]
                    more[left[:-step] <= step] = 0
                    total[:-step] += more
                top = np.maximum.reduceat(total, first[:-1][rows], axis=0)
                best[rows, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top, 0)
        return best

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        logits = self.maxima(buckets, first).astype(np.float64) @ self.out + self.bias + self.shift
        return 1 / (1 + np.exp(-np.clip(logits, -MAX_LOGIT, MAX_LOGIT)))


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    shape = (0, 1 + len(STEMS))
    return np.concatenate([*texts, np.zeros(shape, np.int32)]).astype(np.int32), first


def log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log odds of class 1 by embedding row, from the texts that use it, drawn towards zero by
    their uncertainty; rows that few texts use or that tell nothing are zero."""
    used = np.zeros((2, 1 << BITS))
    for text, y in zip(texts, labels.tolist()):
        used[y, np.unique(text)] += 1
    sizes = np.maximum(np.bincount(labels, minlength=2), 1)
    odds = np.log((used[1] + 0.5) / (sizes[1] + 1)) - np.log((used[0] + 0.5) / (sizes[0] + 1))
    doubt = DOUBT * np.sqrt(1 / (used[1] + 0.5) + 1 / (used[0] + 0.5))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0)
    return np.where(used.sum(axis=0) >= LEAST_TEXTS, sure, 0).astype(np.float32)


class Adam:
    """Moments of one array; rows that get no gradient stay as they are."""

    def __init__(self, value: np.ndarray) -> None:
        self.value = value
        self.m = np.zeros_like(value)
        self.v = np.zeros_like(value)
        self.t = 0

    def step(self, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.t += 1
        m = self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        v = self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad**2
        m, v = m / (1 - 0.9**self.t), v / (1 - 0.99**self.t)
        self.value[rows] -= RATE * (m / (np.sqrt(v) + 1e-6) + DECAY * self.value[rows])


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to hashed texts by mini-batches."""
    odds = log_odds(texts, labels)
    net = Network.begin(odds, seed)
    live = odds != 0
    steps = {
        "embed": Adam(net.embed),
        "out": Adam(net.out),
        "filters": [Adam(w) for w in net.filters],
        "biases": [Adam(b) for b in net.biases],
    }
    level = Adam(np.zeros(1, np.float32))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            buckets, first = joined([texts[j] for j in pick])
            best, place, words = net.pooled(buckets, first)
            logits = best @ net.out + level.value[0]
            error = (1 / (1 + np.exp(-np.clip(logits, -MAX_LOGIT, MAX_LOGIT))) - labels[pick]) / len(pick)
            back = error[:, None] * net.out
            steps["out"].step(best.T @ error)
            level.step(np.array([error.sum()], np.float32))
            grad = np.zeros_like(words)
            touched = np.zeros(len(words), bool)
            for w, weight in enumerate(net.filters):
                change = np.zeros_like(weight)
                for f in range(FILTERS):
                    column = w * FILTERS + f
                    texts_on = np.flatnonzero(place[:, column] >= 0)
                    at, signal = place[texts_on, column], back[texts_on, column]
                    for step in range(len(weight)):
                        inside = at + step < first[1:][texts_on]
                        near = at[inside] + step
                        change[step, :, f] = words[near].T @ signal[inside]
                        np.add.at(grad, near, signal[inside, None] * weight[step, :, f])
                        touched[near] = True
                steps["filters"][w].step(change)
                sums = back[:, w * FILTERS : (w + 1) * FILTERS] * (place[:, w * FILTERS : (w + 1) * FILTERS] >= 0)
                steps["biases"][w].step(sums.sum(axis=0))
            rows, which = np.unique(buckets[touched], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, which.reshape(-1, 1 + len(STEMS)), grad[touched][:, None, :])
            steps["embed"].step(total[live[rows]], rows[live[rows]])
    net.bias = float(level.value[0])
    return net


def fit(texts: list[np.ndarray], labels: np.ndarray, totals: tuple[int, int], seed: int = 7) -> Network:
    """Network and class-share shift from a sample; ``totals`` counts all training rows of class
    0 and 1."""
    sizes = np.bincount(labels, minlength=2)
    if min(sizes) < 2:
        level = totals[1] / sum(totals) if sum(totals) else 0.5
        empty = np.zeros((0, DIM), np.float32)
        return Network(empty, [], [], np.zeros(0), 0.0, constant=level)
    net = train(texts, labels, seed)
    net.shift = float(np.log(totals[1] / totals[0]) - np.log(sizes[1] / sizes[0]))
    return net


def best_cuts(counts: DataFrame, by: list[str], start: float) -> DataFrame:
    """The score with the highest F1 for class 1, nearest to ``start``, from the weights (w0, w1)
    of both classes by bucket ``b``; only for groups that hold both."""
    above = Window.partitionBy(*by).orderBy(F.desc("b"))
    cells = counts.groupBy(*by, "b").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    cells = cells.withColumns({c: F.sum(c[:2]).over(above) for c in ("w0_above", "w1_above")})
    f1 = 2 * F.col("w1_above") / (F.col("w0_above") + F.col("w1_above") + F.sum("w1").over(Window.partitionBy(*by)))
    cells = cells.withColumns({"f1": F.round(f1, 12), "cut": F.col("b") / BUCKETS})
    best = F.max_by("cut", F.struct("f1", -F.abs(F.col("cut") - start), "cut")).alias("cut")
    return cells.groupBy(*by).agg(best, F.sum("w0").alias("w0"), F.sum("w1").alias("w1")).where("w0 > 0 and w1 > 0").drop("w0", "w1")


def threshold_counts(scored: DataFrame, unseen: DataFrame, totals: dict[int, int]) -> DataFrame:
    """Weights of both classes by language and score bucket, over all training rows that the
    network has not seen; a class weighs as much as all its training rows."""
    sizes = {r["y"]: r["n"] for r in unseen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bucket = F.floor(F.col("score") * BUCKETS).alias("b")
    rows = scored.where("k is not null").groupBy("k", "lang", bucket).agg(F.count("*").alias("n"))
    weights = [
        F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) * F.lit(totals.get(y, 0) / sizes.get(y, 1))
        for y in (0, 1)
    ]
    return rows.join(unseen, "k").groupBy("lang", "b").agg(*[w.alias(f"w{y}") for y, w in enumerate(weights)])


def sample_texts(docs: DataFrame, chosen: DataFrame, text: str, key: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The embedding rows of the words of the chosen training texts, and their labels.

    The hashed texts are staged; the driver sees their sizes first and fetches what the bound on
    the words of a class leaves.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("s")).join(chosen, "k")
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min("s").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                buckets, first = word_buckets(part.column("s"))
                cuts = pa.array((first * buckets.shape[1]).astype(np.int32))
                lists = pa.ListArray.from_arrays(cuts, pa.array(buckets.ravel()))
                sizes = np.diff(first)
                columns = [part.column("k"), part.column("y"), pa.array(sizes.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["k", "y", "n", "b"]).filter(pa.array(sizes <= SAMPLE_WORDS))

    kind = docs.schema[key].dataType.simpleString()
    hashed = rows.mapInArrow(run, f"k {kind}, y int, n int, b array<int>")
    staged = materialise(hashed.select(F.xxhash64("k").alias("h"), "y", "n", "b"), "sample")
    sizes = staged.select("h", "y", "n").toArrow().to_pylist()
    left, last = {0: CLASS_WORDS, 1: CLASS_WORDS}, {0: None, 1: None}
    for row in sorted(sizes, key=lambda r: (r["h"], r["n"])):
        left[row["y"]] -= row["n"]
        if left[row["y"]] < 0 and last[row["y"]] is None:
            last[row["y"]] = row["h"]
    for y, h in last.items():
        staged = staged if h is None else staged.where((F.col("y") != y) | (F.col("h") < h))
    texts, labels = [], []
    for batch in staged.select("y", "b").toArrow().to_batches():
        lists = batch.column("b")
        values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        texts += [values[a:b].reshape(-1, 1 + len(STEMS)) for a, b in zip(cuts, cuts[1:])]
        labels += batch.column("y").to_pylist()
    # whatever order the rows came in, the same sample gives the same model
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i].tobytes()))
    return [texts[i] for i in order], np.array([labels[i] for i in order], np.int64)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    lang: str = "lang",
    label: str = "toxic",
    parts: int = 5,
    held: int = 0,
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
) -> DataFrame:
    """(key, held_out, score, predicted, flagged) of every row; ``flagged`` compares the score
    with the threshold of the row's language."""
    learn = training_labels(labels, key, label, parts, held)
    counts = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    aside = F.pmod(F.xxhash64("k", F.lit("aside")), F.lit(5)) == 0
    chosen = None
    for y in (0, 1):
        own = learn.where((F.col("y") == y) & ~aside).orderBy(F.xxhash64("k"), "k").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = small_table(chosen)
    net = fit(*sample_texts(docs, chosen, text, key), (counts.get(0, 0), counts.get(1, 0)))
    held_net = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_net.value
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                scores = pa.array(model.scores(*word_buckets(part.column("s"))))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("lang"), scores], ["k", "lang", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = materialise(rows.mapInArrow(run, f"k {kind}, lang string, score double"), "scores")
    common = THRESHOLD
    cuts = docs.sparkSession.createDataFrame([], "tongue string, cut double")
    if net.constant is None:
        weights = threshold_counts(scored, learn.join(chosen, "k", "left_anti"), counts)
        weights = small_table(weights)
        best = best_cuts(weights, [], THRESHOLD).first()
        common = best["cut"] if best else THRESHOLD
        cuts = best_cuts(weights, ["lang"], common).withColumnRenamed("lang", "tongue")
    found = scored.join(small_table(cuts), F.col("lang").eqNullSafe(F.col("tongue")), "left")
    return found.select(
        F.col("k").alias(key),
        (remainder(F.col("k"), parts) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce("cut", F.lit(common))).alias("flagged"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
