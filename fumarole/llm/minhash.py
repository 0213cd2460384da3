"""Document fingerprints by MinHash, and searches over their bands.

A text is the set of its shingles of five words. Every shingle hash x (32 bits) goes through
``PERMUTATIONS`` strongly universal functions ``(a * x + b) >> 32`` modulo 2**64, in numpy over flat
word arrays; the smallest value of each function is kept to 16 bits. The share of equal values of
two fingerprints, their likeness, estimates the Jaccard similarity of the shingle sets.

``edited`` pairs every text with the one behind it by (key, text hash). The rows are dealt out by
range of that order and sorted inside a task, so a task meets neighbours one after the other; only
its first and last row leave it as text, to be joined by task number with those of the tasks
around it. Rows of one key, and copies, spread over tasks.

``matches`` finds for stated query rows all rows with a Jaccard similarity of at least 0.8. Equal
fingerprints form one class; the bands of classes are joined on (band, its values), so copies never
meet in pairs, and each candidate pair of classes is verified on the whole shingle sets, fetched
for the candidates only. The chance that no band joins a pair of similarity 0.8 is 0.0017. A bucket
of more than ``LISTED`` pairs is a crowd (``crowds.py``): its pairs are decided together, exactly,
and only those that their differences from the crowd leave open are listed.

Defined cases: a null text counts as empty; a text of fewer than five words is one shingle, one
without words has none, and two of these are alike; rows with a null key come first, and of rows
with one key that with the smaller text hash; repeated rows are neighbours of each other; a table
of one row is its own neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fumarole.llm import textarrays as ta
from fumarole.llm.crowds import crowd_counts, near
from fumarole.session import materialise, small_table

SHINGLE = 5
PERMUTATIONS = 128
#: Bands and their rows.
BANDS, ROWS = 21, 6
#: Bytes of one value in a fingerprint.
VALUE_BYTES = 2
#: Shingles that go through all permutations at once.
BLOCK = 1 << 15
#: Rows that one class of many copies is spread over.
SALTS = 8
#: Pairs (asking classes x classes) of one bucket up to which they are listed.
LISTED = 256
EMPTY = 0xFFFF

_rng = np.random.default_rng(20_261_013)
FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)

#: Result columns as they are staged: digests and fingerprints as bytes.
FOUND = (
    "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
BYTES = ["edited_sha256", "fingerprint", "edited_fingerprint"]


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles in a row, and where each text's begin."""
    data, bounds = ta.flat(texts)
    words = ta.words_of(data, bounds)
    sequence = ta.Sequence(ta.hash_spans(data, words.start, words.end))
    n = words.counts
    each = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=ends[1:])
    start = np.arange(ends[-1]) + np.repeat(words.first[:-1] - ends[:-1], each)
    stop = np.minimum(start + size, np.repeat(words.first[1:], each))
    return sequence.span(start, stop), ends


def signatures(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 16-bit values a text."""
    hashes, ends = shingles(texts, size)
    x = hashes >> np.uint64(32)
    least = np.full((len(ends) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint64)
    for low in range(0, len(x), BLOCK):
        part = x[low : low + BLOCK]
        owner = np.searchsorted(ends, np.arange(low, low + len(part)), side="right") - 1
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = owner[begins]
        for p in range(PERMUTATIONS):
            values = (part * FACTORS[p] + SHIFTS[p]) >> np.uint64(32)
            least[rows, p] = np.minimum(least[rows, p], np.minimum.reduceat(values, begins))
    out = (least & np.uint64(0xFFFF)).astype(np.uint16)
    out[np.diff(ends) == 0] = EMPTY
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def written(rows: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, first value first."""
    return [row.tobytes() for row in rows.astype(">u2")]


def compared(texts: list[str], own: np.ndarray, after: list[str], following: np.ndarray) -> dict[str, pa.Array]:
    """The result columns of texts, with the text and the fingerprint behind each."""
    halves = [len(t) // 2 for t in texts]
    changed = [t[: len(t) - h] + a[:h] for t, h, a in zip(texts, halves, after)]
    theirs = signatures(pa.array(changed, pa.large_string()))
    return {
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c.encode()).digest() for c in changed], pa.binary()),
        "fingerprint": pa.array(written(own), pa.binary()),
        "edited_fingerprint": pa.array(written(theirs), pa.binary()),
        "near_edited": pa.array(likeness(own, theirs), pa.float64()),
        "near_next": pa.array(likeness(own, following), pa.float64()),
    }


def _neighbours(rows: DataFrame) -> DataFrame:
    """Results of all rows but the last of each task, and the first and last text of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last: tuple | None = None  # key, hash, text and fingerprint still waiting for a neighbour
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                keys, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = [t or "" for t in part.column(2).to_pylist()]
                marks = signatures(part.column(2))
                if last is None:
                    yield edge("first", keys[0], hashes[0], texts[0], task)
                else:
                    keys, hashes, texts = [last[0], *keys], [last[1], *hashes], [last[2], *texts]
                    marks = np.concatenate([last[3], marks])
                last = keys[-1], hashes[-1], texts[-1], marks[-1:]
                if len(texts) > 1:
                    yield block("row", task, keys[:-1], hashes[:-1], compared(texts[:-1], marks[:-1], texts[1:], marks[1:]))
        if last is not None:
            yield edge("last", *last[:3], task)

    names = [field.split()[0] for field in FOUND.split(", ")]
    key_type = rows.schema["k"].dataType
    arrow = to_arrow_type(key_type)

    def block(kind: str, task: int, keys: list, hashes: list, found: dict, text: list | None = None) -> pa.RecordBatch:
        n = len(keys)
        columns = [
            pa.array([kind] * n), pa.array([task] * n, pa.int32()), pa.array(keys, arrow), pa.array(hashes, pa.int64()),
            *(found[name] for name in names), pa.array(text or [None] * n, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["kind", "task", "k", "h", *names, "s"])

    def edge(kind: str, key, mark: int, text: str, task: int) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2]
        nothing = {name: pa.nulls(1, t) for name, t in zip(names, kinds)}
        return block(kind, task, [key], [mark], nothing, [text])

    return rows.mapInArrow(run, f"kind string, task int, k {key_type.simpleString()}, h long, {FOUND}, s string")


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, h, ...) of every row: its fingerprint, that of its edited text, and their likeness, and
    the likeness to the row behind it (the first one behind the last). ``h`` is the text's hash.

    In the edited text the last half of the characters is replaced by as many (or all) from the
    start of the text behind it.
    """
    spark = docs.sparkSession
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.alias("s"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("copy", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(tasks, "k", "h", "copy").sortWithinPartitions("k", "h").select("k", "h", "s")
    found = materialise(_neighbours(ordered), "neighbours")

    first, last = (found.where(F.col("kind") == kind) for kind in ("first", "last"))
    held = sorted(row["task"] for row in first.select("task").collect())
    order = spark.createDataFrame(list(zip(held, held[1:] + held[:1])), "task int, behind int")
    behind = first.select(F.col("task").alias("behind"), F.col("s").alias("after"))
    edges = last.select("task", "k", "h", "s").join(order, "task").join(behind, "behind").select("k", "h", "s", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                columns = compared(
                    part.column(2).to_pylist(), signatures(part.column(2)),
                    part.column(3).to_pylist(), signatures(part.column(3)),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns.values()], ["k", "h", *columns]
                )

    kind = rows.schema["k"].dataType.simpleString()
    ends = edges.mapInArrow(close, f"k {kind}, h long, {FOUND}")
    whole = found.where("kind = 'row'").select(*ends.columns).unionByName(ends)
    return whole.withColumns({c: F.lower(F.hex(c)) for c in BYTES})


def bands(fingerprint: Column) -> Column:
    """One key for each band of a fingerprint in bytes."""
    step = VALUE_BYTES * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring(fingerprint, 1 + i * step, step)) for i in range(BANDS)])


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(k, h, items): the sorted distinct shingle hashes of texts ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                hashes, ends = shingles(part.column("s"))
                sets = [np.unique(hashes[a:b].view(np.int64)) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("h"), pa.array(sets, pa.list_(pa.int64()))], ["k", "h", "items"]
                )

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, h long, items array<long>")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(q, c): pairs of asking classes and others with a common band; of crowded buckets the crowd
    ``g`` of each class ``c`` and the crowds that each ``q`` meets, none where no bucket is crowded.

    A class belongs to the crowd of its fullest bucket. The pairs leave out all members of crowds
    that ``q`` meets.
    """
    every = classes.select("c", "asked", F.explode(bands(F.col("fingerprint"))).alias("band"))
    asked = every.where("asked").groupBy("band").agg(F.count("*").alias("n_asked"))
    met = materialise(every.join(asked, "band"), "met")
    full = met.groupBy("band").agg(F.count("*").alias("n_met"), F.first("n_asked").alias("n_asked"))
    full = small_table(full.where(F.col("n_met") * F.col("n_asked") > LISTED).select("band", "n_met"))
    listed = met.join(full, "band", "left_anti")
    looks = listed.where("asked").select(F.col("c").alias("q"), "band")
    pairs = looks.join(listed.select("c", "band"), "band").where("q <> c").select("q", "c").distinct()
    if full.isEmpty():
        return materialise(pairs, "candidates"), None, None

    crowded = met.join(full, "band").select("c", "asked", "band", "n_met")
    home = materialise(crowded.groupBy("c").agg(F.max(F.struct("n_met", "band"))["band"].alias("g")), "homes")
    reach = crowded.join(home, "c").select("band", "g").distinct()
    looks = crowded.where("asked").select(F.col("c").alias("q"), "band")
    asking = materialise(looks.join(reach, "band").select("q", "g").distinct(), "asking")
    pairs = pairs.join(home, "c", "left").join(asking, ["q", "g"], "left_anti").select("q", "c")
    return materialise(pairs, "candidates"), home, asking


def matches(docs: DataFrame, prints: DataFrame, asked: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(fingerprint, n_near): for each fingerprint with rows that ``asked`` (a condition on ``k``)
    chooses, how many rows have a Jaccard similarity of at least 0.8, the row itself not counted.

    ``prints`` holds (k, h, fingerprint) of every row of ``docs``.
    """
    least = F.min(F.struct("k", "h"))
    prints = prints.withColumn("fingerprint", F.unhex("fingerprint"))
    classes = prints.groupBy("fingerprint").agg(
        F.count("*").alias("n"), least.alias("of"), F.max(F.coalesce(asked, F.lit(False))).alias("asked")
    )
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    pairs, home, asking = candidates(classes)
    needed = pairs.select(F.col("q").alias("c")).unionByName(pairs.select("c"))
    if home is not None:
        needed = needed.unionByName(home.select("c"))
    sources = small_table(classes.join(needed.distinct(), "c").select("c", "of.k", "of.h"))
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.alias("s"))
    same = rows["k"].eqNullSafe(sources["k"]) & (rows["h"] == sources["h"])
    sets = shingle_sets(rows.join(sources, same, "left_semi")).join(
        sources.select("c", F.col("k").alias("k2"), F.col("h").alias("h2")),
        F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")),
    )
    sets = materialise(sets.select("c", "items").dropDuplicates(["c"]), "sets")
    crowded = None
    if home is not None:
        crowded, more = crowd_counts(home, asking, sets, classes)
        pairs = pairs.unionByName(more)
    theirs = sets.select(F.col("c").alias("q"), F.col("items").alias("asking"))
    verified = pairs.join(sets, "c").join(theirs, "q")
    alike = near(F.size("items"), F.size("asking"), F.size(F.array_intersect("items", "asking")))
    counted = verified.where(alike).join(classes.select("c", "n"), "c").select("q", F.col("n").alias("others"))
    if crowded is not None:
        counted = counted.unionByName(crowded)
    counted = counted.groupBy("q").agg(F.sum("others").alias("others"))
    name = F.lower(F.hex("fingerprint")).alias("fingerprint")
    asking = classes.where("asked").select(name, "n", F.col("c").alias("q"))
    return asking.join(counted, "q", "left").select(
        "fingerprint", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_near")
    )


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses; ``n_near`` for the stated query set, ids divisible by 50."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = edited(docs)
    asked = F.col("k") % 50 == 0
    near = matches(docs, found.select("k", "h", "fingerprint"), asked)
    # only asked rows meet the counts, one for each fingerprint; copies are spread by their number
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chosen = found.where(asked).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
    chosen = chosen.join(near, ["fingerprint", "salt"])
    rest = found.where(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    whole = rest.unionByName(chosen.select(*rest.columns))
    return whole.drop("h").withColumnRenamed("k", "doc_id")
