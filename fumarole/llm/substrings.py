"""Substring deduplication by seed and extend over winnowed anchors.

A window is ``size`` consecutive words of one text. Each window selects the smallest hash among
its ``gram``-word grams as its anchor, so two equal windows always share their anchor. Consecutive
windows with one anchor form a run: the anchor extended both ways as far as it stays selected.

1. One pass writes the runs (anchor, hash of all words of the run, place).
2. Runs whose anchor occurs once in the corpus are dropped; the join carries no text.
3. Equal runs are grouped. A group of two or more is a repeat as a whole, and its members need
   no further look, however many they are.
4. Where different runs share an anchor they may still share a part. One member of each such
   group emits its windows; windows met twice are repeats.
5. The spans of each text are merged into maximal repeats and cut from it.

Both window hashes have 64 bits, and runs must agree in anchor and run hash. No step gathers the
places of an anchor, so a passage in a third of all texts is a counter, not a list. All joins are
equi-joins on hashes or on the text's key and 96 bits of two hashes of the text. Rows that agree
in those are copies: they have the same repeats, which are made distinct before they are listed.

Defined cases: a null or empty text, and one shorter than a window, loses nothing; rows repeated
with the same key and text are repeats of each other; rows with a null key are kept apart by
their text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.llm import textarrays as ta
from fumarole.session import materialise

SIZE = 35
GRAM = 8
#: What names a text: its key and two hashes.
IDENTITY = ["k", "t", "u"]
#: Bits of a gram's place that break ties between equal hashes.
PLACE_BITS = np.uint64((1 << 20) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    best, have = values, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return best


def runs_of(hashes: np.ndarray, first: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, for texts whose words begin at ``first``."""
    starts = ta.window_starts(first, size)
    names = ("anchor", "run", "doc", "start", "n", "loops")
    if not len(starts):
        return {name: np.zeros(0, np.int64) for name in names}
    sequence = ta.Sequence(hashes)
    places = np.arange(len(hashes) - gram + 1)
    grams = sequence.span(places, places + gram)
    rank = grams & ~PLACE_BITS
    tie = places.astype(np.uint64) & PLACE_BITS
    width = size - gram + 1
    low = sliding_min(rank | tie, width)[starts] & PLACE_BITS
    high = (sliding_min(rank | (tie ^ PLACE_BITS), width)[starts] & PLACE_BITS) ^ PLACE_BITS
    from_start = starts.astype(np.uint64)
    leftmost = starts + ((low - from_start) & PLACE_BITS).astype(np.int64)
    rightmost = starts + ((high - from_start) & PLACE_BITS).astype(np.int64)
    anchor = grams[leftmost]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    begin, stop = starts[head], starts[tail] + size
    doc = np.searchsorted(first, begin, side="right") - 1
    return {
        "anchor": anchor[head].view(np.int64),
        "run": sequence.span(begin, stop).view(np.int64),
        "doc": doc,
        "start": begin - first[doc],
        "n": tail - head + 1,
        # the anchor occurs more than once in the run, so windows may repeat inside it
        "loops": leftmost[head] != rightmost[tail],
    }


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and where each text's words begin."""
    data, bounds = ta.flat(texts)
    words = ta.words_of(data, bounds)
    return ta.hash_spans(data, words.start, words.end), words.first


def run_rows(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, run, k, t, u, start, n, loops) of every run; rows hold key, tags and text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                runs = runs_of(*hashed_words(part.column("s")), size, gram)
                doc = pa.array(runs["doc"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs["anchor"]),
                        pa.array(runs["run"]),
                        *(part.column(c).take(doc) for c in IDENTITY),
                        pa.array(runs["start"], pa.int32()),
                        pa.array(runs["n"], pa.int32()),
                        pa.array(runs["loops"].astype(bool)),
                    ],
                    ["anchor", "run", *IDENTITY, "start", "n", "loops"],
                )

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(
        emit, f"anchor long, run long, k {kind}, t long, u int, start int, n int, loops boolean"
    )


def window_rows(rows: DataFrame, size: int) -> DataFrame:
    """(w1, w2, weight, k, t, u, start) of all windows of the runs listed with each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                hashes, first = hashed_words(part.column("s"))
                runs = part.column("runs")
                owner = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy())
                start, n, weight = (x.to_numpy() for x in runs.flatten().flatten())
                n = n.astype(np.int64)
                edges = np.cumsum(n) - n
                step = np.arange(n.sum()) - np.repeat(edges, n)
                within = np.repeat(start, n) + step
                place = within + np.repeat(first[owner], n)
                hashes2 = ta.mix(hashes ^ np.uint64(0xA0761D6478BD642F))
                doc = pa.array(np.repeat(owner, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(
                            pa.array(ta.Sequence(h).span(place, place + size).view(np.int64))
                            for h in (hashes, hashes2)
                        ),
                        pa.array(np.repeat(weight, n)),
                        *(part.column(c).take(doc) for c in IDENTITY),
                        pa.array(within, pa.int32()),
                    ],
                    ["w1", "w2", "weight", *IDENTITY, "start"],
                )

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(emit, f"w1 long, w2 long, weight long, k {kind}, t long, u int, start int")


def same_text(a: DataFrame, b: DataFrame) -> object:
    return a["k"].eqNullSafe(b["k"]) & (a["t"] == b["t"]) & (a["u"] == b["u"])


def tags(text: Column) -> list[Column]:
    """Two hashes of a text, which with its key name it."""
    return [F.xxhash64(text).alias("t"), F.hash(text).alias("u")]


def repeat_spans(rows: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(k, t, u, spans): word spans of each text that repeat somewhere, as (start, length).

    ``rows`` holds key ``k``, the tags ``t`` and ``u`` of the text, and the text ``s``. The spans
    may overlap; together they are all windows that occur twice.
    """
    runs = materialise(run_rows(rows, size, gram), "runs")
    often = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.max("loops").alias("l"))
    often = often.where("c > 1 or l").select("anchor")
    seeds = materialise(runs.join(often, "anchor", "left_semi"), "seeds")

    groups = seeds.groupBy("anchor", "run").agg(
        F.count("*").alias("weight"),
        F.max("loops").alias("loops"),
        F.first(F.struct(*IDENTITY, "start", "n")).alias("one"),
    )
    groups = materialise(groups.select("anchor", "run", "weight", "loops", "one.*"), "groups")
    shared = groups.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    open_ = groups.join(shared.withColumn("many", F.lit(True)), "anchor", "left")
    open_ = open_.where("many or loops")
    listed = open_.groupBy(*IDENTITY).agg(
        F.collect_list(F.struct("start", "n", "weight")).alias("runs")
    )
    texts = rows.join(listed, same_text(rows, listed)).select(*[rows[c] for c in IDENTITY], "s", "runs")
    # rows that repeat key and text would emit their windows twice; their runs have weight two
    windows = materialise(window_rows(texts, size), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("c")).where("c > 1")
    parts = windows.where("weight = 1").join(twice, ["w1", "w2"], "left_semi")

    whole = seeds.join(groups.where("weight > 1").select("anchor", "run"), ["anchor", "run"], "left_semi")
    spans = whole.select(*IDENTITY, "start", (F.col("n") + (size - 1)).alias("words")).unionByName(
        parts.select(*IDENTITY, "start", F.lit(size).alias("words"))
    )
    # copies bring the same spans: after this a list holds those of one text
    spans = spans.distinct()
    return spans.groupBy(*IDENTITY).agg(F.collect_list(F.struct("start", "words")).alias("spans"))


def cut(texts: pa.Array, spans: pa.Array) -> dict[str, pa.Array]:
    """Texts without the words of their spans, with counts and a digest of what is left."""
    data, bounds = ta.flat(texts)
    words = ta.words_of(data, bounds)
    lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    start, size = (x.to_numpy().astype(np.int64) for x in spans.flatten().flatten())
    start = start + np.repeat(words.first[:-1], lengths)
    gone = ta.covered(len(words), start, start + size)

    # a word goes with the white space behind it, up to the next word or the end of the text
    stops = np.append(words.start[1:], len(data))
    last = words.first[1:][words.counts > 0] - 1
    stops[last] = bounds[1:][words.counts > 0]
    keep = ~ta.covered(len(data), words.start[gone], stops[gone])

    stay = ~gone
    joined, edges = ta.spaced(data, words.start[stay], words.end[stay])
    left = np.zeros(len(words.first), np.int64)
    np.cumsum(ta.per_text(stay, words.first), out=left[1:])
    cuts = zip(edges[left[:-1]].tolist(), edges[left[1:]].tolist())
    digests = [hashlib.sha256(joined[a : max(a, b - 1)]).hexdigest() for a, b in cuts]
    return {
        "n_words": pa.array(words.counts),
        "n_removed": pa.array(words.counts - np.diff(left)),
        "kept_sha256": pa.array(digests, pa.string()),
        "kept_text": ta.select_bytes(data, bounds, keep),
    }


CUT = {
    "n_words": "long",
    "n_removed": "long",
    "kept_sha256": "string",
    "kept_text": "string",
}


def cut_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, gram: int = GRAM
) -> DataFrame:
    """``docs`` with, for each text, its word count, the words removed, the text left and the
    SHA-256 of the words left, joined by one space. Columns of these names are replaced."""
    source = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key).alias("k"), *tags(source), source.alias("s"))
    spans = repeat_spans(rows, size, gram)
    kept = docs.select(*[c for c in docs.columns if c not in CUT or c in (text, key)])
    inner = [f"c{i}" for i in range(len(kept.columns))]
    source = F.coalesce(inner[kept.columns.index(text)], F.lit(""))
    plain = kept.toDF(*inner).select("*", F.col(inner[kept.columns.index(key)]).alias("k"), *tags(source))
    joined = plain.join(spans, same_text(plain, spans), "left").select(*inner, "spans")
    body = inner[kept.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, body):
                found = cut(part.column(body), part.column("spans"))
                columns = [part.column(c) for c in inner]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(found[c] for c in CUT)], [*inner, *CUT]
                )

    schema = [f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, kept.schema)]
    schema += [f"{c} {kind}" for c, kind in CUT.items()]
    return joined.mapInArrow(run, ", ".join(schema)).toDF(*kept.columns, *CUT)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
