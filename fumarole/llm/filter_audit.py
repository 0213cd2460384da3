"""Interaction audit of five document filters by incremental retraction streaming.

A stream reads all files of ``documents`` in available-now micro-batches. Filters A to D depend on
one text and are DataFrame expressions. E, a text that a smaller document id holds too, depends on
the whole table: keyed state keeps for each text the smallest id met so far and what was counted
for the rows that have it. When a smaller id arrives, those rows now fail E, so their earlier masks
are retracted from the counters and counted again with E.

The state's key is a bucket of text hashes, about ``TEXTS_PER_BUCKET`` of them, so one call serves
many texts with array operations and the number of buckets grows with the table. Copies are
combined inside every task before they are shuffled (rows of a text by part, labels and id order),
so a text that a third of all rows share sends a few rows a task. Changes of the counters are
appended to a table by the stream's own sink, exactly once, also when a batch is run again. The
state store is the session's (RocksDB where the state exceeds memory).

The counters of a part are 32 masks. All 120 orders of the filters and their steps follow from
those, without another pass over documents.

Defined cases: a null text counts as empty and a null source as the part ``""``; repeated rows
count each, and rows that share a text's smallest id all pass E; a null id is larger than any
other, equal to other null ids, and has no label; of several labels of an id the largest counts;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fumarole.session import stage_path

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = "[#$%&*|]"
#: Mask of the filter that state decides.
COPY = 1 << FILTERS.index("E")

#: Texts that share one state.
TEXTS_PER_BUCKET = 1000
#: Micro-batches in which the files are processed, at most.
BATCHES = 6
#: Rows that a task combines at once.
COMBINED_ROWS = 100_000

TEXT = ["k1", "k2"]
ID = ["none", "id"]
GROUP = ["part", "mask", "good", "toxic"]
#: Rows of one text with one id order, part, mask and labels, and how many they are.
COUNTED = "bucket long, k1 long, k2 long, none boolean, id long, part string, mask int, good int, toxic int, n long"
CHANGES = "part string, mask int, n long, good long, toxic long"


def masks(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        size < MIN_WORDS,
        100 * distinct < DISTINCT_PERCENT * size,
        100 * capitals.cast("long") > CAPITAL_PERCENT * F.char_length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))


def facts(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """One narrow row for each document: text hashes, id, part, mask and labels."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce("source", F.lit("")).alias("part"),
        masks(text).alias("mask"),
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"),
        F.max((F.col("toxic") == 1).cast("int")).alias("t"),
    )
    return rows.join(known, rows.id == known.of, "left").select(
        F.pmod("k1", F.lit(buckets)).alias("bucket"),
        *TEXT,
        F.col("id").isNull().alias("none"),
        F.coalesce("id", F.lit(0)).alias("id"),
        "part",
        "mask",
        F.coalesce("q", F.lit(0)).alias("good"),
        F.coalesce("t", F.lit(0)).alias("toxic"),
        F.lit(1).cast("long").alias("n"),
    )


def first_ids(rows: pd.DataFrame) -> pd.Series:
    """Which rows have the smallest id of their text."""
    ordered = rows.sort_values([*TEXT, *ID], kind="stable")
    least = ordered.drop_duplicates(TEXT)[[*TEXT, *ID]]
    merged = rows[[*TEXT]].merge(least, on=TEXT, how="left")
    return pd.Series(
        ((merged["none"].to_numpy() == rows["none"].to_numpy()) & (merged["id"].to_numpy() == rows["id"].to_numpy())),
        index=rows.index,
    )


def combined(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one task with copies added up.

    Of a text's rows with one part and labels, those with the smallest id of the task stay under
    that id; all others are sure to fail E and are added up under the largest of their ids.
    """
    later = ~first_ids(rows)
    rows = rows.assign(later=later)
    if later.any():
        last = rows.loc[later].sort_values([*TEXT, *ID], kind="stable").drop_duplicates(TEXT, keep="last")
        last = rows.loc[later, TEXT].merge(last[[*TEXT, *ID]], on=TEXT, how="left")
        rows.loc[later, "none"] = last["none"].to_numpy()
        rows.loc[later, "id"] = last["id"].to_numpy()
    keys = ["bucket", *TEXT, *ID, *GROUP]
    return rows.groupby(keys, sort=False, as_index=False)["n"].sum()[[*keys, "n"]]


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size > COMBINED_ROWS:
            kept = combined(pd.concat(held, ignore_index=True))
            held, size = [kept], len(kept)
            if size > COMBINED_ROWS // 2:
                yield kept
                held, size = [], 0
    if held:
        yield combined(pd.concat(held, ignore_index=True))


def retracted(state: pd.DataFrame, arrived: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The next state of a bucket and the changes of the counters.

    The state holds the rows with the smallest id of each text. Rows of the state that lose that
    place are taken back and counted again with E; rows that arrive are counted by their place.
    """
    rows = pd.concat([state.assign(old=True), arrived.assign(old=False)], ignore_index=True)
    first = first_ids(rows)
    new, lost = rows[~rows["old"]], rows[rows["old"] & ~first]
    mask = new["mask"].where(first[~rows["old"]], new["mask"] | COPY)
    moved = [new.assign(mask=mask), lost.assign(n=-lost["n"]), lost.assign(mask=lost["mask"] | COPY)]
    changes = pd.concat(moved, ignore_index=True)
    changes = changes.assign(good=changes["good"] * changes["n"], toxic=changes["toxic"] * changes["n"])
    changes = changes.groupby(["part", "mask"], as_index=False)[["n", "good", "toxic"]].sum()
    kept = rows[first].groupby([*TEXT, *ID, *GROUP], sort=False, as_index=False)["n"].sum()
    return kept, changes[(changes[["n", "good", "toxic"]] != 0).any(axis=1)]


def packed(state: pd.DataFrame) -> bytes:
    table = pa.RecordBatch.from_pandas(state, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as source:
        return source.read_pandas()


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    arrived = pd.concat(list(batches), ignore_index=True).drop(columns="bucket")
    known = unpacked(state.get[0]) if state.exists else arrived.iloc[:0]
    kept, changes = retracted(known, arrived)
    state.update((packed(kept),))
    yield changes[["part", "mask", "n", "good", "toxic"]]


def counters(
    spark: SparkSession,
    documents: str,
    labels: DataFrame,
    batches: int = BATCHES,
    texts_per_bucket: int = TEXTS_PER_BUCKET,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters.

    ``documents`` is a folder of Parquet files (or one file), streamed in ``batches`` micro-batches.
    """
    table = spark.read.parquet(documents)
    files = table.inputFiles()
    buckets = max(1, table.count() // texts_per_bucket)
    per_batch = max(1, -(-len(files) // batches))
    if len(files) == 1 and posixpath.basename(files[0]) == posixpath.basename(documents):
        documents = f"{documents[:-1]}[{documents[-1]}]"  # a stream reads one file only as a pattern
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_batch).parquet(documents)
    docs = stream.select(F.col(text).alias("text"), F.col(key).alias("doc_id"), F.col(source).alias("source"))
    counted = facts(docs, labels, buckets).mapInPandas(combine, COUNTED)
    changes = counted.groupBy("bucket").applyInPandasWithState(
        update, CHANGES, "rows binary", "append", GroupStateTimeout.NoTimeout
    )
    out, checkpoint = stage_path(spark, "changes"), stage_path(spark, "audit-state")
    query = (
        changes.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.schema(CHANGES).parquet(out)
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    return found.groupBy("part", "mask").agg(*sums).where("n <> 0")


def steps() -> Column:
    """All orders and their steps, as an array of constant size."""
    each = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for place, at in enumerate(order):
            before = sum(1 << i for i in order[:place])
            each.append(f"('{name}', {place + 1}, {1 << at}, {before})")
    fields = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    return F.expr(f"cast(array({', '.join(each)}) as {fields})")


def audit(found: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counters."""
    held = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    rows = held.select("part", "counts", F.explode(steps()).alias("s")).select("part", "counts", "s.*")
    own, before = F.col("own"), F.col("before")
    orders = 120

    def total(field: str, where, weight=lambda c: F.lit(1)) -> Column:
        return F.aggregate(
            F.filter("counts", where), F.lit(0).cast("long"), lambda acc, c: acc + c[field] * weight(c)
        ).alias(field)

    fails = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    removed = lambda c: fails(c, own) & ~fails(c, before)
    # a document that fails f filters is removed by each of them in an f-th of all orders
    each = lambda c: F.floor(F.lit(orders) / F.bit_count(c["mask"]))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda c: ~fails(c, own.bitwiseOR(before))).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda c: fails(c, own) & fails(c, before)).alias("redundant"),
        total("n", lambda c: c["mask"] == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", lambda c: fails(c, own), each).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(counters(spark, f"{sf_dir}/documents.parquet", labels))
