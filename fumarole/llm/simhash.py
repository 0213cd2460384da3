"""SimHash near-duplicates by a segment-popcount embedding.

Texts become 64-bit fingerprints in one narrow pass. Equal fingerprints form one class, so copies
never meet in pairs. A class is embedded as the bit counts of its two-bit segments; the Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints. The vector is
cut into ``distance // 2 + 1`` parts: two classes within ``distance`` differ by at most one in
some part, so it is enough to join grid cells that are equal or neighbours in one part. A step to
a neighbour changes the parity of the part's bits, hence only classes of even parity look around.
Candidates must pass the Manhattan bound over the whole vector and then the exact bit distance.
Links become components, and each document gets the smallest document id of its component.

Defined cases: a null text or one without words has fingerprint zero and links like any other;
repeated rows are equal fingerprints; a null id never becomes a component id (a component whose
rows all lack an id has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.llm import textarrays as ta
from fumarole.llm.components import components
from fumarole.session import materialise

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 18
#: Copies of a class row that share the rows of a frequent fingerprint.
SALTS = 8

#: The lower bit of every segment.
LOW_BITS = 0x5555555555555555

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    data, bounds = ta.flat(texts)
    data = LOWER[data]
    words = ta.words_of(data, bounds)
    joined, edges = ta.spaced(data, words.start, words.end)
    counts = words.counts
    size = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    ones = np.zeros((len(size), 64), np.int64)
    for low in range(0, int(ends[-1]), BLOCK):
        high = min(low + BLOCK, int(ends[-1]))
        owner = np.searchsorted(ends, np.arange(low, high), side="right") - 1
        first = np.arange(low, high) - ends[owner] + words.first[owner]
        last = np.minimum(first + shingle, words.first[owner + 1])
        spans = zip(edges[first].tolist(), (edges[last] - 1).tolist())
        values = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans)
        hashes = np.fromiter(values, np.uint64, high - low)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        ones[owner[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    on = 2 * ones > size[:, None]
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_rows(docs: DataFrame, text: str, key: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, text):
                found = fingerprints(part.column(text), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def popcounts(fp: Column) -> Column:
    """The bit counts (0 to 2) of the 32 two-bit segments, packed two bits each."""
    low = F.lit(LOW_BITS)
    high = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(high).bitwiseAND(low)
    two = fp.bitwiseAND(high).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def part_places(distance: int) -> list[list[int]]:
    """Bit places of the segments of each part of the vector."""
    parts = distance // 2 + 1
    cuts = [round(i * SEGMENTS / parts) for i in range(parts + 1)]
    return [[2 * s for s in range(a, b)] for a, b in zip(cuts, cuts[1:])]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def mask_of(places: list[int]) -> int:
    return signed(sum(3 << p for p in places))


def probes(vector: Column, places: list[int]) -> Column:
    """The cell of a vector in one part and, for even parity, all cells one step away."""
    cell = vector.bitwiseAND(F.lit(mask_of(places)))
    steps = []
    for p in places:
        cleared = cell.bitwiseAND(F.lit(signed(((1 << 64) - 1) ^ (3 << p))))
        one = F.shiftrightunsigned(vector, p).bitwiseAND(F.lit(1).cast("long")) == 1
        steps.append(F.when(one, cleared).otherwise(cleared.bitwiseOR(F.lit(signed(1 << p)))))
        steps.append(F.when(one, cleared.bitwiseOR(F.lit(signed(2 << p)))))
    around = F.when(parity(vector, places) == 0, F.array(*steps)).otherwise(F.array())
    return F.filter(F.concat(F.array(cell), around), lambda x: x.isNotNull())


def parity(vector: Column, places: list[int]) -> Column:
    """Parity of the bits counted in one part: that of its segments that count one."""
    odd = F.lit(signed(sum(1 << p for p in places)))
    return F.bit_count(vector.bitwiseAND(odd)) % 2


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed vectors.

    With the counts 0, 1, 2 spread as 00, 01, 11 it is the number of unequal bits.
    """
    low = F.lit(LOW_BITS)
    spread = [x.bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(low)) for x in (a, b)]
    return F.bit_count(spread[0].bitwiseXOR(spread[1]))


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): every pair of different fingerprints within the distance."""
    vectors = classes.select("fp", popcounts(F.col("fp")).alias("vector"))
    probe = home = None
    for i, places in enumerate(part_places(distance)):
        mask = F.lit(mask_of(places))
        own = F.col("vector").bitwiseAND(mask)
        around = F.explode(probes(F.col("vector"), places)).alias("cell")
        looks = vectors.select(F.lit(i).alias("part"), around, "fp", "vector")
        lies = vectors.select(
            F.lit(i).alias("part"),
            own.alias("cell"),
            F.col("fp").alias("fp2"),
            F.col("vector").alias("vector2"),
            mask.alias("mask"),
        )
        probe = probe.unionByName(looks) if i else looks
        home = home.unionByName(lies) if i else lies
    pairs = probe.join(home, ["part", "cell"])
    # a pair in one cell meets twice; a pair in neighbouring cells only from its even side
    same_cell = F.col("vector").bitwiseAND(F.col("mask")) == F.col("cell")
    near = pairs.where(
        (~same_cell | (F.col("fp") < F.col("fp2")))
        & (manhattan(F.col("vector"), F.col("vector2")) <= distance)
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    )
    return near.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """(key, fp, component): fingerprint and smallest key reachable over links, for every row."""
    rows = materialise(fingerprint_rows(docs, text, key, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    roots = components(links(classes, distance))
    # roots of stars are nodes too: give every linked class its root
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = classes.join(members, classes.fp == members.node, "left")
    smallest = (
        linked.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    )
    known = linked.join(smallest, "root", "left").where("n > 1 or root is not null")
    known = known.select("fp", F.coalesce("of_root", "least").alias("component"))
    # rows of a frequent fingerprint are spread over several copies of its class
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    found = rows.withColumn("salt", salt).join(salted, ["fp", "salt"], "left")
    return found.select(key, "fp", F.coalesce("component", key).alias("component"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps its smallest key.

    Rows without a key stay. Of rows that repeat the smallest key all stay.
    """
    found = near_duplicates(docs.select(key, text), text, key)
    losers = found.where(F.col(key) != F.col("component")).select(key).distinct()
    return docs.join(losers, key, "left_anti")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Exactly one row of ``docs`` for each component: that with the smallest key, a null key last,
    then the smallest fingerprint.

    The rows are written once with a number and a fingerprint. The number tells apart rows that
    repeat a key or have none, and stays the same when a task is run again.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own, body = (inner[docs.columns.index(c)] for c in (key, text))
    plain = docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, body):
                found = fingerprints(part.column(body)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found)], [*part.schema.names, "fp"]
                )

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema]
    rows = materialise(plain.mapInArrow(run, ", ".join([*schema, "fp long"])), "numbered")
    best = F.min(F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("key"), "row"))
    classes = rows.groupBy("fp").agg(best.alias("best"), F.count("*").alias("n"))
    classes = materialise(classes, "classes")
    roots = components(links(classes.select("fp")))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = classes.join(members, classes.fp == members.node, "left").where("n > 1 or root is not null")
    linked = linked.select("fp", "best", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct("best.none", "best.key", "fp", "best.row"))
    stays = linked.groupBy("root").agg(first.alias("first"))
    stays = linked.select("fp", "root").join(stays, "root").select("fp", F.col("first.row").alias("stays"))
    # rows of a frequent fingerprint are spread over several copies of its class
    salted = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    lost = rows.select("row", "fp").withColumn("salt", salt).join(salted, ["fp", "salt"])
    lost = lost.where("row != stays").select("row")
    return rows.join(lost, "row", "left_anti").select(*inner).toDF(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
