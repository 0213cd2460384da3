"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are brought to a normal form: lower case, runs of ASCII letters, digits and all
non-ASCII characters, joined by one space. An item of ``n`` bytes may differ from a passage by
``budget`` edits (inserted, dropped or replaced bytes), a tenth of its length. It is split into
``budget + 1`` pieces; whatever the edits, one piece is left whole. One narrow pass hashes every
place of a text, looks the hashes up among the pieces' heads, compares whole pieces, and verifies
the surroundings of each hit with Myers' bit-parallel distance.

Pieces in groups of two and of four sort out most hits before that. A match of at most ``budget``
edits has fewer edits than pieces in some group of four, then in some pair in it, then in some
piece in that; so a hit counts only if its pair and its group are that near.

The items are a stated query set. Beyond one block of bounded size they are cut into blocks by
Spark, in a stage table. Each block is fetched, sent to the tasks, searched in a pass of its own
whose findings are written, and released before the next, so neither the driver nor a task holds
more than a block of them. Hits of one item in one text are merged before verification, so its cost is bounded by the
length of the text however often a piece occurs there.

Defined cases: null texts and items count as empty and match nothing; an item without letters or
digits matches nothing; items shorter than ten bytes must occur exactly; equal items are all
reported; repeated rows are reported each; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.llm import textarrays as ta
from fumarole.session import materialise, small_table

#: Edits allowed as a share of an item's length.
RATE = 0.10
#: Most bytes of a piece's head; at this rate the pieces of long items have nine or ten bytes.
PIECE = 9
#: Pieces in the groups that are tested before a whole item, each a multiple of the one before.
GROUPS = (2, 4)
#: Tested places that are remembered, as repeated passages are tested again and again.
TESTED = 100_000
#: Bytes of normal items in one block.
BLOCK_BYTES = 8 << 20
#: Bits of the table that sorts out most places before the look-up.
TABLE_BITS = 22

#: What a byte of lower-cased text becomes: itself, or a space.
NORMAL = np.arange(256, dtype=np.uint8)
for _code in range(128):
    if not chr(_code).isalnum():
        NORMAL[_code] = 0x20


def normal(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Normal forms one after another (each word with a space behind it), the bounds of the
    texts in them, where each word begins, and where each text's words begin."""
    data, bounds = ta.flat(pc.utf8_lower(texts))
    data = NORMAL[data]
    words = ta.words_of(data, bounds)
    joined, edges = ta.spaced(data, words.start, words.end)
    return joined, edges[words.first], edges, words.first


def edit_budget(length: int, rate: float = RATE) -> int:
    return max(0, min(int(length * rate), length - 1))


@dataclass
class Items:
    """A block of benchmark items and the look-up tables of their pieces."""

    ids: list
    texts: list[bytes]
    budgets: list[int]
    cuts: list[list[int]] = field(default_factory=list)
    tables: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, ids: list, texts: list[str | None], rate: float = RATE, piece: int = PIECE) -> Items:
        joined, bounds, _, _ = normal(pa.array(texts, pa.string()))
        forms = [joined[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        block = cls(list(ids), forms, [edit_budget(len(f), rate) for f in forms])
        heads: dict[int, list[tuple[int, int, int]]] = {}
        for i, form in enumerate(forms):
            parts = block.budgets[i] + 1
            cuts = [len(form) * j // parts for j in range(parts + 1)]
            block.cuts.append(cuts)
            for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    heads.setdefault(min(piece, b - a), []).append((i, j, a))
        for width, pieces in sorted(heads.items()):
            place = np.array(pieces, np.int64)
            text = np.frombuffer(b"".join(forms[i][a : a + width] for i, _, a in pieces), np.uint8)
            hashes = place_hashes(text, width)[::width]
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[hashes >> np.uint64(64 - TABLE_BITS)] = True
            block.tables.append((width, hashes[order], place[order], table))
        return block


def place_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on."""
    starts = np.arange(max(0, len(data) - width + 1))
    return ta.Sequence(ta.BYTE_VALUES[data]).span(starts, starts + width)


def masks_of(pattern: bytes) -> list[int]:
    masks = [0] * 256
    for i, byte in enumerate(pattern):
        masks[byte] |= 1 << i
    return masks


def best_end(pattern: bytes, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """Myers' bit-parallel search: the least edit distance between the pattern and any substring
    of the text (any prefix, if anchored), and the first end of such a substring."""
    size = len(pattern)
    masks, full, top = masks_of(pattern), (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, at = size, 0
    for i, byte in enumerate(text, 1):
        equal = masks[byte]
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = (down | ~(horizontal | up)) & full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 | anchored
        minus = minus << 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
        if score < best:
            best, at = score, i
            if not best:
                break
    return best, at


def groups_near(
    block: Items, item: int, piece: int, joined: bytes, place: int, low: int, high: int, tested: dict
) -> bool:
    """Whether the groups of a piece found whole at ``place`` have fewer edits than pieces."""
    form, cuts = block.texts[item], block.cuts[item]
    had = 1
    for many in GROUPS:
        first = piece - piece % many
        last = min(first + many, len(cuts) - 1)
        slack = last - first - 1
        if last - first > had:
            had = last - first
            a = max(low, place - cuts[piece] + cuts[first] - slack)
            b = min(high, place - cuts[piece] + cuts[last] + slack)
            known = item, first, many, joined[a:b]
            near = tested.get(known)
            if near is None:
                if len(tested) >= TESTED:
                    tested.clear()
                near = tested[known] = best_end(form[cuts[first] : cuts[last]], joined[a:b])[0] <= slack
            if not near:
                return False
    return True


def hits_of(joined: bytes, bounds: np.ndarray, block: Items) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Byte spans to verify, by (text, item), around every place that holds a whole piece."""
    data = np.frombuffer(joined, np.uint8)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    tested: dict[tuple, bool] = {}
    for width, hashes, pieces, table in block.tables:
        here = place_hashes(data, width)
        places = np.flatnonzero(table[here >> np.uint64(64 - TABLE_BITS)])
        low = np.searchsorted(hashes, here[places], side="left")
        many = np.searchsorted(hashes, here[places], side="right") - low
        owner = np.searchsorted(bounds, places, side="right") - 1
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rows = zip(
            np.repeat(places, many).tolist(), np.repeat(owner, many).tolist(), pieces[which].tolist()
        )
        for place, text, (item, piece, offset) in rows:
            form = block.texts[item]
            size = block.cuts[item][piece + 1] - offset
            low, end = int(bounds[text]), int(bounds[text + 1])
            if (
                place + size <= end
                and joined[place : place + size] == form[offset : offset + size]
                and groups_near(block, item, piece, joined, place, low, end, tested)
            ):
                slack = block.budgets[item]
                a = max(low, place - offset - slack)
                found.setdefault((text, item), []).append((a, min(end, place - offset + len(form) + slack)))
    return found


def matches(texts: pa.Array, block: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, word after the last) of the best match of every item
    with every text that holds it within its budget."""
    joined, bounds, edges, first = normal(texts)
    out = []
    for (text, item), spans in sorted(hits_of(joined, bounds, block).items()):
        form, budget = block.texts[item], block.budgets[item]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        best = (budget + 1, 0)
        for a, b in merged:
            distance, end = best_end(form, joined[a:b])
            if distance < best[0]:
                best = (distance, a + end)
        distance, end = best
        if distance <= budget:
            low = max(int(bounds[text]), end - len(form) - budget)
            _, back = best_end(form[::-1], joined[low:end][::-1], anchored=True)
            words = np.searchsorted(edges, [end - back + 1, end], side="left") - [1, 0]
            out.append((text, item, distance, *(int(w - first[text]) for w in words)))
    return out


def item_blocks(items: DataFrame, text: str, key: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.Table, bool]]:
    """(id, s) of the items in blocks of at most ``most`` bytes of text, or of one longer item,
    and whether that is all: a small table, which may be empty, is one block."""
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("s"))
    size = rows.agg(F.sum(F.octet_length("s")), F.count("*")).first()
    total = (size[0] or 0) + 16 * size[1]
    if total <= most:
        yield rows.toArrow(), True
        return

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = taken = 0
        for batch in batches:
            numbers = []
            for n in pc.fill_null(pc.binary_length(batch.column("s")), 0).to_pylist():
                if taken and taken + n + 16 > most:
                    block, taken = block + 1, 0
                taken += n + 16
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], ["id", "s", "part", "block"])

    rows = rows.coalesce(-(-total // (4 * most))).withColumn("part", F.spark_partition_id())
    kind = items.schema[key].dataType.simpleString()
    staged = materialise(rows.mapInArrow(cut, f"id {kind}, s string, part int, block int"), "items")
    for part, block in sorted(map(tuple, staged.select("part", "block").distinct().collect())):
        yield staged.where((F.col("part") == part) & (F.col("block") == block)).select("id", "s").toArrow(), False


def searched(rows: DataFrame, block: pa.Table, rate: float):
    """The findings of one block in the texts ``s`` of rows with keys ``k``, and its broadcast."""
    texts = Items.of(list(range(block.num_rows)), block.column("s").to_pylist(), rate)
    ids = block.column("id").combine_chunks()
    held = rows.sparkSession.sparkContext.broadcast((texts, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids = held.value
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                table = np.array(matches(part.column("s"), texts), np.int32).reshape(-1, 5)
                budgets = [texts.budgets[i] for i in table[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k").take(pa.array(table[:, 0])),
                        ids.take(pa.array(table[:, 1])),
                        pa.array(table[:, 2]),
                        pa.array(budgets, pa.int32()),
                        pa.array(table[:, 3]),
                        pa.array(table[:, 4] - 1),
                    ],
                    ["k", "item", "distance", "budget", "first_word", "last_word"],
                )

    return run, held


def found_in(rows: DataFrame, blocks: Iterable[tuple[pa.Table, bool]], item_kind: str, rate: float) -> DataFrame:
    """All findings in rows (k, s). A block that is all is searched lazily, several are searched and
    written one by one."""
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, item {item_kind}, distance int, budget int, first_word int, last_word int"
    out = None
    for block, alone in blocks:
        run, held = searched(rows, block, rate)
        found = rows.mapInArrow(run, schema)
        if alone:
            return found
        found = materialise(found, "leaks")
        held.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    rate: float = RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item key, distance, budget, first_word, last_word) of every item found in a text."""
    rows = docs.select(key, text).toDF("k", "s")
    blocks = item_blocks(items, item_text, item_key, block_bytes)
    out = found_in(rows, blocks, items.schema[item_key].dataType.simpleString(), rate)
    return out.toDF(key, item_key, *out.columns[2:])


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_key: str = "item_id",
    rate: float = RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item.

    One block of items is a narrow pass. With several, the rows are staged with a number each, and
    the numbers of the rows that hold an item leave them in one join.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    body = inner[docs.columns.index(text)]
    rows = docs.toDF(*inner)
    blocks = item_blocks(items, item_text, item_key, block_bytes)
    block, alone = next(blocks)
    if not alone:
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        texts = rows.select(F.col("row").alias("k"), F.col(body).alias("s"))
        kind = items.schema[item_key].dataType.simpleString()
        dirty = found_in(texts, chain([(block, alone)], blocks), kind, rate).select("k").distinct()
        rows = rows.join(small_table(dirty), F.col("row") == F.col("k"), "left_anti")
        return rows.select(*inner).toDF(*docs.columns)
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema))
    known = Items.of(list(range(block.num_rows)), block.column("s").to_pylist(), rate)
    held = docs.sparkSession.sparkContext.broadcast(known)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, body):
                clean = np.ones(part.num_rows, bool)
                clean[[m[0] for m in matches(part.column(body), held.value)]] = False
                yield part.filter(pa.array(clean))

    return rows.mapInArrow(sift, schema).toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
