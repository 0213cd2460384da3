"""Token ids in binary files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every
id, level 1 the second chunk of those that have one, and so on. A bitmap for each level marks the
ids that go on, and a rank directory counts its ones before every 512 bits. Any token is found by
following ``rank`` from level to level: a few bytes are read, no block is decoded.

Layout of a file (little-endian): ``MAGIC``, then the header (documents, tokens, levels), the
document ids with a flag for null, the first token of each document and the end, and for each
level its number of chunks, the chunks, the bitmap and the directory, each padded to 8 bytes.

Documents are dealt out by range of their id and sorted inside a task, so files follow each other
in ascending order. A task streams its rows and closes a file whenever it holds ``FILE_TOKENS``;
a single text longer than that has a file of its own. Files are written under a temporary name
and renamed, so a repeated task replaces its own files. Only one count a task reaches the driver.

Defined cases: a null or empty text holds the end id alone; repeated rows are written each; rows
with a null id come first; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import functools
import io
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumarole.llm import textarrays as ta
from fumarole.llm.wordcodes import WordCodes
from fumarole.session import materialise, stage_path

MAGIC = b"DAC00001"
HEADER = struct.Struct("<QQQ")
BLOCK_BITS = 512
#: Tokens after which a file is closed.
FILE_TOKENS = 4_000_000
END_ID = 1


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack(keys: list[int | None], ids: np.ndarray, first: np.ndarray) -> bytes:
    """The bytes of one file: ids of documents in order, document ``i`` from ``first[i]`` on."""
    out = [b""]
    rest = ids.astype(np.uint32)
    levels = 0
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint64)
        ranks = np.zeros(len(blocks) + 1, "<u8")
        np.cumsum(blocks, out=ranks[1:])
        out += [struct.pack("<Q", len(rest)), padded(chunks.tobytes())]
        out += [padded(bitmap.tobytes()), ranks.tobytes()]
        levels += 1
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    null = np.array([k is None for k in keys], np.uint8)
    names = np.array([0 if k is None else k for k in keys], "<i8")
    out[0] = MAGIC + HEADER.pack(len(keys), len(ids), levels)
    out[0] += names.tobytes() + padded(null.tobytes()) + first.astype("<u8").tobytes()
    return b"".join(out)


class TokenFile:
    """Reads single tokens, spans or whole documents of a file."""

    def __init__(self, source) -> None:
        self.source = source
        if self.read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, levels = HEADER.unpack(self.read(8, HEADER.size))
        at = 8 + HEADER.size
        self.names_at = at
        self.first_at = at + 8 * self.n_docs + self.n_docs + -self.n_docs % 8
        at = self.first_at + 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack("<Q", self.read(at, 8))
            chunks = at + 8
            bitmap = chunks + size + -size % 8
            bits = (size + 7) // 8
            ranks = bitmap + bits + -bits % 8
            self.levels.append((size, chunks, bitmap, ranks))
            at = ranks + 8 * (-(-size // BLOCK_BITS) + 1)

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def array(self, at: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.read(at, count * np.dtype(kind).itemsize), kind)

    def keys(self) -> list[int | None]:
        names = self.array(self.names_at, self.n_docs, "<i8").tolist()
        null = self.array(self.names_at + 8 * self.n_docs, self.n_docs, "u1").tolist()
        return [None if gone else name for name, gone in zip(names, null)]

    def first(self) -> np.ndarray:
        return self.array(self.first_at, self.n_docs + 1, "<u8").astype(np.int64)

    def rank(self, level: int, place: int) -> int:
        """Ones of a level's bitmap before a place."""
        _, _, bitmap, ranks = self.levels[level]
        block = place // BLOCK_BITS
        (ones,) = struct.unpack("<Q", self.read(ranks + 8 * block, 8))
        start = block * BLOCK_BITS // 8
        bits = int.from_bytes(self.read(bitmap + start, (place + 7) // 8 - start), "little")
        return ones + (bits & ((1 << (place - block * BLOCK_BITS)) - 1)).bit_count()

    def token(self, place: int) -> int:
        """The token at a place of the file."""
        return int(self.span(place, place + 1)[0])

    def span(self, start: int, stop: int) -> np.ndarray:
        """The tokens from ``start`` up to ``stop``."""
        if not 0 <= start <= stop <= self.n_tokens:
            raise IndexError(f"{start}:{stop} of {self.n_tokens}")
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            if start == stop:
                break
            out[where] |= self.array(chunks + start, stop - start, "u1").astype(np.uint32) << np.uint32(8 * level)
            low = start // 8
            bits = self.array(bitmap + low, (stop + 7) // 8 - low, "u1")
            more = np.unpackbits(bits, bitorder="little")[start - 8 * low :][: stop - start].astype(bool)
            where = where[more]
            start = self.rank(level, start) if len(where) else 0
            stop = start + len(where)
        return out


@functools.cache
def word_encoder(path: str) -> WordCodes:
    """The tokenizer of a Python worker, as the library loads it: control strings in a text take
    their own ids. Its normaliser, splitter and control strings never join text across ASCII white
    space, so a text's ids are those of its white-space words, one after another."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8") for w in words]
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return WordCodes(encode)


def token_ids(texts: pa.Array, path: str, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with the end id behind it, and where each begins."""
    data, bounds = ta.flat(texts)
    words = ta.words_of(data, bounds)
    ids, counts = word_encoder(path).codes(data, words.start, words.end)
    each = ta.per_text(counts, words.first) + 1
    first = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=first[1:])
    out = np.full(first[-1], end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = ids
    return out, first


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    end: int = END_ID,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Writes the ids of all texts in ascending order of the (integer) key and returns the
    manifest, already evaluated: (part, file, name, n_docs, n_tokens)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("s"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(count, "k").sortWithinPartitions("k")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        where, base = opened(folder)
        where.create_dir(base, recursive=True)
        keys, ids, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            first = np.zeros(len(keys) + 1, np.int64)
            np.cumsum(np.concatenate(sizes), out=first[1:])
            name = f"part-{part:06d}-{number:06d}.dac"
            draft = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
            with where.open_output_stream(draft) as out:
                out.write(pack(keys, np.concatenate(ids), first))
            where.move(draft, posixpath.join(base, name))
            values = [[part], [number], [name], [len(keys)], [int(first[-1])]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "file", "name", "n_docs", "n_tokens"],
            )

        for batch in batches:
            for piece in ta.chunks(batch, "s", min(ta.CHUNK_BYTES, 4 * file_tokens)):
                made, first = token_ids(piece.column("s"), tokenizer, end)
                keys += piece.column("k").to_pylist()
                ids.append(made)
                sizes.append(np.diff(first))
                held += len(made)
                if held >= file_tokens:
                    yield close()
                    number += 1
                    keys, ids, sizes, held = [], [], [], 0
        if keys:
            yield close()

    schema = "part int, file int, name string, n_docs long, n_tokens long"
    return materialise(ordered.mapInArrow(write, schema), "manifest")


def read_token_files(folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the files.

    ``start`` counts the ids of all documents before it: the totals of the tasks are summed on
    the driver, those of a task's files and documents where they lie.
    """
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for row in totals:
        starts.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "part int, of_part long")
    earlier = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("of_file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    files = placed.join(F.broadcast(offsets), "part").select(
        "name", (F.col("of_part") + F.col("of_file")).alias("start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with where.open_input_file(posixpath.join(base, name)) as source:
                    held = TokenFile(io.BytesIO(source.read()))
                    ids, first = held.span(0, held.n_tokens).astype("<u4"), held.first()
                    body = ids.tobytes()
                    edges = (4 * first).tolist()
                    sums = [zlib.crc32(body[a:b]) for a, b in zip(edges, edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(held.keys(), pa.int64()),
                            pa.array(start + first[:-1]),
                            pa.array(np.diff(first)),
                            pa.array(sums, pa.int64()),
                        ],
                        ["k", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(read, "k long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = stage_path(spark, "tokens")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(folder, manifest)
