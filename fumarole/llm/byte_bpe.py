"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs. The pairs that may merge wait in one bucket for each
merge rank; a hierarchy of bitmaps marks the buckets that are not empty, so the next rank is found by a
find-first-set in each level, whatever the number of pairs. Inside a bucket the leftmost
position comes first. Entries whose pair has changed meanwhile are stale and skipped. A
pre-token of ``n`` bytes takes time in proportion to ``n log n``, also if it is a whole text.

The text is split by the tokenizer's pattern; each distinct pre-token is merged once while it is
remembered. The work is one narrow pass over whole texts. Decoding maps ids back to bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded
alike; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from fumarole.llm import textarrays as ta
from fumarole.llm.wordcodes import WordCodes, gather

NONE = -1

# Code points that some Unicode versions above 16 call letters or numbers, while
# the merge library's own tables, of version 16, do not know them yet.
UNASSIGNED = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
_unassigned = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNASSIGNED) + "]")


def as_known(text: str) -> str:
    """The text with unassigned code points replaced by one of no class; lengths stay."""
    return text if text.isascii() else _unassigned.sub("\ue000", text)


class RankQueue:
    """Positions by rank; the lowest rank and, within it, the lowest position come out first.

    One bitmap word covers ``1 << SHIFT`` ranks, and the top word covers the bitmap words.
    """

    SHIFT = 8
    MASK = (1 << SHIFT) - 1

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((ranks >> self.SHIFT) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> self.SHIFT
        bits = self.words[word]
        if not bits:
            self.top |= 1 << word
        self.words[word] = bits | 1 << (rank & self.MASK)

    def pop(self) -> tuple[int, int]:
        """The next (rank, position); the queue must not be empty."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        lowest = bits & -bits
        rank = (word << self.SHIFT) + lowest.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits ^ lowest
        if bits == lowest:
            self.top = top & (top - 1)
        return rank, bucket[0]


class ByteBpe:
    """Merge ranks of byte strings, as in a ``.tiktoken`` file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 1_000_000) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(size)
        self.known = WordCodes(self.merge_all, remember)
        strings = [b""] * size
        for piece, rank in ranks.items():
            strings[rank] = piece
        self.strings = np.frombuffer(b"".join(strings), np.uint8)
        self.string_size = np.array([len(s) for s in strings], np.int64)
        self.string_start = np.cumsum(self.string_size) - self.string_size
        digits = [b"%d," % i for i in range(size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_size = np.array([len(s) for s in digits], np.int64)
        self.digit_start = np.cumsum(self.digit_size) - self.digit_size

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            rows = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in rows}, pattern)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.merge(piece) for piece in pieces]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        waiting = [ranks.get(piece[i : i + 2], NONE) for i in range(size - 1)] + [NONE]
        queue = self.queue
        push, pop = queue.push, queue.pop
        for i, rank in enumerate(waiting):
            if rank != NONE:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if waiting[i] != rank:
                continue  # stale: this pair has gone or changed
            gone = after[i]
            stop = after[gone]
            after[i] = stop
            waiting[gone] = NONE
            if stop < size:
                before[stop] = i
                rank = ranks.get(piece[i : after[stop]], NONE)
                if rank != NONE:
                    push(rank, i)
                waiting[i] = rank
            else:
                waiting[i] = NONE
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:stop], NONE)
                if rank != NONE and rank != waiting[left]:
                    push(rank, left)
                waiting[left] = rank
        out, i = [], 0
        while i < size:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        data, bounds = ta.flat(texts)
        find = self.pattern.findall
        pieces = [list(map(len, find(as_known(t)))) if t else [] for t in texts.to_pylist()]
        lengths = np.fromiter((n for part in pieces for n in part), np.int64)
        points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edges = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=edges[1:])
        edges = points[edges]
        ids, counts = self.known.codes(data, edges[:-1], edges[1:])
        sums = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        each = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(part) for part in pieces], out=each[1:])
        return ids, sums[each]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all id lists in a row, and where each begins."""
        size = self.string_size[ids]
        sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        return gather(self.strings, self.string_start[ids], size).tobytes(), sums[first]

    def decimals(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids in decimal, each with a comma behind it, and where each list begins."""
        size = self.digit_size[ids]
        sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        return gather(self.digits, self.digit_start[ids], size).tobytes(), sums[first]


@functools.cache
def loaded(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for a Python worker, with what it remembers."""
    return ByteBpe.load(path, pattern)


ENCODED = {
    "n_tokens": "long",
    "ids": "array<int>",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encoded(
    docs: DataFrame, path: str, pattern: str, text: str = "text", add: tuple[str, ...] = tuple(ENCODED)
) -> DataFrame:
    """``docs`` with the ids of each text, their number, and digests of the ids in decimal and of
    the bytes decoded from them (``add`` names the columns wanted)."""
    kept = docs.select(*[c for c in docs.columns if c not in add])
    inner = [f"c{i}" for i in range(len(kept.columns))]
    source = docs.select(*[docs[c].alias(i) for c, i in zip(kept.columns, inner)], docs[text].alias("s"))

    def digests(joined: bytes, bounds: np.ndarray, trail: int) -> pa.Array:
        spans = zip(bounds[:-1].tolist(), bounds[1:].tolist())
        return pa.array([hashlib.sha256(joined[a : max(a, b - trail)]).hexdigest() for a, b in spans], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in ta.chunks(batch, "s"):
                ids, first = bpe.encode(part.column("s"))
                made = {
                    "n_tokens": lambda: pa.array(np.diff(first)),
                    "ids": lambda: pa.ListArray.from_arrays(
                        pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))
                    ),
                    "ids_sha256": lambda: digests(*bpe.decimals(ids, first), 1),
                    "decoded_sha256": lambda: digests(*bpe.decode(ids, first), 0),
                }
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in inner), *(made[c]() for c in add)], [*inner, *add]
                )

    schema = [f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, kept.schema)]
    schema += [f"{c} {ENCODED[c]}" for c in add]
    return source.mapInArrow(run, ", ".join(schema)).toDF(*kept.columns, *add)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    add = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encoded(docs, path, public_tokenizers.PATTERN, add=add).drop("text")
