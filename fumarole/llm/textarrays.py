"""Texts of an Arrow batch as flat byte arrays: words, hashes and windows in numpy.

Everything here works on UTF-8 bytes. White space is the ASCII set 0x09-0x0D and 0x20, whose
bytes occur in no other character, so words can be cut without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes hashed at once inside a chunk.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True

_rng = np.random.default_rng(20_240_229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base modulo 2**64, computed once as far as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base = np.uint64(base)
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            size = max(n, min(2 * len(self.known), 1 << 22), 1024)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_byte_powers = Powers(BYTE_BASE)
_word_powers = Powers(WORD_BASE)
_word_inverses = Powers(inverse(WORD_BASE))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes (one text at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of several texts: byte spans, owning text, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of bytes that are not white space, never across two texts."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    if len(cuts):
        starts[cuts] = inside[1:-1][cuts]
        last = cuts[cuts > 0] - 1
        ends[last] = inside[1:-1][last]
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (in order, not overlapping, not empty)."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK_BYTES)))
        lengths = end[i:j] - start[i:j]
        edges = np.zeros(j - i + 1, np.int64)
        np.cumsum(lengths, out=edges[1:])
        place = np.arange(edges[-1], dtype=np.int64)
        within = place - np.repeat(edges[:-1], lengths)
        source = within + np.repeat(start[i:j], lengths)
        value = BYTE_VALUES[data[source]] * _byte_powers.upto(int(lengths.max()))[within]
        out[i:j] = mix(np.add.reduceat(value, edges[:-1]) + lengths.astype(np.uint64))
        i = j
    return out


class Sequence:
    """Hashes of any run of consecutive words, in constant time each."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _word_powers.upto(n), out=self.sums[1:], dtype=np.uint64)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = self.sums[stop] - self.sums[start]
        inverses = _word_inverses.upto(len(self.sums))
        return mix(raw * inverses[start] + (stop - start).astype(np.uint64))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions of all windows of ``size`` words that stay inside one text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    edges = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=edges[1:])
    return np.arange(edges[-1]) + np.repeat(first[:-1] - edges[:-1], counts)


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in at least one of the spans."""
    steps = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The spans' bytes with one space after each, and where each begins in them."""
    edges = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start + 1, out=edges[1:])
    source = np.arange(edges[-1]) + np.repeat(start - edges[:-1], np.diff(edges))
    out = np.append(data, np.uint8(32))[source]
    out[edges[1:] - 1] = 32
    return out.tobytes(), edges


def select_bytes(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Texts of the bytes that stay."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    offsets = pa.py_buffer(sums[bounds].astype(np.int64))
    body = pa.py_buffer(np.ascontiguousarray(data[keep]))
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, offsets, body]).cast(pa.string())


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def per_text(flags_or_values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word values over each text."""
    sums = np.zeros(len(flags_or_values) + 1, np.int64)
    np.cumsum(flags_or_values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
