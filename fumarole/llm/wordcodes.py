"""Token ids of many words through a bounded memory of the words met so far."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from fumarole.llm import textarrays as ta


def gather(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``flat``, one after another."""
    edges = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=edges[1:])
    return flat[np.arange(edges[-1]) + np.repeat(start - edges[:-1], lengths)]


class WordCodes:
    """Encodes spans of bytes, each distinct one once while it is remembered.

    ``encode`` maps a list of byte strings to their id lists. Beyond ``most`` distinct words the
    memory starts anew, which changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_000_000) -> None:
        self.encode = encode
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds words whose (sorted) hashes are not known yet."""
        lists = self.encode(words)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for part in lists for i in part), np.uint32, int(count.sum()))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slot = np.insert(self.slot, at, len(self.start) + np.arange(len(words)))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.ids = np.append(self.ids, ids)

    def codes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans in order, and how many each span has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        hashes, one, which = np.unique(
            ta.hash_spans(data, start, end), return_index=True, return_inverse=True
        )
        new = ~self.known(hashes)
        if new.any():
            if len(self.hashes) + new.sum() > self.most:
                self.forget()
                new[:] = True
            self.learn(hashes[new], [data[start[i] : end[i]].tobytes() for i in one[new].tolist()])
        slot = self.slot[np.searchsorted(self.hashes, hashes)][which]
        return gather(self.ids, self.start[slot], self.count[slot]), self.count[slot]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes
