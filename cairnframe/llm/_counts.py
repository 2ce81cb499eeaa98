"""Exact counts of 64-bit keys over the whole corpus, exchanged as packed arrays.

Each task sums what it reads and sends, per bucket of keys, one row that holds an array of keys and an array of
counts.  Whoever reads a bucket sums again.  Rows are few, so neither the JVM nor Arrow handles keys one by one, and a
key that makes up a third of the corpus is one entry of each task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Entries a task holds before it sums them.
COMPACT = 1 << 21


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of keys, summed whenever COMPACT entries have been added."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.base = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if not len(keys):
            return
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > 2 * self.base + COMPACT:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.parts) > 1:
            self.parts = [summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        self.size = self.base = len(self.parts[0][0])
        return self.parts[0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the top 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, buckets: int, spread: np.ndarray | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) for keys in ascending order; counts take 1, 2, 4 or 8 bytes by their largest.  Buckets
    are those of `spread`, a hash of each key, or of the keys themselves."""
    bucket = bucket_of(keys if spread is None else spread, buckets)
    if spread is not None:
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = counts[cuts[b] : cuts[b + 1]]
        yield b, keys[cuts[b] : cuts[b + 1]].tobytes(), part.astype(np.min_scalar_type(int(part.max()))).tobytes()


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, np.uint64)
    return k, np.frombuffer(counts, f"u{len(counts) // len(k)}").astype(np.int64)


def total(parts: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    own = Tally()
    for keys, counts in parts:
        own.add(*unpacked(keys, counts))
    return own.total()
