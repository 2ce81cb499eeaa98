"""Vectorised text kernel shared by the operators of this folder.

Everything works straight on Arrow string buffers: a slice of documents is one byte array with document
offsets; words are found with byte masks and hashed with a prefix-sum polynomial, so no Python code runs per
document or per word.  A slice holds about SLICE_BYTES of text (one longer document is a slice of its own),
which bounds the memory of a task whatever the batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

try:  # memory of large arrays goes back to the system when they go, and Arrow takes its memory there too
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 6 << 20)  # mmap for what is larger than this
    _libc.mallopt(-1, 16 << 20)  # trim
    pa.set_memory_pool(pa.system_memory_pool())
except OSError:  # another C library
    _libc = None


def give_back() -> None:
    """What is free between arrays that live goes back to the system too: a worker stays for the next task, beside others."""
    if _libc is not None:
        _libc.malloc_trim(0)


SLICE_BYTES = 1 << 19
U64 = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 3
_PINV = pow(_P, -1, 1 << 64)

#: Byte classes of the two word definitions.  Both start from all bytes and take the separators away.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER_VALUES = _VALUES[LOWER]


@lru_cache(maxsize=12)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a slice: byte spans, the document each lies in, and the first word of each document."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per document, with one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the document offsets (from 0) of a string array; a null is an empty text."""
    if text.null_count:
        text = text.fill_null("")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(text) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    mask = is_word[data]
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    inner = offsets[:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


#: Bytes that are hashed at once: arrays of 16 bytes for each byte of text stay this long, however long a text is.
HASH_BYTES = 1 << 20


def hash_words(w: Words, lower: bool) -> np.ndarray:
    """A hash of 64 bits for each word; it does not depend on where the word stands."""
    if len(w.data) <= HASH_BYTES:
        return _hash(w.data, w.starts, w.ends, lower)
    cuts = np.searchsorted(w.starts, np.arange(0, len(w.data) + HASH_BYTES, HASH_BYTES))
    parts = [_hash(w.data[w.starts[a] : w.ends[b - 1]], w.starts[a:b] - w.starts[a], w.ends[a:b] - w.starts[a], lower) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
    return np.concatenate(parts) if parts else np.empty(0, U64)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.empty(0, U64)
    bits = max(19, len(data).bit_length())
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    values = (_LOWER_VALUES if lower else _VALUES)[data]
    values *= _powers(bits, _P)[: len(data)]
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(bits, _PINV)[starts])


def hash_runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; entry i starts at word i.  Runs over document ends are included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    step = U64(0xD6E8FEB86659FD93)
    for j in range(k):
        out *= step
        out += hashes[j : j + n]
    return mix(out)


def hash_windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Like hash_runs, by prefix sums, so the work does not depend on k; seeds give independent hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    bits = max(18, (len(hashes) + 1).bit_length())
    base = (0xD6E8FEB86659FD93 + 0x51_7CC1_B727_220A * seed) & _MASK | 3
    sums = np.empty(len(hashes) + 1, U64)
    sums[0] = 0
    np.cumsum(mix(hashes + U64(seed * 0x9E3779B9 + 1)) * _powers(bits, base)[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(bits, pow(base, -1, 1 << 64))[:n])


def inside(w: Words, k: int) -> np.ndarray:
    """Word positions at which k consecutive words of one document start."""
    last = np.repeat(w.first[1:], w.counts)
    return np.flatnonzero(np.arange(len(w.starts)) + k <= last)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut by bytes of text.  Free memory is given back before the first, when what the task before
    left is free, and after the last."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = buffers(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch, column, offsets, _
    give_back()


def strings(text: pa.Array) -> list[str]:
    return ["" if x is None else x for x in text.to_pylist()]
