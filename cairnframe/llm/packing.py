"""Sum-of-squares packing of documents into fixed windows (operator 8).

A document's ids are cut into full windows and a rest.  The rest goes, online, to the fill level that makes the sum of
squared counts of partially filled windows smallest; the counts stand in an array by level.  At most OPEN windows are
partially filled at once: where a rest fits into none of them and none may be opened, it is cut so that it fills the
window of the level chosen by the same sum, and what is left starts the next window.  Each task packs what it reads, so
there is no shuffle and a lost task gives the same windows when it runs again.  When a task ends, its OPEN windows at
most are joined, cutting where a window is full, so at most one window of a task has padding.

A sequence is padded to the window, except where its length is a power of two.

Defined results: a null or empty text is its end token alone; equal rows are packed separately; a document longer than
the window spans several sequences, however long it is; of levels with equal sums the lowest is chosen; a null doc_id
stays null; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import byte_symbols

WINDOW = 1024
END = 0
#: Windows that a task may have partially filled.
OPEN = 32
#: Pieces of text remembered by a worker in each of two generations.
REMEMBER = 150_000
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder(dict):
    """Packed ids (little-endian, 32 bits) of text.

    A piece that follows a single space has the same ids wherever it stands, so it is encoded once and remembered, in
    two generations of bounded size.  Where white space meets that space, the whole text is encoded at once.
    """

    def __init__(self, path: str, pattern: str, remember: int = REMEMBER):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: k for k, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in self.special}
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        if [spec["model"]["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("ids of this vocabulary are not in order of its merges")
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.remember = remember
        self.older: dict[str, bytes] = {}
        self.spaced = False

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            self.spaced = True
            return b""
        if (out := self.older.get(piece)) is None:
            out = packed(self.plain(" " + piece))
        if len(piece) <= 48:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        for string, number in self.special.items():
            if string in text:
                return packed([number]).join(map(self.encode, text.split(string)))
        first, *rest = text.split(" ")
        if not rest:
            return packed(self.plain(text))
        last = rest.pop()
        self.spaced = not last or last[0].isspace() or first[-1:].isspace()
        out = b"".join(map(self.__getitem__, rest))
        if self.spaced:
            return packed(self.plain(text))
        return packed(self.plain(first)) + out + packed(self.plain(" " + last))


class SumOfSquares:
    """Open windows by fill level, and the choice of a level for the next piece."""

    def __init__(self, window: int, most: int = OPEN):
        self.window, self.most = window, most
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.opened = self.filled = 0

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """Where a piece below the window's size goes: the window (a number from 0), the level in it, and how much of the
        piece; two of these if it is cut."""
        n, never = self.count, np.iinfo(np.int64).max
        #: level 0 is a new window; moving one window from level h to h + size changes the sum by this
        top = self.window - size
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top]  # a full window is not counted
        fits = n[: top + 1] > 0
        fits[0] = self.opened < self.most
        if fits.any():
            level = int(np.argmin(np.where(fits, change, never)))
            return [self._put(level, size)]
        levels = np.arange(top + 1, self.window)
        change = np.where(n[levels] > 0, 2 * (n[levels - top] - n[levels]) + 2, never)  # one window less there, one more of the rest
        level = int(levels[np.argmin(change)])
        return [self._put(level, self.window - level), self._put(0, level - top)]

    def _put(self, level: int, size: int) -> tuple[int, int, int]:
        if level:
            self.count[level] -= 1
            number = self.open[level].pop()
        else:
            number, self.filled, self.opened = self.filled, self.filled + 1, self.opened + 1
        if level + size < self.window:
            self.count[level + size] += 1
            self.open[level + size].append(number)
        else:
            self.opened -= 1
        return number, level, size


def _packer(encoder: Callable[[], Encoder], window: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tail = packed([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        encode = encoder().encode
        levels = SumOfSquares(window)
        waiting: dict[int, list[tuple]] = {}  # pieces of windows that are not full, with their ids
        sequences = 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "") + tail
                total = len(ids) // 4
                for start in range(0, total - window + 1, window):
                    rows.append((doc, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), total, base + sequences, 0))
                    sequences += 1
                start = total - total % window
                for number, level, length in levels.place(total - start) if start < total else ():
                    waiting.setdefault(number, []).append((doc, start, length, ids[4 * start : 4 * (start + length)], total))
                    start += length
                    if level + length == window:
                        rows += _laid(waiting.pop(number), base + sequences)
                        sequences += 1
            yield _batch(rows, kind)
        rows, fill, group = [], 0, []
        for pieces in waiting.values():
            for doc, start, length, ids, total in pieces:
                while length:
                    now = min(length, window - fill)
                    group.append((doc, start, now, ids[: 4 * now], total))
                    start, length, ids, fill = start + now, length - now, ids[4 * now :], fill + now
                    if fill == window:
                        rows += _laid(group, base + sequences)
                        sequences, fill, group = sequences + 1, 0, []
        rows += _laid(group, base + sequences)
        if rows:
            yield _batch(rows, kind)

    return run


def _laid(pieces: list[tuple], sequence: int) -> list[tuple]:
    rows, offset = [], 0
    for doc, start, length, ids, total in pieces:
        rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset))
        offset += length
    return rows


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


_encoders: dict[str, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker; what it remembers outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, pattern)
    return _encoders[path]


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.  path: a byte-level vocabulary file;
    pattern: how it splits text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_packer(lambda: encoder(path, pattern), window, end), SCHEMA.format(id=kind))
