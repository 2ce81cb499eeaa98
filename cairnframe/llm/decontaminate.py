"""Benchmark decontamination with a generalised suffix automaton (operator 7).

The automaton holds every substring of the normalised test items.  Training words stream through it; at each word it
knows the longest suffix of what was read that occurs in some item.  A run of at least `window` words is a hit, and so
is a whole item of fewer words.  Documents are streamed in parallel without any shuffle: a slice's runs of known words
advance together, one word at a time, in pieces that overlap by a window less one word, so no hit is lost.

Items are split into groups of at most MAX_ITEM_WORDS words.  Each group's automaton is built once, packed into arrays
(about 60 bytes a word) and broadcast by itself; a task holds at most HELD of them at once and goes through all of them
for each batch of documents.  So memory has a fixed bound, and the number of groups changes no result.

Defined results: null or empty text has no words, is never hit and stays; null, empty and wordless items never match;
items are told apart by item_id, so rows of one id are one item, and an item without id hits words but is neither counted
nor listed; a null doc_id is an ordinary value; each of several equal rows gets its own result; very long texts are
streamed whole; other columns are passed through by `clean` and ignored by `hits`, whatever their names; an empty
benchmark leaves everything clean; an empty table gives no rows.  Ties play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

WINDOW = 13
#: A document is contaminated if hit words are at least one in COVERAGE of its words.
COVERAGE = 20
#: Words of test items in one automaton.
MAX_ITEM_WORDS = 200_000
#: Automata a task holds at once.
HELD = 8
#: Words of a run that are streamed as one piece.
PIECE = 64
SCHEMA = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,length:long>>, items array<string>"


def normal(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased (A-Z only)."""
    raw = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    return np.where(K.ALNUM_WORDS[raw], raw, 32).astype(np.uint8).tobytes().split()


class _States:
    """All substrings of several sequences of numbers, as states with links to their longest suffixes."""

    def __init__(self, items: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for words in items:
            last = 0
            for c in words:
                last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if (q := step[last].get(c)) is not None:  # a path of an earlier item
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.link)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone


class Automaton:
    """The suffix automaton of some items, in arrays: arcs sorted by (state, word), links, lengths, the items of the
    windows that end in a state, and the short items that end there."""

    def __init__(self, items: list[list[int]], words: int, window: int):
        states = _States(items)
        self.window, self.words = window, max(words, 1)
        self.link, self.length = np.array(states.link, np.int32), np.array(states.length, np.int32)
        n = len(self.link)
        sizes = np.array([len(s) for s in states.step])
        keys = np.repeat(np.arange(n), sizes) * self.words + np.fromiter((c for s in states.step for c in s), np.int64, int(sizes.sum()))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.to = np.fromiter((t for s in states.step for t in s.values()), np.int32, len(keys))[order]
        self.root = np.zeros(self.words, np.int32)
        for c, t in states.step[0].items():
            self.root[c] = t
        # a state of window words or more shares its window's items with the shortest such state above it
        self.anchor = np.full(n, -1, np.int32)
        by_length = np.argsort(self.length, kind="stable")[1:].tolist()
        for v in by_length:
            if states.length[v] >= window:
                u = states.link[v]
                self.anchor[v] = self.anchor[u] if states.length[u] >= window else v
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, line in enumerate(items):
            v = 0
            for c in line:
                v = states.step[v][c]
                if (a := int(self.anchor[v])) >= 0:
                    self.items.setdefault(a, set()).add(k)
            if line and len(line) < window:
                while states.length[states.link[v]] >= len(line):
                    v = states.link[v]
                self.whole.setdefault(v, []).append((len(line), k))
        #: by state: the longest suffix of it, or itself, that is a whole short item
        self.short = np.full(n, -1, np.int32)
        for v in by_length if self.whole else ():
            self.short[v] = v if v in self.whole else self.short[states.link[v]]

    def stream(self, numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs numbers[lo:hi] of word numbers: where windows or short items may end, the state there, and the longest
        match (at least the part of it inside a piece and the window before it)."""
        times = -(-(hi - lo) // PIECE)
        own = np.repeat(lo, times) + PIECE * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        end = np.minimum(own + PIECE, np.repeat(hi, times))
        at = np.maximum(own - (self.window - 1), np.repeat(lo, times))
        state, length = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = len(self.keys) - 1
        while len(at):
            word = numbers[at]
            seek = np.arange(len(at))
            while len(seek):
                key = state[seek].astype(np.int64) * self.words + word[seek]
                place = np.minimum(np.searchsorted(self.keys, key), last)
                hit = self.keys[place] == key
                state[seek[hit]] = self.to[place[hit]]
                length[seek[hit]] += 1
                seek = seek[~hit]  # every word known starts an arc of the empty state, so all end
                state[seek] = self.link[state[seek]]
                length[seek] = self.length[state[seek]]
            good = np.flatnonzero((at >= own) & ((length >= self.window) | (self.short[state] >= 0)))
            if len(good):
                found.append((at[good], state[good], length[good]))
            at = at + 1
            more = at < end
            if not more.all():
                at, own, end, state, length = (x[more] for x in (at, own, end, state, length))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


class Matcher:
    """The automaton of a group of items over numbers of their words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.names = window, [k for k, _ in items]
        vocabulary = sorted({w for _, words in items for w in words})
        array = pa.array([w.decode("utf-8", "replace") for w in vocabulary], pa.string())
        data, offsets = K.buffers(array)
        hashed = K.hash_words(K.Words(data, offsets, offsets[:-1], offsets[1:], np.arange(len(vocabulary) + 1)), True)
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number = dict(zip(vocabulary, place.tolist(), strict=True))
        self.automaton = Automaton([[number[w] for w in words] for _, words in items], len(vocabulary), window)
        self.least = min([window, *(len(words) for _, words in items)])
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.hashes >> K.U64(48)).astype(np.int64)] = True

    def find(self, w: K.Words, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str | None]]]:
        """Words that are hit, and (document, item id) for the items that hit."""
        known = np.flatnonzero(self.may[(h >> K.U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[known]), max(0, len(self.hashes) - 1))
        good = self.hashes[at] == h[known] if len(self.hashes) else np.zeros(len(known), bool)
        known, at = known[good], at[good]
        none = np.empty(0, np.int64), []
        if not len(known):
            return none
        doc = np.searchsorted(w.first, known, side="right") - 1
        cuts = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc) != 0)) + 1
        lo, hi = np.r_[0, cuts], np.r_[cuts, len(known)]
        long_enough = hi - lo >= self.least
        where, state, length = self.automaton.stream(at, lo[long_enough], hi[long_enough])
        if not len(where):
            return none
        a = self.automaton
        edge = np.zeros(len(known) + 1, np.int64)
        full = length >= self.window
        np.add.at(edge, where[full] + 1 - length[full], 1)
        np.add.at(edge, where[full] + 1, -1)
        pairs = {(d, k) for d, s in set(zip(doc[where[full]].tolist(), a.anchor[state[full]].tolist(), strict=True)) for k in a.items[s]}
        ends = a.short[state] >= 0
        for i, v, n in zip(where[ends].tolist(), a.short[state[ends]].tolist(), length[ends].tolist(), strict=True):
            while v >= 0:
                for size, k in a.whole[v]:
                    if size <= n:
                        edge[i + 1 - size] += 1
                        edge[i + 1] -= 1
                        pairs.add((int(doc[i]), k))
                v = int(a.short[a.link[v]])
        return known[np.cumsum(edge[:-1]) > 0], [(d, self.names[k]) for d, k in pairs]


def _matched(text: pa.Array, sends: list) -> tuple[K.Words, np.ndarray, list[tuple[int, str | None]]]:
    """Words of a slice, which of them are hit, and the items that hit documents, over all groups of items."""
    data, offsets = K.buffers(text)
    w = K.find_words(data, offsets, K.ALNUM_WORDS)
    h = K.hash_words(w, True)
    hit = np.zeros(len(h), bool)
    pairs: set[tuple[int, str | None]] = set()
    for send in sends:
        words, items = send.value.find(w, h)
        hit[words] = True
        pairs.update(items)
    return w, hit, sorted((d, i) for d, i in pairs if i is not None)


def _rounds(batches: Iterator[pa.RecordBatch], sends: list, column: int) -> Iterator[tuple[pa.RecordBatch, K.Words, np.ndarray, list[tuple[int, str | None]]]]:
    """Slices with what hits them.  Of many groups, HELD are in memory at once."""
    if len(sends) <= HELD:
        for batch in K.slices(batches):
            yield batch, *_matched(batch.column(column), sends)
        return
    for whole in batches:
        cut = list(K.slices(iter([whole])))
        got: list = [None] * len(cut)
        for k in range(0, len(sends), HELD):
            for i, batch in enumerate(cut):
                w, hit, pairs = _matched(batch.column(column), sends[k : k + HELD])
                got[i] = (hit, pairs) if got[i] is None else (got[i][0] | hit, sorted({*got[i][1], *pairs}))
            for send in sends[k : k + HELD]:
                send.__dict__.pop("_value", None)  # read again from the worker's disk when it is needed
        for batch, (hit, pairs) in zip(cut, got, strict=True):
            data, offsets = K.buffers(batch.column(column))
            yield batch, K.find_words(data, offsets, K.ALNUM_WORDS), hit, pairs


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def matchers(benchmark: DataFrame, window: int = WINDOW, most: int = MAX_ITEM_WORDS) -> list:
    """A broadcast matcher for each group of items.  The driver holds one group at a time."""
    sc = benchmark.sparkSession.sparkContext
    sends: list = []
    group: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if words := normal(text):
            if group and size + len(words) > most:
                sends.append(sc.broadcast(Matcher(group, window)))
                group, size = [], 0
            group.append((item_id, words))
            size += len(words)
    return [*sends, sc.broadcast(Matcher(group, window))] if group else sends


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.string())]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per document: words, hit words, items hit, the verdict and the hit spans (in words)."""
    sends = matchers(benchmark, window, max_item_words)
    none = digest([])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w, hit, pairs in _rounds(batches, sends, 1):
            counts = w.counts.tolist()
            rows = [(n, 0, 0, none, False, [], []) for n in counts]
            spans: dict[int, list[dict[str, int]]] = {}
            at = np.flatnonzero(hit)
            if len(at):
                doc = np.searchsorted(w.first, at, side="right") - 1
                new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(doc) != 0)])
                for d, start, n in zip(doc[new].tolist(), (at[new] - w.first[doc[new]]).tolist(), np.diff(np.r_[new, len(at)]).tolist(), strict=True):
                    spans.setdefault(d, []).append({"start": start, "length": n})
            items: dict[int, list[str]] = {}
            for d, item in pairs:
                items.setdefault(d, []).append(item)
            for d, own in spans.items():
                n_hit, ids = sum(s["length"] for s in own), items.get(d, [])
                rows[d] = (counts[d], n_hit, len(ids), digest(ids), coverage * n_hit >= counts[d], own, ids)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_NAMES])

    return docs.select("doc_id", "text").mapInArrow(match, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    sends = matchers(benchmark, window, max_item_words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w, hit, _ in _rounds(batches, sends, at):
            n_hit = np.diff(np.r_[0, np.cumsum(hit)][w.first])
            bad = (n_hit > 0) & (coverage * n_hit >= w.counts)
            yield batch.filter(pa.array(~bad)) if bad.any() else batch

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, max_length: int | None = None) -> DataFrame:
    """doc_id and the text without the hit spans that are longer than max_length words, or all hit spans where the
    document is contaminated; kept words are joined by one space where something was removed, else the text is as it was."""
    sends = matchers(benchmark, window)
    limit = max_length if max_length is not None else 2**62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w, hit, _ in _rounds(batches, sends, 1):
            texts, raw = batch.column(1).to_pylist(), w.data.tobytes()
            for d in np.flatnonzero(np.diff(np.r_[0, np.cumsum(hit)][w.first])).tolist():
                mine = hit[w.first[d] : w.first[d + 1]]
                if coverage * mine.sum() < len(mine):  # long spans alone
                    new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    size = np.diff(np.r_[new, len(mine)])
                    mine = mine & np.repeat(size > limit, size)
                if mine.any():
                    keep = np.flatnonzero(~mine) + w.first[d]
                    texts[d] = b" ".join(raw[i:j] for i, j in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
