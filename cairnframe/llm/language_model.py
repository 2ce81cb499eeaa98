"""Language-model scoring by a weighted backoff automaton (operator 9).

Every n-gram of the training texts up to the order, also one that occurs once, is counted and is an arc; the shorter
ones, and the start of a text, are states.  An arc's weight mixes the share of the context's occurrences that go on with
the token and what the shorter context says; the mixing weight, which depends on how often the context occurs, is the
weight of the context's failure arc.  So the weights of a state add up to 1.  No count is left out and nothing depends
on the size of the corpus.

Counts stay distributed.  A task hashes the tokens of a chunk of documents and sends the chunk's distinct n-grams,
packed, to buckets; a bucket adds up what training texts hold and sends the chunk the total of each n-gram it asked for.
Then the chunk knows all arcs and failure arcs its documents meet and traverses them from left to right: the state after
a token is the longest n-gram that ends there and occurs in training.  The documents of a chunk meet its counts by the
chunk's name, a hash of its texts, so a lost task is computed again without any other state.  An n-gram travels as the
top bits of a hash: SPARE bits more than it takes to number all n-grams of the corpus.  Only words with at least
tokens / FREQUENT occurrences are also broadcast, which saves traffic and changes no result.  `Automaton` is the same
model in the memory of one process.

Defined results: null and empty texts are one end token; without training rows every token is unknown; equal rows get
equal scores; a null doc_id counts as the empty string; a very long text is a chunk of its own; other columns are
ignored, whatever their names; an empty table gives no rows.  Ties play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _counts as C
from . import _kernel as K
from ._spark import crc_mod, keep, parts, regroup, steady

ORDER = 3
#: Weight of the failure arc of a context of 1, and of 2 or more, tokens that occurs c times: a * c ** -b.
LEAVE = ((0.95, 0.1), (0.75, 0.3))
#: At most so many words are broadcast.
FREQUENT = 1 << 20
#: Tokens of a chunk of documents, about.
CHUNK = 1 << 20
#: Bits of an n-gram's hash beyond those that number all n-grams: one n-gram in 2 ** SPARE shares its hash with another.
SPARE = 24
#: Tokens of the corpus to a bucket, about, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 1 << 22, 1 << 16
ADD = 0.1
END = np.uint64(0xE17D_E17D_E17D_E17D)
START = np.uint64(0x57A7_57A7_57A7_57A7)


def leave(order: int, times):
    """Weight of failing from a context of order - 1 tokens that occurs so many times (1 or more)."""
    a, b = LEAVE[min(order - 2, len(LEAVE) - 1)]
    return a * np.maximum(times, 1.0) ** -b


class Automaton:
    """The model in memory.  States are the n-grams shorter than the order that occur in training, the empty one and the
    start of a text among them; texts are lists of tokens, ends included."""

    def __init__(self, texts: Iterable[list[Hashable]], order: int = ORDER):
        self.order = order
        self.count: Counter = Counter()
        for text in texts:
            line = [None, *text]
            for n in range(1, order + 1):
                self.count.update(tuple(line[i - n + 1 : i + 1]) for i in range(max(n - 1, 1), len(line)))
            self.count[(None,)] += 1
        words = [k for k in self.count if len(k) == 1 and k != (None,)]
        self.total, self.distinct = sum(self.count[k] for k in words), len(words)
        contexts = {k[:-1] for k in self.count if len(k) > 1}  # what stands before the end of a text is one, the end is not
        self.fail = {k: float(np.log10(leave(len(k) + 1, self.count[k]))) for k in contexts}
        self.arcs: dict[tuple, float] = {}
        for k in sorted((k for k in self.count if k != (None,)), key=len):
            p = (self.count[k] + ADD) / self.mass
            if len(k) > 1:
                stay = 1 - 10 ** self.fail[k[:-1]]
                p = stay * self.count[k] / self.count[k[:-1]] + (1 - stay) * 10 ** self.step(k[1:-1], k[-1])[0]
            self.arcs[k] = float(np.log10(p))

    @property
    def mass(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def step(self, state: tuple, word: Hashable) -> tuple[float, tuple]:
        """log10 probability of a token, and the state after it."""
        cost = 0.0
        while (*state, word) not in self.arcs:
            if not state:
                return cost + float(np.log10(ADD / self.mass)), ()
            cost, state = cost + self.fail.get(state, 0.0), state[1:]
        cost, state = cost + self.arcs[*state, word], (*state, word)[-(self.order - 1) :] if self.order > 1 else ()
        return cost, state

    def traverse(self, text: list[Hashable]) -> float:
        total, state = 0.0, (None,) if self.order > 1 else ()
        for word in text:
            cost, state = self.step(state, word)
            total += cost
        return total


class Kept:
    """Sorted keys and the place of a key among them, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = 18
        self.may = np.zeros(1 << self.bits, bool)
        self.may[self._slot(keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * K.U64(0x9E3779B97F4A7C15)) >> K.U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            near = np.flatnonzero(self.may[self._slot(keys)])
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            out[near] = np.where(self.keys[at] == keys[near], at, -1)
        return out


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of a slice, ends included; the document of each; the first token of each document."""
    data, offsets = K.buffers(text)
    w = K.find_words(data, offsets, K.SPACE_WORDS)
    n = len(w.counts)
    first = w.first + np.arange(n + 1)
    out = np.full(len(w.starts) + n, END, np.uint64)
    out[np.arange(len(w.starts)) + w.doc] = K.hash_words(w, True)
    return out, np.repeat(np.arange(n), np.diff(first)), first


def _key_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return K.mix(K.mix(a + K.U64(n)) * K.U64(0x9E3779B97F4A7C15) + b)


def grams(hashes: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order from 2: keys of the n-grams, and the token each ends at.  Before a text stands a start."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first[:-1]] = START
    inside = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    prefix, suffix, at = before, hashes, np.arange(len(hashes))
    for n in range(2, order + 1):
        key = _key_of(prefix, suffix, n)
        yield key, at
        after = np.flatnonzero(inside[at] >= n - 1)
        prefix, suffix, at = key[after - 1], key[after], at[after]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "keys", "counts"])


BLOBS = "bucket int, keys binary, counts binary"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[int, C.Tally] = {}
    for batch in batches:
        for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tallies.setdefault(bucket, C.Tally()).add(*C.unpacked(keys, counts))
    rows = []
    for bucket, tally in tallies.items():
        keys, counts = tally.total()
        rows.append((bucket, keys.tobytes(), _small(counts).tobytes()))
    yield _pack(rows)


class Words:
    """Totals of the training tokens, and the counts of the frequent words."""

    def __init__(self, total: int, distinct: int, texts: int, words: np.ndarray, counts: np.ndarray):
        self.total, self.texts, self.mass = total, texts, total + ADD * (distinct + 1)
        self.kept, self.counts = Kept(words), counts


def count_words(docs: DataFrame, frequent: int = FREQUENT) -> Words:
    """docs: the training texts."""
    buckets = 2 * parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = C.Tally()
        for batch in K.slices(batches):
            tally.add(tokens(batch.column(0))[0])
        yield _pack(list(C.packed(*tally.total(), buckets)))

    counts = keep(regroup(docs.mapInArrow(count, BLOBS)).mapInArrow(_sum, BLOBS))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k, c = C.unpacked(keys, n)
                yield pa.RecordBatch.from_arrays([pa.array([len(k)]), pa.array([int(c.sum())]), pa.array([int(c[k == END].sum())])], names=["distinct", "total", "texts"])

    distinct, total, texts = (int(x or 0) for x in counts.mapInArrow(size, "distinct long, total long, texts long").agg(F.sum("distinct"), F.sum("total"), F.sum("texts")).first())
    floor = max(1, -(-total // frequent))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, c = C.unpacked(keys, n)
                good = c >= floor
                if good.any():
                    yield _pack([(bucket, k[good].tobytes(), c[good].tobytes())])

    # at most `frequent` words, by the choice of the floor
    return Words(total, distinct, texts, *C.total((bytes(r["keys"]), bytes(r["counts"])) for r in counts.mapInArrow(often, BLOBS).collect()))


ASKED = "bucket int, chunk long, size long, a binary, b binary"


def _line(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True)], names=["bucket", "chunk", "size", "a", "b"])


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers in byte planes, compressed; the first byte is their width."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return bytes([x.itemsize]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _opened(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(pa.decompress(blob[1:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"u{width}")[:, 0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents of about CHUNK tokens together."""
    held, size = [], 0
    for batch in K.slices(batches):
        data, _ = K.buffers(batch.column(1))
        held.append(batch)
        size += 1 + batch.num_rows + int(np.count_nonzero(~K.SPACE_WORDS[data]))
        if size >= CHUNK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Chunk:
    """The tokens of some documents, and all distinct n-grams of theirs that are not broadcast words, in order."""

    def __init__(self, text: pa.ChunkedArray, order: int, words: Kept, bits: int):
        pieces = [tokens(piece) for piece in text.chunks]  # slices of bounded size, as they were read
        self.hashes = np.concatenate([h for h, _, _ in pieces])
        self.first = np.r_[0, np.cumsum(np.concatenate([np.diff(first) for _, _, first in pieces]))]
        self.doc = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))
        self.word = words.find(self.hashes)
        #: by order: where the n-grams end
        self.at = [np.flatnonzero(self.word < 0)]
        keys = [self.hashes[self.at[0]]]
        for key, at in grams(self.hashes, self.first, order):
            keys.append(key)
            self.at.append(at)
        self.keys, self.place = np.unique(np.concatenate(keys) >> K.U64(64 - bits), return_inverse=True)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Chunks with their names: equal names mean equal texts, and equal parts in training."""
    for table in _chunks(batches):
        digest = hashlib.blake2b(digest_size=8)
        data, offsets = K.buffers(table.column(1).combine_chunks())
        for part in (data, offsets, np.packbits(_learned(table))):
            digest.update(np.ascontiguousarray(part))
        yield int.from_bytes(digest.digest(), "little", signed=True), table


def _learned(table: pa.Table) -> np.ndarray:
    return ~table.column(2).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def _ask(send, order: int, buckets: int, bits: int):
    """The distinct n-grams of a chunk by bucket, and how often training documents of the chunk hold each."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = send.value
        for name, table in _named(batches):
            chunk = Chunk(table.column(1), order, words.kept, bits)
            learned = _learned(table)
            times = np.bincount(chunk.place, np.concatenate([learned[chunk.doc[at]] for at in chunk.at]), len(chunk.keys)).astype(np.int64)
            cuts = np.searchsorted(C.bucket_of(chunk.keys << K.U64(64 - bits), buckets), np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                rows.append((b, name, cuts[b + 1] - cuts[b], _squeezed(np.diff(chunk.keys[part], prepend=np.uint64(0))), _squeezed(_small(times[part]))))
            yield _line(rows)

    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk, compressed, as a row of size -1."""
    for name, table in _named(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        yield _line([(-1, name, -1, sink.getvalue().to_pybytes(), None)])


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk gets the counts of what it asked of a bucket, in the order it asked."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append(row)
    for bucket in list(held):
        asked = held.pop(bucket)
        sizes = [n for _, n, _, _ in asked]
        keys = np.concatenate([np.cumsum(_opened(a, n)) for _, n, a, _ in asked])
        times = np.concatenate([_opened(b, n).astype(np.int64) for _, n, _, b in asked])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.empty(len(keys), np.int64)
        counts[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.r_[first, len(keys)]))
        cuts = np.cumsum([0, *sizes])
        yield _line([(bucket, chunk, n, _squeezed(_small(counts[i:j])), None) for (chunk, n, _, _), i, j in zip(asked, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


def _traverse(send, order: int, bits: int, names: list[str]):
    """The documents of each chunk with their scores."""

    def finish(table: pa.Table, replies: dict[int, tuple[int, bytes]]) -> pa.Table:
        words = send.value
        chunk = Chunk(table.column(1), order, words.kept, bits)
        counts = np.concatenate([_opened(a, n).astype(np.int64) for _, (n, a) in sorted(replies.items())] or [np.empty(0, np.int64)])
        if len(counts) != len(chunk.keys):
            raise ValueError("a chunk of documents does not find the counts it asked for")
        counts = counts[chunk.place]
        n, size = len(chunk.hashes), len(chunk.first) - 1
        first = chunk.first[:-1]
        context = np.empty(0, np.int64)
        base = p = np.empty(0)
        known = np.empty(0, bool)
        start = 0
        for level, at in enumerate(chunk.at, 1):
            own = np.zeros(n, np.int64)
            own[at] = counts[start : start + len(at)]
            start += len(at)
            if level == 1:
                frequent = chunk.word >= 0
                own[frequent] = words.counts[chunk.word[frequent]]
                base = p = (own + ADD) / words.mass
                known = own > 0
            else:  # the arc of a state that goes on with the token, and the failure arc of one that does not
                fail = leave(level, context)
                p = np.where(context > 0, (1 - fail) * own / np.maximum(context, 1) + fail * p, p)
            # the next order's contexts end one token earlier; only a start stands before a text
            context = np.r_[0, own[:-1]]
            context[first] = words.texts if level == 1 else 0
        sums = [np.bincount(chunk.doc, w, size) for w in (known, np.log10(base), np.log10(p))]
        return pa.table([table.column(0), pa.array(np.diff(chunk.first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=names)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, list[bytes]] = {}
        replies: dict[int, dict[int, tuple[int, bytes]]] = {}
        for batch in batches:
            for bucket, chunk, size, a, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size < 0:
                    heads.setdefault(chunk, []).append(a)
                else:  # chunks with equal texts get equal replies
                    replies.setdefault(chunk, {})[bucket] = (size, a)
        for chunk in list(heads):
            own = replies.pop(chunk, {})
            for blob in heads.pop(chunk):
                yield from finish(pa.ipc.open_stream(blob).read_all(), own).to_batches()

    return out


def score(docs: DataFrame, order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """Base and model scores (log10) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = steady(docs.select("doc_id", "text"))
    held_out = crc_mod("doc_id", 10) == 0
    words = count_words(docs.where(~held_out).select("text"), frequent)
    send = docs.sparkSession.sparkContext.broadcast(words)
    buckets = int(np.clip(-(-words.total // PER_BUCKET), 2 * parts(docs), MOST_BUCKETS))
    bits = min(64, (words.total * order + 1).bit_length() + SPARE)
    tasks = max(parts(docs), buckets // 2)
    source = docs.select("doc_id", "text", held_out.alias("held_out"))
    replies = source.mapInArrow(_ask(send, order, buckets, bits), ASKED).repartition(tasks, "bucket").mapInArrow(_reply, ASKED)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    met = replies.unionByName(source.mapInArrow(_documents, ASKED)).repartition(tasks, "chunk")
    rows = met.mapInArrow(_traverse(send, order, bits, names), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
