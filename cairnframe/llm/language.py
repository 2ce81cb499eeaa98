"""Language mixtures of documents by expectation-maximisation (operator 2).

Training counts the hashed 4-byte n-grams of each language over every labelled training document.  A word's likelihood
in a language is the product over its n-grams; a document's words are drawn from a mixture of languages whose
proportions expectation-maximisation estimates.  The number of languages is the one with the best likelihood less
PENALTY * log(words) for each language after the first.

Every language of the training rows is learned: BINS counts for each, so the model grows with their number alone.

Defined results: null text and text without letters is `und` with score 0; without training rows everything is `und`;
ties go to the language first in order; equal rows give equal results; very long texts are read whole; a null doc_id
counts as the empty string and stays null; other columns never count, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernel as K
from ._spark import crc_mod, parts

UNKNOWN = "und"
GRAM = 4
BITS = 17
BINS = 1 << BITS
#: Languages whose counts a task holds before it sends them, and for which a slice of documents has its usual size.
HELD_LANGS = 64
CHUNKS = 32
ROUNDS = 8
MOST = 3
PENALTY = 2.0
#: Proportions below this are not tried as a further language.
LEAST = 0.02

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of the n-gram that ends at each letter, the first letter of each word, and the document of each word.
    Before a text stand spaces, so a document's n-grams are its own."""
    n, pad = len(offsets) - 1, GRAM - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * pad, np.diff(offsets))
    b = np.full(len(data) + n * pad, 0x20, np.uint8)
    b[at] = _LETTER[data]
    letters = at[b[at] != 0x20]
    wide = b.astype(np.uint32)
    code = wide[letters]
    for j in range(1, GRAM):
        code |= wide[letters - j] << np.uint32(8 * j)
    bins = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    firsts = np.flatnonzero(b[letters - 1] == 0x20) if len(letters) else np.empty(0, np.int64)
    doc = np.searchsorted(offsets[1:] + pad * np.arange(1, n + 1), letters[firsts], side="right")
    return bins, firsts, doc


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.tables = []
        for lang in self.langs:
            c = counts[lang] + 0.5
            self.tables.append(np.log(c / c.sum()).astype(np.float32))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (words x languages) and the document of each word."""
        bins, firsts, doc = grams(data, offsets)
        if not len(firsts) or not self.tables:
            return np.empty((0, len(self.langs))), doc
        return np.stack([np.add.reduceat(t[bins], firsts) for t in self.tables], 1).astype(np.float64), doc

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By document: proportions (0 in all where there are no letters) and the number of languages."""
        n, many = len(offsets) - 1, len(self.langs)
        shares, used = np.zeros((n, many)), np.zeros(n, np.int64)
        ll, doc = self.words(data, offsets)
        if not len(doc) or not many:
            return shares, used
        docs, first, size = np.unique(doc, return_index=True, return_counts=True)
        own = np.repeat(np.arange(len(docs)), size)
        top = ll.max(1)
        p = np.exp(ll - top[:, None])
        full, _ = mixture(p, own, first, size, np.full((len(docs), many), 1 / many))
        order = np.argsort(-full, axis=1, kind="stable")
        single = np.add.reduceat(ll, first, axis=0)
        best = single.argmax(1)
        theta = np.zeros_like(full)
        theta[np.arange(len(docs)), best] = 1
        value = single.max(1) - np.add.reduceat(top, first)
        chosen = np.ones(len(docs), np.int64)
        for k in range(2, min(MOST, many) + 1):
            tried = np.flatnonzero(full[np.arange(len(docs)), order[:, k - 1]] >= LEAST)
            if not len(tried):
                break
            start = np.zeros((len(tried), many))
            np.put_along_axis(start, order[tried, :k], 1 / k, 1)
            rows = np.isin(own, tried)
            sizes = size[tried]
            got, gain = mixture(p[rows], np.repeat(np.arange(len(tried)), sizes), np.r_[0, np.cumsum(sizes)[:-1]], sizes, start)
            gain -= PENALTY * (k - 1) * np.log(np.maximum(sizes, 2))
            better = gain > value[tried]
            at = tried[better]
            value[at], theta[at], chosen[at] = gain[better], got[better], k
        shares[docs], used[docs] = theta, chosen
        return shares, used


def mixture(p: np.ndarray, own: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document and the log-likelihood of its words (less their largest ones)."""
    theta = start
    for _ in range(ROUNDS):
        r = p * theta[own]
        r /= r.sum(1, keepdims=True) + 1e-300
        theta = np.add.reduceat(r, first, axis=0) / size[:, None]
    return theta, np.add.reduceat(np.log((p * theta[own]).sum(1) + 1e-300), first)


def train(docs: DataFrame) -> Model:
    """docs: the training rows (lang, text).  The driver gets CHUNKS rows of BINS / CHUNKS counts for each language."""
    docs = docs.where("lang is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in K.slices(batches):
            data, offsets = K.buffers(batch.column(1))
            own = np.array(batch.column(0).to_pylist(), object)
            bins, firsts, doc = grams(data, offsets)
            of = doc[np.searchsorted(firsts, np.arange(len(bins)), side="right") - 1] if len(bins) else doc
            for lang in set(own):
                tables[lang] = tables.get(lang, 0) + np.bincount(bins[(own == lang)[of]], minlength=BINS)
                if len(tables) >= HELD_LANGS:
                    yield _packed(tables)
                    tables = {}
        yield _packed(tables)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, k, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[lang, k] = sums.get((lang, k), 0) + np.frombuffer(zlib.decompress(part), np.int64)
        yield _batch([(lang, k, zlib.compress(part.tobytes(), 1)) for (lang, k), part in sums.items()])

    schema = "lang string, chunk int, counts binary"
    rows = docs.mapInArrow(count, schema).repartition(parts(docs), "lang", "chunk").mapInArrow(add, schema).collect()
    counts = {r["lang"]: np.zeros(BINS) for r in rows}
    width = BINS // CHUNKS
    for r in rows:
        counts[r["lang"]][r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return Model(counts)


def _packed(tables: dict[str, np.ndarray]) -> pa.RecordBatch:
    return _batch([(lang, k, zlib.compress(part.astype(np.int64).tobytes(), 1)) for lang, t in tables.items() for k, part in enumerate(np.split(t, CHUNKS))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.binary()], strict=True)], names=["lang", "chunk", "counts"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, and the whole mixture."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = send.value
        for batch in K.slices(batches, size=K.SLICE_BYTES * HELD_LANGS // max(HELD_LANGS, len(own.langs))):  # words x languages
            text = batch.column(1)
            data, offsets = K.buffers(text)
            shares, used = own.predict(data, offsets)
            for d in np.flatnonzero(used):  # bytes beyond ASCII are letters only in part
                raw = data[offsets[d] : offsets[d + 1]]
                if not ((raw | 0x20) - 0x61 < 26).any() and not any(map(str.isalpha, text[int(d)].as_py())):
                    used[d] = 0
            best = shares.argmax(1) if len(own.langs) else np.zeros(len(used), np.int64)
            names = [own.langs[b] if u else UNKNOWN for b, u in zip(best, used, strict=True)]
            score = np.where(used > 0, shares.max(1), 0.0) if len(own.langs) else np.zeros(len(used))
            mixed = [[{"lang": own.langs[k], "share": float(row[k])} for k in np.flatnonzero(row > 0)] if u else [] for row, u in zip(shares, used, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mixed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(column: str = "doc_id"):
    return crc_mod(column, 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict all."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out())
