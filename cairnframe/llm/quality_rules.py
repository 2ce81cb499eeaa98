"""Quality rules by distribution divergence (operator 3).

Each language has two references, counted over all its documents: how often each character class occurs, and how often
each of its most common words occurs (all other words are one more class).  A document is compared with the references
of its language by Jensen-Shannon distance (base 2, so from 0 to 1).  Either comparison is made only where the
document is long enough for its histogram to mean something.

Every language has references of its own; rows without one are compared with references over all documents.

Defined results: null, empty and wordless texts have zero counts and fail the base rule; equal rows give equal
results; ties among common words fall to the smaller hash; very long texts are counted whole; a null doc_id stays null;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _counts as C
from . import _kernel as K
from ._spark import parts, regroup

COMMON = 200
#: Guards: code points in words for the character classes, words for the common words.
MIN_CHARS = 200
MIN_WORDS = 50
#: Largest distances of a document that is kept; a histogram of n words strays by about 1 / sqrt(n), so NOISE / sqrt(n)
#: is added to the distance of the common words.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.48
NOISE = 0.6
MIN_BASE_WORDS = 50
ALL = "*"

CLASSES = 12
_CLASS = np.full(256, 6, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, 0x09]], _CLASS[0x0A] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[:0x09] = _CLASS[0x0B:0x20] = _CLASS[0x7F] = 7
_CLASS[0x80:0xC0] = -1  # inside a code point
_CLASS[0xC0:0xCA], _CLASS[0xCA:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 8, 9, 10, 11
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def by_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kinds = _CLASS[data]
    key = np.repeat(np.arange(n) * CLASSES, np.diff(offsets)) + kinds
    return np.bincount(key[kinds >= 0], minlength=n * CLASSES).reshape(n, CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of p against rows of q, both counts; 0 where either row is empty."""
    sp, sq = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where((sp > 0) & (sq > 0), np.sqrt(np.clip(kl.sum(1, keepdims=True) / 2, 0, 1)), 0)[:, 0]


def base_counts(w: K.Words) -> dict[str, np.ndarray]:
    """The counts that do not depend on the corpus."""
    data, offsets, n = w.data, w.offsets, len(w.counts)
    out = {"n_words": w.counts, "n_symbols": by_doc(_SYMBOL[data], offsets)}
    out["word_chars"] = by_doc(K.SPACE_WORDS[data] & (_CLASS[data] >= 0), offsets)
    # lines: ends are line feeds and document ends
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.r_[starts[1:], len(data)]
    inner = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[inner], ends[inner]
    ends = np.where(data[ends - 1] == 0x0A, ends - 1, ends) if len(ends) else ends
    doc = np.searchsorted(offsets, starts, side="right") - 1
    key = K.mix(K.hash_words(K.Words(data, offsets, starts, ends, w.first), False) + doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    # words in three-word windows that occur again in the text
    runs = K.hash_runs(K.hash_words(w, False), 3)
    at = K.inside(w, 3)
    wdoc = w.doc
    key = K.mix(runs[at] + wdoc[at].astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) if len(at) else np.empty(0, K.U64)
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    again = at[times[where] > 1] if len(at) else at
    covered = np.zeros(len(w.starts), bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(wdoc[covered], minlength=n)
    return out


def references(docs: DataFrame, common: int = COMMON) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language (and ALL): class counts, hashes of the common words, and their counts followed by all others'.

    What comes back to the driver is `common` words and a few counts for each language.
    """
    buckets = 2 * parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, C.Tally] = {}
        classes: dict[str, np.ndarray] = {}
        for batch in K.slices(batches):
            data, offsets = K.buffers(batch.column(1))
            w = K.find_words(data, offsets, K.SPACE_WORDS)
            h, cc, wdoc = K.hash_words(w, True), class_counts(data, offsets), w.doc
            own = np.array([ALL if x is None else x for x in batch.column(0).to_pylist()], object)
            for lang in set(own):
                mine = own == lang
                classes[lang] = classes.get(lang, 0) + cc[mine].sum(0)
                words.setdefault(lang, C.Tally()).add(h[mine[wdoc]])
        rows = [(lang, -1, c.astype(np.int64).tobytes(), b"") for lang, c in classes.items()]
        for lang, tally in words.items():
            rows += [(lang, *r) for r in C.packed(*tally.total(), buckets)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["lang", "bucket", "keys", "counts"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, C.Tally] = {}
        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name in (lang, ALL) if lang != ALL else (ALL,):
                    if bucket < 0:
                        classes[name] = classes.get(name, 0) + np.frombuffer(keys, np.int64)
                    else:
                        words.setdefault(name, C.Tally()).add(*C.unpacked(keys, counts))
        rows = [(lang, "class", k, int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
        for lang, tally in words.items():
            keys, counts = tally.total()
            rows.append((lang, "all", 0, int(counts.sum())))
            top = np.lexsort((keys, -counts))[:common]
            rows += [(lang, "word", k, n) for k, n in zip(keys[top].view(np.int64).tolist(), counts[top].tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["lang", "kind", "key", "n"])

    sent = docs.select("lang", "text").mapInArrow(count, "lang string, bucket int, keys binary, counts binary")
    found = regroup(sent).mapInArrow(best, "lang string, kind string, key long, n long")
    found = found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), F.expr("key < 0"), "key"))
    rows = found.withColumn("r", rank).where((F.col("kind") != "word") | (F.col("r") <= common)).orderBy("lang", "kind", "r").toArrow()
    lang, kind = (rows.column(c).to_numpy() for c in ("lang", "kind"))
    key, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    cuts = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1], True]) if len(lang) else np.zeros(1, np.int64)
    out = {}
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        of = {k: np.flatnonzero(kind[i:j] == k) + i for k in ("all", "class", "word")}
        classes = np.zeros(CLASSES)
        classes[key[of["class"]]] = n[of["class"]]
        words, every = of["word"], n[of["all"]].sum()
        out[str(lang[i])] = (classes, key[words].view(np.uint64), np.r_[n[words].astype(float), every - n[words].sum()])
    return out


class Judge:
    """Distances of the documents of a slice from the references of their languages."""

    def __init__(self, refs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], common: int):
        self.number = {lang: i for i, lang in enumerate(sorted(refs))}
        self.classes = np.array([refs[x][0] for x in self.number] or np.zeros((1, CLASSES)))
        self.words = np.zeros((max(1, len(refs)), common + 1))
        keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for lang, i in self.number.items():
            _, hashes, counts = refs[lang]
            self.words[i, : len(hashes)], self.words[i, common] = counts[:-1], counts[-1]
            keys.append(self._key(hashes, np.full(len(hashes), i)))
            places.append(np.arange(len(hashes)))
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key)
        #: common words of all languages: a hash of language and word, and the word's place in its language
        self.keys, self.place = key[order], place[order]
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.common = common

    @staticmethod
    def _key(hashes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return K.mix(hashes + (lang + 1).astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))

    def distances(self, w: K.Words, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        n = len(w.counts)
        rest = self.number.get(ALL, 0)
        of = np.array([self.number.get(x, rest) for x in langs], np.int64)
        char = js_distance(class_counts(w.data, w.offsets), self.classes[of])
        h, wdoc = K.hash_words(w, True), w.doc
        key = self._key(h, of[wdoc])
        place = np.full(len(h), self.common)
        near = np.flatnonzero(self.may[(key >> np.uint64(48)).astype(np.int64)])
        if len(self.keys) and len(near):
            at = np.minimum(np.searchsorted(self.keys, key[near]), len(self.keys) - 1)
            place[near] = np.where(self.keys[at] == key[near], self.place[at], self.common)
        hist = np.bincount(wdoc * (self.common + 1) + place, minlength=n * (self.common + 1)).reshape(n, -1)
        return char, js_distance(hist, self.words[of])


def judge(docs: DataFrame, common: int = COMMON, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Counts, distances and the verdict for each document."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, common))
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(refs.value, common)
        for batch in K.slices(batches):
            data, offsets = K.buffers(batch.column(2))
            w = K.find_words(data, offsets, K.SPACE_WORDS)
            base = base_counts(w)
            char, word = own.distances(w, batch.column(1).to_pylist())
            failed = (base["n_words"] < MIN_BASE_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            odd = (base["word_chars"] >= MIN_CHARS) & (char > max_char) | (base["n_words"] >= MIN_WORDS) & (word > max_word + NOISE / np.sqrt(np.maximum(base["n_words"], 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[c].astype(np.int64)) for c in longs), pa.array(failed), pa.array(~failed & ~odd), pa.array(char), pa.array(word)],
                names=["doc_id", *longs, "base_failed", "kept", "char_distance", "word_distance"],
            )

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)
