"""Quality classifier from weak labels (operator 10).

Two questions are asked of a document: is it of low quality, is it toxic.  For each, overlapping heuristic labellers
vote yes, no or abstain; the given label, where there is one, is one more labeller.  Expectation-maximisation over the
counts of vote patterns of all documents estimates how each labeller, the given label too, answers for each hidden kind
of document, and so the posterior of each pattern.  Posteriors are the only targets of the scorer: a linear scorer over hashed words and steps of
a few ratios (logistic regression) learns them on a sample drawn by hash from all documents, labelled or not.  The
scorer, which sees the whole text, decides alone.

Bounds, all of them parameters: MAX_LABELLED rows of `labels` (the smallest hashes of doc_id) teach the toxic words and
vote; MAX_TRAINING documents (a quarter of likely low quality, a quarter likely toxic, half neither, each by hash) with
at most MAX_FEATURES features train the scorer.  Everything else covers all documents.  Vote patterns are at most
3 ** labellers.

Defined results: null, empty and wordless texts are kept with scores of the bias alone unless a labeller says
otherwise; null labels abstain, and of several label rows of a document the largest values count; without any labels the
toxic question has no labeller and nobody is toxic; equal texts get equal scores, and each row of a repeated document
votes; documents without id have no label; ties in the sample's order go by the features; very long texts are read
whole, and train the scorer if the features of the sample hold them; other columns are ignored by `classify` and passed
through by `keep_good`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _counts as C
from . import _kernel as K
from ._spark import parts, regroup
from .quality_rules import base_counts, by_doc

MAX_LABELLED = 20_000
MAX_TRAINING = 8_000
MAX_FEATURES = 8_000_000
BITS = 20
WORDS = 1 << BITS
STEM = 5
#: Steps of a ratio; each ratio has one feature for each step.
STEPS = 21
RATIOS = 5
#: Features: hashed words and stems, steps of the ratios, and the bias.
SIZE = WORDS + RATIOS * STEPS + 1
#: A word belongs to a lexicon if so large a part of the labelled documents that hold it are toxic, and if that many
#: would be toxic by chance with less than this probability.
MIN_PRECISION = 0.9
MAX_CHANCE = 1e-5
REJECT = 0.72
QUESTIONS = ("low", "toxic")
#: labellers of each question; the last of each is the given label
LABELLERS = {"low": 6, "toxic": 5}


def words_of(text: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Lower-cased words: hashes of the words and of their stems (first STEM bytes)."""
    data, offsets = K.buffers(text)
    w = K.find_words(data, offsets, K.ALNUM_WORDS)
    stem = K.Words(data, offsets, w.starts, np.minimum(w.ends, w.starts + STEM), w.first)
    return w, K.hash_words(w, True), K.mix(K.hash_words(stem, True) + K.U64(11))


def unique_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value), by document."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], value[new]


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature): words and their stems, hashed to BITS bits, and steps of a few ratios."""
    data, offsets = K.buffers(text)
    w, h, stem = words_of(text)
    shift = K.U64(64 - BITS)
    ratios = shares(K.find_words(data, offsets, K.SPACE_WORDS))
    n = len(offsets) - 1
    steps = [WORDS + STEPS * k + np.minimum((STEPS - 1) * r, STEPS - 1).astype(np.int64) for k, r in enumerate(ratios.values())]
    doc = np.concatenate([w.doc, w.doc, *[np.arange(n)] * len(steps)])
    value = np.concatenate([(K.mix(h + K.U64(7)) >> shift).astype(np.int64), (stem >> shift).astype(np.int64), *steps])
    return unique_pairs(doc, value)


def shares(w: K.Words) -> dict[str, np.ndarray]:
    """Ratios that tell a document's form."""
    base = base_counts(w)
    n = np.maximum(w.counts, 1)
    data = w.data
    upper = by_doc((data >= 0x41) & (data <= 0x5A), w.offsets)
    lower = by_doc((data >= 0x61) & (data <= 0x7A), w.offsets)
    lines = by_doc(data == 0x0A, w.offsets) + 1
    h = K.hash_words(w, True)
    same = np.zeros(len(h), bool)
    at = K.inside(w, 2)
    same[at] = h[at] == h[at + 1] if len(at) else False
    return {
        "repeat": base["n_repeat_words"] / n,
        "upper": upper / np.maximum(upper + lower, 1),
        "lines": base["n_dup_lines"] / lines,
        "symbols": base["n_symbols"] / n,
        "stutter": np.bincount(w.doc[same], minlength=len(n)) / n,
    }


class Lexicon:
    """Sorted hashes of words and stems that mark toxic documents, as three sets of labelled documents teach them: the two
    halves of the labelled documents, and all."""

    def __init__(self, keys: np.ndarray, taught: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.taught = keys[order], taught[order]

    def of(self, *keys: np.ndarray) -> np.ndarray:
        """By word, bits of the sets that hold the word or its stem."""
        out = np.zeros(len(keys[0]), np.uint8)
        for key in keys if len(self.keys) else ():
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out |= np.where(self.keys[at] == key, self.taught[at], 0).astype(np.uint8)
        return out


def votes(text: pa.Array, quality: np.ndarray, toxic: np.ndarray, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """By question, (documents x labellers) of 1 yes, -1 no, 0 abstain."""
    data, offsets = K.buffers(text)
    plain = K.find_words(data, offsets, K.SPACE_WORDS)
    long_enough = plain.counts >= 20
    r = shares(plain)
    say = lambda x, yes, no: np.where(x > yes, 1, np.where((x <= no) & long_enough, -1, 0))
    low = [say(r["repeat"], 0.5, 0.25), say(r["upper"], 0.5, 0.3), say(r["lines"], 0.3, 0.0), say(r["symbols"], 0.3, 0.1), say(r["stutter"], 0.2, 0.02)]
    w, h, stem = words_of(text)
    n = len(offsets) - 1
    if len(lexicon.keys):
        hit = lexicon.of(h, stem)
        half = [np.bincount(w.doc[hit & k > 0], minlength=n) for k in (1, 2)]
        doc, value = unique_pairs(w.doc[hit > 0], h[hit > 0])
        distinct, share = np.bincount(doc, minlength=n), np.bincount(w.doc[hit > 0], minlength=n) / np.maximum(w.counts, 1)
        # a word of either half of the lexicon; several words of it; a share of words in it
        toxics = [say(half[0], 0, 0), say(half[1], 0, 0), say(distinct, 1, 0), say(share, 0.01, 0)]
    else:
        toxics = [np.zeros(n, np.int64)] * (LABELLERS["toxic"] - 1)
    return {"low": np.stack([*low, -quality], 1), "toxic": np.stack([*toxics, toxic], 1)}


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of `yes` for each pattern of votes.

    Documents can be bad in several ways that exclude each other, so the hidden answer is no or one of as many kinds of
    yes as there are heuristic labellers.  Expectation-maximisation estimates how often each labeller, the given label
    (the last) like the others, says yes to documents of each kind; an abstention says nothing.  It starts with kind j
    where labeller j says yes.  A kind counts as yes as often as given labels say yes to its documents, or wholly where
    there are no given labels.
    """
    given, n = patterns[:, -1], patterns.shape[1] - 1
    yes = patterns[:, :-1] > 0
    q = np.empty((len(patterns), n + 1))
    q[:, 1:] = np.where(yes.any(1)[:, None], 0.9 * yes / np.maximum(yes.sum(1), 1)[:, None], 0.05 / n)
    q[:, 0] = 1 - q[:, 1:].sum(1)
    for _ in range(rounds):
        weight = counts[:, None] * q
        total = np.repeat(np.log((weight.sum(0) + 1) / (weight.sum() + n + 1))[None], len(q), 0)
        for votes_ in patterns.T:
            said = weight[votes_ != 0].sum(0) + 1
            for v in (-1, 1):
                total[votes_ == v] += np.log((weight[votes_ == v].sum(0) + 0.5) / said)
        q = np.exp(total - total.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
    kinds = np.r_[0.0, np.ones(n)]
    if (given != 0).any():
        said_yes, said_no = ((counts[:, None] * q)[given == v].sum(0) for v in (1, -1))
        kinds = (said_yes + np.r_[0.05, np.ones(n)]) / (said_yes + said_no + 1)
    return q @ kinds


def _sizes(doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """By feature of a document: words weigh 1 / sqrt(words), steps of ratios 1."""
    word = feature < WORDS
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc[word], minlength=n), 1))
    return np.where(word, scale[doc], 1.0)


def fit(doc_first: np.ndarray, feature: np.ndarray, target: np.ndarray, rounds: int = 60, rate: float = 0.1, penalty: float = 1e-6) -> np.ndarray:
    """Weights (features, then the bias) of a logistic regression on soft targets, by full-batch Adam.  A feature of
    one document alone says nothing about others and gets no weight."""
    size = np.diff(np.r_[doc_first, len(feature)])
    shared = np.bincount(feature, minlength=SIZE) > 1
    good = shared[feature]
    own, feature = np.repeat(np.arange(len(size)), size), feature
    value = _sizes(own, feature, len(size))[good].astype(np.float32)
    own, feature = own[good].astype(np.int32), feature[good]
    used = np.flatnonzero(shared)
    place = np.zeros(SIZE, np.int32)
    place[used] = np.arange(len(used))
    at = place[feature]
    del good, feature
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    yes = target.mean()
    balance = target * 0.5 / max(yes, 0.02) + (1 - target) * 0.5 / max(1 - yes, 0.02)
    for t in range(1, rounds + 1):
        z = np.bincount(own, weights=w[at] * value, minlength=len(size)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance / len(target)
        g, gb = np.bincount(at, weights=error[own] * value, minlength=len(used)) + penalty * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, bias = w - step * m / (np.sqrt(v) + 1e-8), bias - step * mb / (np.sqrt(vb) + 1e-8)
    out = np.zeros(SIZE, np.float32)
    out[used], out[-1] = w, bias
    return out


def scores(weights: np.ndarray, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    z = np.bincount(doc, weights=weights[feature] * _sizes(doc, feature, n), minlength=n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pick(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled documents: the smallest hashes of doc_id.  Small enough to broadcast by that bound."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _sign(column: pa.Array) -> np.ndarray:
    """1 and 0 as 1 and -1; null as 0."""
    return np.array([0 if x is None else 1 if x > 0 else -1 for x in column.to_pylist()])


def marks(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Whether words of so many toxic and clean documents mark toxic ones; `rate` of all labelled documents are toxic."""
    log = np.r_[0.0, np.cumsum(np.log(np.arange(1, int((toxic + clean).max(initial=0)) + 1)))]
    chance = log[toxic + clean] - log[toxic] - log[clean] + toxic * np.log(max(rate, 1e-9)) + clean * np.log(max(1 - rate, 1e-9))
    return (toxic >= MIN_PRECISION * (toxic + clean)) & (toxic > 0) & (chance < np.log(MAX_CHANCE))


def lexicon_of(labelled: DataFrame, rate: float) -> Lexicon:
    """The words that mark toxic documents among the labelled ones, whose number bounds the lexicon."""
    buckets = parts(labelled)
    kinds = [(half, sign) for half in (0, 1) for sign in (1, -1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = {k: C.Tally() for k in kinds}
        for batch in K.slices(batches):
            toxic, half = _sign(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            w, h, stem = words_of(batch.column(0))
            doc, value = unique_pairs(np.r_[w.doc, w.doc], np.r_[h, stem])
            for (own, sign), t in tally.items():
                t.add(value[(toxic[doc] == sign) & (half[doc] == own)])
        rows = [(kinds.index(k), *r) for k, t in tally.items() for r in C.packed(*t.total(), buckets)]
        yield _batch(rows, ["kind", "bucket", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = {k: C.Tally() for k in kinds}
        for batch in batches:
            for kind, _, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tally[kinds[kind]].add(*C.unpacked(keys, counts))
        totals = [t.total() for t in tally.values()]
        keys = np.unique(np.concatenate([totals[k][0] for k in (0, 2)]))
        times = np.zeros((4, len(keys)), np.int64)
        for row, (own, n) in zip(times, totals, strict=True):
            if len(own) and len(keys):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                row[:] = np.where(own[at] == keys, n[at], 0)
        taught = marks(times[0], times[1], rate) + 2 * marks(times[2], times[3], rate) + 4 * marks(times[0] + times[2], times[1] + times[3], rate)
        good = taught > 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[good].view(np.int64)), pa.array(taught[good].astype(np.int64))], names=["key", "taught"])

    half = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)).alias("half")
    sent = labelled.select("text", "quality", "toxic", half).mapInArrow(count, "kind int, bucket int, keys binary, counts binary")
    rows = regroup(sent).mapInArrow(choose, "key long, taught long").collect()
    return Lexicon(np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array([r["taught"] for r in rows], np.uint8))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


class Scorer:
    """The fitted model: one weight vector for each question, SIZE numbers each."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def score(self, text: pa.Array) -> dict[str, np.ndarray]:
        doc, feature = features(text)
        return {q: scores(w, doc, feature, len(text)) for q, w in self.weights.items()}


def _pattern(got: dict[str, np.ndarray]) -> np.ndarray:
    every = np.concatenate(list(got.values()), 1) + 1
    return (every * 3 ** np.arange(every.shape[1])).sum(1)


def posteriors(codes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """By question, what the votes of each pattern say."""
    patterns = codes[:, None] // 3 ** np.arange(sum(LABELLERS.values())) % 3 - 1
    split = LABELLERS["low"]
    toxic = patterns[:, split:]
    return {"low": label_model(patterns[:, :split], counts), "toxic": label_model(toxic, counts) if (toxic != 0).any() else np.zeros(len(codes))}


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_training: int = MAX_TRAINING, max_features: int = MAX_FEATURES) -> Scorer:
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    picked = _pick(labels, max_labelled)
    rate = picked.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0] or 0.0
    sample = F.broadcast(picked)
    lexicon = sc.broadcast(lexicon_of(docs.join(sample, "doc_id").select("doc_id", "text", "quality", "toxic"), rate))
    both = docs.join(sample, "doc_id", "left").select(F.xxhash64("doc_id", "text").alias("hash"), "text", "quality", "toxic")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            values, counts = np.unique(_pattern(votes(batch.column(1), _sign(batch.column(2)), _sign(batch.column(3)), lexicon.value)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["pattern", "n"])

    rows = both.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return Scorer({q: np.r_[np.zeros(SIZE - 1, np.float32), np.float32(-1e-9)] for q in QUESTIONS})
    codes, counts = np.array([r["pattern"] for r in rows]), np.array([r["n"] for r in rows], float)
    found = posteriors(codes, counts)
    # three strata by what the votes say, each sampled by hash; a little more than its share, which `solve` cuts
    stratum = np.where(found["low"] >= 0.5, 1, np.where(found["toxic"] >= 0.5, 2, 0))
    shares_ = np.array([0.5, 0.25, 0.25])
    rate = np.minimum(1, 1.3 * shares_ * max_training / np.maximum(np.bincount(stratum, counts, 3), 1))
    send = sc.broadcast((codes, found["low"], found["toxic"], stratum, rate))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, low, toxic, stratum, rate = send.value
        for batch in K.slices(batches):
            at = np.searchsorted(codes, _pattern(votes(batch.column(1), _sign(batch.column(2)), _sign(batch.column(3)), lexicon.value)))
            hashed = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = np.flatnonzero(hashed.view(np.uint64) / 2.0**64 <= rate[stratum[at]])
            if not len(chosen):
                continue
            at = at[chosen]
            doc, feature = features(batch.column(1).take(pa.array(chosen)))
            cuts = np.searchsorted(doc, np.arange(len(chosen) + 1))
            packed = [feature[cuts[k] : cuts[k + 1]].astype(np.int32).tobytes() for k in range(len(chosen))]
            yield pa.RecordBatch.from_arrays([pa.array(stratum[at]), pa.array(hashed[chosen]), pa.array(packed, pa.binary()), pa.array(low[at]), pa.array(toxic[at])], names=["stratum", "hash", "features", "low", "toxic"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, float, float]] = []
        docs_, size = np.zeros(3, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for stratum, _, packed, low, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(packed, np.int32)
                if docs_[stratum] < shares_[stratum] * max_training and size[stratum] + len(part) <= shares_[stratum] * max_features:
                    held.append((part, low, toxic))
                    docs_[stratum] += 1
                    size[stratum] += len(part)
        if not held:
            return
        first = np.r_[0, np.cumsum([len(p) for p, _, _ in held])[:-1]]
        feature = np.concatenate([p for p, _, _ in held])
        fitted = [fit(first, feature, np.array([r[1 + k] for r in held])).tobytes() for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(list(QUESTIONS)), pa.array(fitted, pa.binary())], names=["question", "weights"])

    drawn = both.mapInArrow(learn, "stratum long, hash long, features binary, low double, toxic double").repartition(1).sortWithinPartitions("stratum", "hash", "features")
    got = drawn.mapInArrow(solve, "question string, weights binary").collect()
    return Scorer({r["question"]: np.frombuffer(r["weights"], np.float32) for r in got})


def classify(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, the scores of both questions, and whether the document is kept."""
    send = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            got = send.value.score(batch.column(1))
            kept = (got["low"] < reject) & (got["toxic"] < reject)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got["low"]), pa.array(got["toxic"]), pa.array(kept)], names=["doc_id", "low_score", "toxic_score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, low_score double, toxic_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    send = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            got = send.value.score(batch.column(at))
            yield batch.filter(pa.array((got["low"] < reject) & (got["toxic"] < reject)))

    return docs.mapInArrow(run, docs.schema)
