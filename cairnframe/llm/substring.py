"""Substring removal by super-k-mer partitioning (operator 5).

A window is `window` consecutive words.  Its minimiser is the smallest hash among the runs of `run` words in it;
consecutive windows that share one form a super-k-mer, and equal windows always have equal minimisers.

1.  Every super-k-mer announces its minimiser: packed arrays of (minimiser, document, position) go to buckets of
    minimisers.  Only minimisers announced more than once can hold equal windows.
2.  The super-k-mers of those travel to their bucket as one packed string of words each.  There the windows are cut
    out, sorted, and counted by their words.
3.  Windows counted more than once go back to their documents, where the words they cover are removed.

Windows are judged on the input.  Each task sums before it sends: a minimiser or super-k-mer it sees twice is known to
be repeated, so one copy goes to the bucket, and its places go straight back.  The windows of a hot minimiser (a
passage a third of all documents share) travel one by one, each to the bucket of its own hash, so no bucket is hot.

Defined results: null and wordless texts have no windows; fewer words than a window: nothing is removed; a text equal
to another loses all the words windows cover; several rows of one doc_id, or without one, are separate documents (rows
carry a number of their own while they travel); of runs with equal hashes in a window the first is its minimiser; very
long texts are cut nowhere; other columns are passed through by `remove`, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _counts as C
from . import _kernel as K
from ._spark import buckets_for, flagged, keep, regroup, shielded

WINDOW = 35
RUN = 20
#: A minimiser announced more often than HOT times is hot: its windows travel one by one, each to the bucket of its own
#: hash.  Of more than HOT_SHARE such minimisers the HOT_SHARE announced most often are, so what is broadcast is bounded.
HOT = 1_000
HOT_SHARE = 1_000_000


class SuperKmers:
    """The super-k-mers of a slice: first window (a word position), number of windows, and minimiser.  They end where the
    place of the minimiser changes, so a text that repeats itself announces its minimiser once for each repeat."""

    def __init__(self, text: pa.Array, window: int, run: int):
        data, offsets = K.buffers(text)
        self.words = w = K.find_words(data, offsets, K.SPACE_WORDS)
        self.hashes = K.hash_words(w, False)
        at = K.inside(w, window)
        if not len(at):
            self.start = self.count = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        low = K.hash_windows(self.hashes, run)
        place = np.arange(len(low), dtype=np.int32)
        width, have = window - run + 1, 1
        while have < width:  # the first smallest of `width` neighbours, by doubling
            step = min(have, width - have)
            right = low[step:] < low[:-step]
            low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
            have += step
        key, place = low[at], place[at]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
        self.start, self.key = at[new], key[new]
        self.count = np.diff(np.r_[new, len(at)])

    @property
    def doc(self) -> np.ndarray:
        return np.searchsorted(self.words.first, self.start, side="right") - 1


def code(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a minimiser.  Two minimisers of one code only let more super-k-mers travel."""
    return C.bucket_of(keys, buckets).astype(np.uint64) << K.U64(32) | keys & K.U64(0xFFFFFFFF)


def with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def _announce(buckets: int, window: int, run: int):
    """(part, rows, keys, counts): announcements of a bucket, or (rows, keys) known here to be repeated."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for batch in K.slices(batches):
            got = SuperKmers(batch.column(1), window, run)
            keys.append(code(got.key, buckets))
            rows.append(batch.column(0).to_numpy(zero_copy_only=False)[got.doc])
        if not keys:
            return
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        lone = np.repeat(size == 1, size)
        sent: list[tuple] = []
        one_key, one_row, many_key, many = key[lone], row[lone], key[first[size > 1]], size[size > 1]
        cut_one = np.searchsorted(one_key >> K.U64(32), np.arange(buckets + 1))
        cut_many = np.searchsorted(many_key >> K.U64(32), np.arange(buckets + 1))
        for b in range(buckets):
            i, j, k, m = cut_one[b], cut_one[b + 1], cut_many[b], cut_many[b + 1]
            if j > i or m > k:
                all_keys = np.concatenate([one_key[i:j], many_key[k:m]]).astype(np.uint32)
                sent.append((b, one_row[i:j].tobytes(), all_keys.tobytes(), many[k:m].astype(np.uint32).tobytes()))
        sent += [(-1 - int(r % buckets), np.int64(r).tobytes(), c, b"") for r, c in by_row(row[~lone], key[~lone])]
        yield _blobs(sent)

    return out


def by_row(row: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each row with its values, packed."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), np.r_[first[1:], len(row)].tolist() if len(row) else [], strict=True):
        yield int(row[a]), value[a:b].tobytes()


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "a", "b", "c"])


BLOBS = "bucket int, a binary, b binary, c binary"


def _collect(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    got: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(bucket, []).append(tuple(blobs))
    return got


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, codes) of repeated minimisers; (null, codes) with counts for those announced often."""
    rows_out, codes_out, counts_out = [], [], []
    found_rows, found_codes = [], []
    got = _collect(batches)
    while got:
        bucket, blobs = got.popitem()
        if bucket < 0:
            for row, codes, _ in blobs:
                rows_out.append(int(np.frombuffer(row, np.int64)[0]))
                codes_out.append(codes)
                counts_out.append(None)
            continue
        keys, rows, counts = [], [], []
        for a, b, c in blobs:
            row, many = np.frombuffer(a, np.int64), np.frombuffer(c, np.uint32)
            keys.append(np.frombuffer(b, np.uint32))
            rows.append(np.r_[row, np.zeros(len(many), np.int64)])
            counts.append(np.r_[np.ones(len(row), np.int64), many.astype(np.int64)])
        key, row, count = np.concatenate(keys), np.concatenate(rows), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, row, count = key[order], row[order], count[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        total = np.add.reduceat(count, first)
        full = key.astype(np.uint64) | K.U64(bucket) << K.U64(32)
        back = np.repeat(total > 1, size) & (count == 1)
        found_rows.append(row[back])
        found_codes.append(full[back])
        often = total > HOT
        if often.any():
            rows_out.append(None)
            codes_out.append(full[first[often]].tobytes())
            counts_out.append(total[often].tobytes())
    if found_rows:
        for row, codes in by_row(np.concatenate(found_rows), np.concatenate(found_codes)):
            rows_out.append(row)
            codes_out.append(codes)
            counts_out.append(None)
    yield pa.RecordBatch.from_arrays([pa.array(rows_out, pa.int64()), pa.array(codes_out, pa.binary()), pa.array(counts_out, pa.binary())], names=["_row", "codes", "counts"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["code", "n"])


def _travel(buckets: int, window: int, run: int, hot: np.ndarray):
    """Packed super-k-mers of repeated minimisers, by bucket; hits that are certain already come as bucket -1 - x."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in ("row", "start", "count", "key", "name", "text", "length")}
        for batch in K.slices(batches):
            got = SuperKmers(batch.column(1), window, run)
            codes, doc = code(got.key, buckets), got.doc
            wanted = np.zeros(len(codes), bool)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for d, lists in enumerate(batch.column(2).to_pylist()):
                mine = slice(cuts[d], cuts[d + 1])
                wanted[mine] = np.isin(codes[mine], np.concatenate([np.frombuffer(x, np.uint64) for x in lists]))
            start, count, key, doc = got.start[wanted], got.count[wanted], got.key[wanted], doc[wanted]
            if not len(start):
                continue
            if len(hot) and (is_hot := np.isin(codes[wanted], hot)).any():
                times = np.where(is_hot, count, 1)
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                start, doc, single = np.repeat(start, times) + within, np.repeat(doc, times), np.repeat(is_hot, times)
                count = np.where(single, 1, np.repeat(count, times))
                key = np.where(single, K.hash_windows(got.hashes, window, 3)[start], np.repeat(key, times))
            w = got.words
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(K.mix(got.hashes) * K._powers(max(18, (len(got.hashes) + 1).bit_length()), 0xD6E8FEB86659FD93)[: len(got.hashes)])]
            inverse = K._powers(max(18, (len(got.hashes) + 1).bit_length()), pow(0xD6E8FEB86659FD93, -1, 1 << 64))
            name = K.mix((sums[start + count + window - 1] - sums[start]) * inverse[start] + count.astype(np.uint64))
            row = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            a, b = w.starts[start], w.ends[start + count + window - 2]
            raw = w.data.tobytes()
            held["row"].append(row)
            held["start"].append(start - w.first[doc])
            held["count"].append(count)
            held["key"].append(key)
            held["name"].append(name)
            held["text"] += [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        if not held["row"]:
            return
        row, start, count, key, name = (np.concatenate(held[k]) for k in ("row", "start", "count", "key", "name"))
        # super-k-mers found twice here: all their windows are repeated, and one copy tells the bucket
        order = np.lexsort((row, name))
        first = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
        size = np.diff(np.r_[first, len(order)])
        twice = np.zeros(len(row), bool)
        twice[order] = np.repeat(size > 1, size)
        send = np.sort(order[first])
        bucket = C.bucket_of(key[send], buckets)
        by = np.argsort(bucket, kind="stable")
        send, bucket = send[by], bucket[by]
        rows: list[tuple] = []
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = send[cuts[b] : cuts[b + 1]]
            texts = [held["text"][k] for k in part.tolist()]
            head = np.stack([np.where(twice[part], 0, row[part]), start[part], np.array([len(t) for t in texts]), twice[part]], 1).astype(np.int64)
            rows.append((b, pa.compress(head.tobytes(), "zstd", asbytes=True), pa.compress(b"".join(texts), "zstd", asbytes=True), np.array([head.nbytes, sum(map(len, texts))]).tobytes()))
        spans = start[twice].astype(np.uint64) << K.U64(32) | count[twice].astype(np.uint64)
        rows += [(-1 - int(r % buckets), np.int64(r).tobytes(), s, b"") for r, s in by_row(row[twice], spans)]
        yield _blobs(rows)

    return out


def _windows(head: bytes, texts: bytes, sizes: bytes, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Two hashes, row, start, and one more copy or none, for each window of the super-k-mers of a blob.  Super-k-mers
    are read in pieces of about SLICE_BYTES; only the windows' numbers stay."""
    n_head, n_text = np.frombuffer(sizes, np.int64).tolist()
    table = np.frombuffer(pa.decompress(head, n_head, "zstd", asbytes=True), np.int64).reshape(-1, 4)
    data = np.frombuffer(pa.decompress(texts, n_text, "zstd", asbytes=True), np.uint8)
    ends = np.r_[0, np.cumsum(table[:, 2])]
    at = 0
    while at < len(table):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + K.SLICE_BYTES, side="right")) - 1)
        w = K.find_words(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], K.SPACE_WORDS)
        h = K.hash_words(w, False)
        first = K.inside(w, window)
        own = np.searchsorted(w.first, first, side="right") - 1
        mine = table[at:to][own]
        yield K.hash_windows(h, window, 1)[first], K.hash_windows(h, window, 2)[first], mine[:, 0], first - w.first[own] + mine[:, 1], mine[:, 3]
        at = to


def _count_windows(window: int):
    """(row, spans): windows found more than once, as start << 32 | number of windows."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_out, spans_out = [], []
        hit_rows, hit_spans = [], []
        got = _collect(batches)
        while got:
            bucket, blobs = got.popitem()
            if bucket < 0:
                for row, spans, _ in blobs:
                    rows_out.append(int(np.frombuffer(row, np.int64)[0]))
                    spans_out.append(spans)
                continue
            parts_: list[tuple[np.ndarray, ...]] = []
            while blobs:
                parts_ += _windows(*blobs.pop(), window)
            one, two, row, start, more = (np.concatenate(x) for x in zip(*parts_, strict=True))
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=1 + more[order])
            again = np.zeros(len(row), bool)
            again[order] = (total > 1)[group]
            again &= more == 0
            hit_rows.append(row[again])
            hit_spans.append(start[again].astype(np.uint64) << K.U64(32) | K.U64(1))
        if hit_rows:
            for row, spans in by_row(np.concatenate(hit_rows), np.concatenate(hit_spans)):
                rows_out.append(row)
                spans_out.append(joined([spans]))
        yield pa.RecordBatch.from_arrays([pa.array(rows_out, pa.int64()), pa.array(spans_out, pa.binary())], names=["_row", "spans"])

    return out


def joined(blobs: list[bytes]) -> bytes:
    """Spans of windows with neighbours and overlaps united."""
    spans = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]))
    start, end = (spans >> K.U64(32)).astype(np.int64), (spans >> K.U64(32)).astype(np.int64) + (spans & K.U64(0xFFFFFFFF)).astype(np.int64)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    last = np.r_[new[1:] - 1, len(start) - 1]
    return (start[new].astype(np.uint64) << K.U64(32) | (reach[last] - start[new]).astype(np.uint64)).tobytes()


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """_row, spans array<binary>: where windows that occur more than once start.  docs must have _row and text."""
    docs = docs.select("_row", "text")
    buckets = buckets_for(docs)
    tasks = buckets // 2
    found = keep(regroup(docs.mapInArrow(_announce(buckets, window, run), BLOBS), tasks=tasks).mapInArrow(_repeated, "_row long, codes binary, counts binary"))
    often = found.where("_row is null").select("codes", "counts").mapInArrow(_each, "code long, n long")
    hot = often.orderBy(F.desc("n"), "code").limit(HOT_SHARE).toArrow().column("code").to_numpy().view(np.uint64)
    wanted = found.where("_row is not null").groupBy("_row").agg(F.collect_list("codes").alias("codes"))
    some = flagged(docs, "_row", found.where("_row is not null"), "_row").where("_maybe").drop("_maybe")
    # equal rows have one number: each is a document of its own and both travel
    both = some.join(wanted, "_row").select("_row", "text", "codes")
    sent = both.mapInArrow(_travel(buckets, window, run, np.sort(hot)), BLOBS)
    hits = regroup(sent, tasks=tasks).mapInArrow(_count_windows(window), "_row long, spans binary")
    return hits.groupBy("_row").agg(F.collect_list("spans").alias("spans"))


def covered(n: int, blobs: list[bytes], window: int) -> np.ndarray:
    """Which of n words lie in the windows."""
    spans = np.frombuffer(joined(blobs), np.uint64)
    edge = np.zeros(n + 1, np.int64)
    start = (spans >> K.U64(32)).astype(np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + (spans & K.U64(0xFFFFFFFF)).astype(np.int64) + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _split(docs: DataFrame, window: int, run: int) -> tuple[DataFrame, DataFrame]:
    """Rows surely without hits, and the others with their hits (null where there are none)."""
    hits = keep(repeated_windows(docs, window, run))
    both = flagged(docs, "_row", hits, "_row")
    return both.where(~F.col("_maybe")).drop("_maybe"), both.where("_maybe").drop("_maybe").join(hits, "_row", "left")


def digest(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, words, words removed, and the sha256 of the kept words joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for text, blobs in zip(batch.column(1), spans, strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if blobs:
                    gone = covered(len(words), blobs, window)
                    kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    clean, hit = _split(with_row(docs.select("doc_id", "text")), window, run)
    return clean.select("doc_id", "text").mapInArrow(out, schema).unionByName(hit.select("doc_id", "text", "spans").mapInArrow(out, schema))


def remove(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """The documents with all columns; where windows repeat, text is the kept words joined by one space.  A document
    that loses all its words goes; one that had none stays."""
    given, docs = docs.columns, shielded(docs)
    names, at, width = docs.columns, docs.columns.index("text"), len(docs.columns)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            emptied = [False] * len(texts)
            for k, blobs in enumerate(batch.column(width).to_pylist()):
                if blobs:
                    words = texts[k].encode().split()
                    gone = covered(len(words), blobs, window)
                    texts[k] = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g]).decode()
                    emptied[k] = not texts[k]
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(width)]
            made = pa.RecordBatch.from_arrays(columns, names=names)
            yield made.filter(pa.array([not e for e in emptied])) if any(emptied) else made

    clean, hit = _split(with_row(docs), window, run)
    return clean.select(*names).unionByName(hit.select(*names, "spans").mapInArrow(out, docs.schema)).toDF(*given)
