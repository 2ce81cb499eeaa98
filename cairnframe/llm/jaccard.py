"""N-gram Jaccard join by set-relation skipping (operator 4).

A document is the set of its distinct five-word shingles.  Two documents link when 100 * intersection >= 75 * union.

1.  Equal sets are merged: one set of each group goes on (its smallest row number), so copies cost nothing more.
2.  Each set is sorted with rare shingles first (by a table of counts over the whole corpus), and the prefix that two
    linked sets must share is indexed.  An index list holds (set, size, position), in order of size.
3.  Index level: lists are cut into blocks of sizes that can link; a whole block is skipped where the remaining sizes
    after the positions cannot reach the overlap that a link needs.
4.  Answer level: each block first asks only for links with one leader.  Sets linked with the same leader are known to
    be connected, so their pairs are skipped; what is left are pairs of different components.  Such a pair (y, z) is
    answered from the leader x of z: |y & z| = |y & x| - |y & (x - z)| + |y & (z - x)|, where the two differences are
    known from the link of z and small.  One pair of each two components is answered first, and where it links, their
    other pairs are skipped too; the last of ROUNDS rounds answers all that are left.  Sets that are near one leader x
    are its family, linked with it or not: all pairs of a family are answered from the differences to x alone, through an
    index of the differences, so a large group of near copies makes no rows of pairs.
5.  Components come from the links by star contraction.

The table of counts only orders the shingles: it changes the work and never the result.  Sets, lists and differences
travel as packed arrays.  No list is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _counts as C
from . import _kernel as K
from ._components import components
from ._spark import buckets_for, flagged, keep, parts, regroup, shielded, spread_join

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
#: The table of counts that orders shingles has an entry for LOAD shingles of the corpus, between 2**18 and
#: 2**MAX_TABLE_BITS of them (64 MB of levels at most); the order has 8 levels.
LOAD = 8
MAX_TABLE_BITS = 26
CHUNKS = 64
#: Prefix entries that a task holds before it sends them.
FLUSH = 400_000
#: Leaders of a block of a long list.
LEADERS = 16
#: Index lists up to this length are asked for all their pairs at once, longer ones by leaders first.
SHORT = 8
#: Bytes of a shingle's hash in sets that travel.
ITEM = 8
#: One shingle in EXTRA is added to a prefix.
EXTRA = 25
#: Rows of a hot leader that one task answers.
SPLIT = 2_000
#: Two sets are near if they share one item in NEAR of the larger; a set that FAMILY others are near to has a family, which
#: is answered in parts of SPLIT sets.
NEAR = 4
FAMILY = 32
#: Rounds in which pairs between components are answered; the last answers all that are left.
ROUNDS = 3


def matches(size: np.ndarray) -> np.ndarray:
    """A set's prefix is longer than needed by so many shingles less one; then two linked sets share at least the smaller
    of their two numbers of shingles in both prefixes, and pairs that share fewer need no answer."""
    return 1 + size // EXTRA


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection with which sets of sizes a and b link."""
    return -((-NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


class Sets:
    """Distinct shingles of the documents of a slice, in order of (document, shingle)."""

    def __init__(self, text: pa.Array, levels: np.ndarray | None = None):
        data, offsets = K.buffers(text)
        w = K.find_words(data, offsets, K.SPACE_WORDS)
        h = K.hash_words(w, True)
        at = K.inside(w, WORDS)
        few = np.flatnonzero((w.counts > 0) & (w.counts < WORDS))
        whole = [K.mix(np.array([int(K.hash_runs(h[w.first[d] : w.first[d + 1]], int(w.counts[d]))[0])], np.uint64) + K.U64(int(w.counts[d]))) for d in few]
        value = np.concatenate([K.hash_runs(h, WORDS)[at], *whole]) if len(at) or len(few) else np.empty(0, np.uint64)
        doc = np.concatenate([w.doc[at], few])
        value = value >> K.U64(3)
        if levels is not None:  # rare shingles first: their level stands in the top bits
            value = value | levels[(value & K.U64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << K.U64(61)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
        self.doc, self.value = doc[new], value[new]
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.size = np.diff(self.first)

    def names(self) -> np.ndarray:
        """A hash of each whole set; independent of the order of shingles and of their levels."""
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(K.mix(self.value & K.U64((1 << 61) - 1) ^ K.U64(0xA5A5A5A5)))]
        return K.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(np.uint64)).view(np.int64)


def _arrow(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        sets = Sets(batch.column(2))
        yield _arrow([batch.column(0), batch.column(1), sets.size.astype(np.int64), sets.names()], ["doc_id", "_row", "n_shingles", "sid"])


def shingle_levels(docs: DataFrame, total: int) -> np.ndarray:
    """How common the shingles of each table entry are, in 8 levels, counted over all documents.  total: how many
    shingles there are.  The driver gets one byte an entry; the table's size is bounded."""
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / LOAD)), 18, MAX_TABLE_BITS))
    width = (1 << bits) // CHUNKS
    mean = max(total / (1 << bits), 4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint16)
        for batch in K.slices(batches):
            at, times = np.unique((Sets(batch.column(0)).value & K.U64((1 << bits) - 1)).astype(np.uint32), return_counts=True)
            table[at] = np.minimum(table[at] + times, 65535)  # what one task counts; beyond it the level is the highest anyway
        yield _rows([(k, table[k * width : (k + 1) * width]) for k in range(CHUNKS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(part, 2 * width, "zstd", asbytes=True), np.uint16)
                sums[k] = sums[k] + got if k in sums else got.astype(np.int64)
        yield _rows([(k, np.clip(np.floor(np.log2(np.maximum(t, 1) / mean)), 0, 7).astype(np.uint8)) for k, t in sums.items()])

    def _rows(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return _arrow([pa.array([k for k, _ in rows], pa.int32()), pa.array([pa.compress(t.tobytes(), "zstd", asbytes=True) for _, t in rows], pa.binary())], ["chunk", "counts"])

    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition(parts(docs), "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for r in rows:
        levels[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(pa.decompress(bytes(r["counts"]), width, "zstd", asbytes=True), np.uint8)
    return levels


BLOBS = "bucket int, a binary, b binary"


def _blob(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return _arrow([pa.array(list(c), t) for c, t in zip(columns, [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["bucket", "a", "b"])


def _index(buckets: int, levels) -> object:
    """Prefix entries by bucket of the shingle: (shingle, set) and (size, position), packed."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[list[np.ndarray]] = [[], [], [], []]
        entries = 0
        for batch in K.slices(batches):
            sets = Sets(batch.column(0), levels.value)
            names = sets.names()
            new = np.zeros(len(names), bool)
            for d, name in enumerate(names.tolist()):  # equal sets are indexed once
                if name not in seen:
                    seen.add(name)
                    new[d] = True
            prefix = sets.size - -(-NUMERATOR * sets.size // DENOMINATOR) + matches(sets.size)
            at = np.arange(len(sets.value)) - sets.first[sets.doc]
            take = (at < prefix[sets.doc]) & new[sets.doc]
            for column, values in zip(held, (sets.value[take], names[sets.doc[take]], sets.size[sets.doc[take]].astype(np.uint32), at[take].astype(np.uint32)), strict=True):
                column.append(values)
            entries += int(take.sum())
            if entries >= FLUSH:
                yield _index_blobs(held, buckets)
                held, entries = [[], [], [], []], 0
        if entries:
            yield _index_blobs(held, buckets)

    return out


def _index_blobs(held: list[list[np.ndarray]], buckets: int) -> pa.RecordBatch:
    value, name, size, at = (np.concatenate(c) for c in held)
    bucket = C.bucket_of(value << K.U64(3), buckets)
    order = np.lexsort((value, bucket))
    value, name, size, at, bucket = (c[order] for c in (value, name, size, at, bucket))
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        small = np.stack([size[part], at[part]]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
        rows.append((b, value[part].tobytes() + name[part].tobytes(), pa.compress(np.ascontiguousarray(small).tobytes(), "zstd", asbytes=True)))
    return _blob(rows)


def _entries(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """(list, set, size, position) of lists with two sets or more, in order of (list, size, set)."""
    keys, names, smalls = [], [], []
    for a, b in blobs:
        n = len(a) // 16
        keys.append(np.frombuffer(a, np.uint64, n))
        names.append(np.frombuffer(a, np.int64, n, 8 * n))
        raw = np.frombuffer(pa.decompress(b, 8 * n, "zstd", asbytes=True), np.uint8).reshape(2, 4, n).transpose(0, 2, 1)
        smalls.append(np.ascontiguousarray(raw).view(np.uint32).reshape(2, n))
    key, name, small = np.concatenate(keys), np.concatenate(names), np.concatenate(smalls, 1).astype(np.int64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    order = order[np.repeat(np.diff(np.r_[first, len(order)]) > 1, np.diff(np.r_[first, len(order)]))]
    order = order[np.lexsort((name[order], small[0][order], key[order]))]
    key, name, size, at = key[order], name[order], small[0][order], small[1][order]
    new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], name[new], size[new], at[new]


def _reach(size_a, at_a, size_b, at_b) -> np.ndarray:
    """Whether sets that meet at these positions, as one of their first meetings, can still link."""
    return np.minimum(size_a - at_a, size_b - at_b) > needed(size_a, size_b) - matches(np.minimum(size_a, size_b))


def _shifted(first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with j = i + 1, then i + 2, ... inside each list."""
    for step in range(1, int(length.max(initial=1))):
        rows = np.flatnonzero(length > step)
        times = length[rows] - step
        i = np.repeat(first[rows], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        yield i, i + step


def _counted(a: list[np.ndarray], b: list[np.ndarray], size: list[np.ndarray], kind: int, buckets: int) -> pa.RecordBatch:
    """Pairs (smaller name first) with the times they met and the times they must, packed by bucket of the pair."""
    x, y, n = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b, size))
    u, v = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], n[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.empty(0, np.int64)
    met, must = np.diff(np.r_[first, len(u)]).astype(np.uint32), matches(n[first]).astype(np.uint32)
    u, v = u[first], v[first]
    bucket = C.bucket_of(K.mix(u.view(np.uint64) ^ K.mix(v.view(np.uint64))), buckets)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = by[cuts[k] : cuts[k + 1]]
        rows.append((kind, k, np.stack([u[part], v[part]]).tobytes(), np.stack([met[part], must[part]]).tobytes()))
    return _kinds(rows)


def _kinds(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return _arrow([pa.array(list(c), t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["kind", "bucket", "a", "b"])


PAIR_ROWS = "kind int, bucket int, a binary, b binary"
WHOLE, LED, OPEN, LIST = range(4)


def _chosen(opened: bool):
    """(u, v) of a bucket's pairs that met often enough: by whole lists and leaders, or, if opened, the others, by whole
    lists and open pairs."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for kind, bucket, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append((kind, np.frombuffer(a, np.int64).reshape(2, -1), np.frombuffer(b, np.uint32).reshape(2, -1)))
        for blobs in held.values():
            u, v = np.concatenate([x for _, x, _ in blobs], 1)
            met, must = np.concatenate([x for _, _, x in blobs], 1).astype(np.int64)
            kind = np.concatenate([np.full(x.shape[1], k) for k, x, _ in blobs])
            order = np.lexsort((v, u))
            u, v, met, must, kind = (x[order] for x in (u, v, met, must, kind))
            first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
            times = [np.add.reduceat(np.where(kind == k, met, 0), first) for k in (WHOLE, LED, OPEN)]
            least = np.maximum.reduceat(must, first)
            good = times[WHOLE] + times[LED] >= least
            if opened:
                good = ~good & (times[OPEN] > 0) & (times[WHOLE] + times[OPEN] >= least)
            yield _arrow([u[first][good], v[first][good]], ["u", "v"])

    return out


def _first_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How often pairs meet: all pairs of short lists (WHOLE), and leaders with the others of long lists (LED).  The long
    lists come back (LIST) for what leaders leave open."""
    whole: tuple[list, list, list] = ([], [], [])
    led: tuple[list, list, list] = ([], [], [])
    longs = []
    for bucket, blobs in _collect(batches).items():
        key, name, size, at = _entries(blobs)
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[first, len(key)])
        short = length <= SHORT
        for i, j in _shifted(first[short], length[short]):
            good = _reach(size[i], at[i], size[j], at[j])
            for column, values in zip(whole, (name[i[good]], name[j[good]], size[i[good]]), strict=True):
                column.append(values)
        if short.all():
            continue
        more = np.repeat(~short, length)
        key, name, size, at = key[more], name[more], size[more], at[more]
        # blocks of sizes that can link, each with LEADERS leaders that are the same in all lists where they stand
        block = np.floor(np.log(size) / np.log(DENOMINATOR / NUMERATOR)).astype(np.int64)
        new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
        group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        seen: list[np.ndarray] = []
        for r in range(LEADERS):
            rank = K.mix(name.view(np.uint64) + K.U64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            own = np.lexsort((rank, group))[heads] if r else heads
            leader = own[group]
            good = (leader != np.arange(len(name))) & _reach(np.minimum(size[leader], size), np.where(size[leader] < size, at[leader], at), np.maximum(size[leader], size), np.where(size[leader] < size, at, at[leader]))
            for before in seen:  # a leader twice, or two leaders to each other, meet once
                good &= (own != before)[group] & (np.arange(len(name)) != before[group])
            seen.append(own)
            for column, values in zip(led, (name[leader[good]], name[good], np.minimum(size[leader[good]], size[good])), strict=True):
                column.append(values)
        longs.append((bucket, pa.compress(key.tobytes() + name.tobytes(), "zstd", asbytes=True), pa.compress(np.stack([size, at]).astype(np.uint32).tobytes(), "zstd", asbytes=True)))
    yield _counted(*whole, WHOLE, buckets)
    yield _counted(*led, LED, buckets)
    yield _kinds([(LIST, *x) for x in longs])


def _list(a: bytes, b: bytes) -> tuple[np.ndarray, ...]:
    """(list, set, size, position) of a packed long list."""
    sizes = pa.decompress(b, _plain(b), "zstd", asbytes=True)
    size, at = np.frombuffer(sizes, np.uint32).reshape(2, -1).astype(np.int64)
    n = len(size)
    raw = pa.decompress(a, 16 * n, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n), size, at


def _plain(blob: bytes) -> int:
    import zstandard

    return zstandard.frame_content_size(blob)


def _collect(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    got: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(bucket, []).append(tuple(blobs))
    return got


def _names_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, blobs in _collect(batches).items():
        names = np.unique(np.concatenate([_list(a, b)[1] for a, b in blobs]))
        yield _arrow([pa.array(np.full(len(names), bucket, np.int32)), names], ["bucket", "sid"])


def _open_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(u, v) of different components that meet in a long list and can still link.

    In each list, sets are in order of size.  Blocks of sets are skipped whole where the best of them cannot reach the
    overlap needed with the smallest set in question; sets of the same component or family are skipped.
    """
    for bucket, blobs in _collect(batches).items():
        lists = [(a, b) for a, b, c in blobs if c is None]
        marks = [np.frombuffer(c, np.int64).reshape(3, -1) for _, _, c in blobs if c is not None]
        of = np.concatenate(marks, 1) if marks else np.empty((3, 0), np.int64)
        of = of[:, np.argsort(of[0])]
        pairs: tuple[list, list, list] = ([], [], [])
        for a, b in lists:
            key, name, size, at = _list(a, b)
            n = len(key)
            comp, family = name.copy(), np.zeros(n, np.int64)
            if of.shape[1]:
                k = np.minimum(np.searchsorted(of[0], name), of.shape[1] - 1)
                comp, family = np.where(of[0][k] == name, of[1][k], name), np.where(of[0][k] == name, of[2][k], 0)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(first.tolist(), np.r_[first[1:], n].tolist(), strict=True):
                c = comp[lo:hi]
                if (c == c[0]).all():
                    continue
                s, p, names, f = size[lo:hi], at[lo:hi], name[lo:hi], family[lo:hi]
                # sets outside the largest component against all; pairs inside it are known to be connected
                values, counts = np.unique(c, return_counts=True)
                out = c != values[counts.argmax()]
                outside = np.flatnonzero(out)
                left = s - p
                for i in outside.tolist():
                    stop = int(np.searchsorted(s, s[i] * DENOMINATOR // NUMERATOR, side="right"))
                    start = int(np.searchsorted(s, -(-s[i] * NUMERATOR // DENOMINATOR)))
                    if left[i] <= needed(s[i], s[start]) - matches(s[i]):
                        continue
                    j = np.arange(start, stop)
                    # a pair of two sets outside is taken once
                    j = j[(c[j] != c[i]) & ((f[j] != f[i]) | (f[j] == 0)) & ~(out[j] & (j < i)) & _reach(s[i], p[i], s[j], p[j])]
                    for column, values in zip(pairs, (np.full(len(j), names[i]), names[j], np.minimum(s[i], s[j])), strict=True):
                        column.append(values)
                if sum(map(len, pairs[0])) > 1_000_000:
                    yield _counted(*pairs, OPEN, buckets)
                    pairs = ([], [], [])
        if pairs[0]:
            yield _counted(*pairs, OPEN, buckets)


def _write_sets(levels) -> object:
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            sets = Sets(batch.column(1), levels.value)
            raw = np.ascontiguousarray(sets.value.view(np.uint8).reshape(-1, 8)[:, :ITEM])
            blobs = [raw[a:b].tobytes() for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist(), strict=True)]
            yield _arrow([batch.column(0), pa.array(blobs, pa.binary())], ["sid", "items"])

    return out


def _items(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // ITEM, 8), np.uint8)
    out[:, :ITEM] = np.frombuffer(blob, np.uint8).reshape(-1, ITEM)
    return out.view(np.uint64)[:, 0]


def _blob_of(items: np.ndarray) -> bytes:
    return np.ascontiguousarray(items.view(np.uint8).reshape(-1, 8)[:, :ITEM]).tobytes()


def _answer_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (leader, part, kind): the leader's set, then its members' sets.  Gives the pairs that are near, how
    the member's set differs from the leader's, and whether they link."""
    leader = np.empty(0, np.uint64)
    name = None
    for batch in batches:
        us, vs, minus, plus, sizes, links_ = [], [], [], [], [], []
        for u, v, items in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("u", "v", "items")), strict=True):
            mine = _items(items)
            if v is None:
                leader, name = mine, u
                continue
            assert name == u
            common = np.isin(mine, leader, assume_unique=True)
            both = int(common.sum())
            linked = DENOMINATOR * both >= NUMERATOR * (len(mine) + len(leader) - both)
            if linked or NEAR * both >= max(len(mine), len(leader)):
                us.append(u)
                vs.append(v)
                links_.append(linked)
                plus.append(_blob_of(mine[~common]))
                minus.append(_blob_of(leader[~np.isin(leader, mine, assume_unique=True)]))
                sizes.append(len(mine))
        yield _arrow([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(minus, pa.binary()), pa.array(plus, pa.binary()), pa.array(sizes, pa.int64()), pa.array(links_, pa.bool_())], ["u", "v", "minus", "plus", "size", "linked"])


def _answer_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (x, i, j): sets y that are near x, with how they differ from it and their component, of parts i
    and j of x's family.  |y & z| = |x| - |x - y| - |x - z| + what the differences have in common, so pairs are answered
    through an index of differences and no pair is a row.  Gives links that connect components, each once."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for x, i, j, own, y, minus, plus, size, component in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("x", "i", "j", "part", "y", "minus", "plus", "size", "component")), strict=True):
            if key is not None and key != (x, i, j):
                yield _family_links(held, key)
                held = []
            key = (x, i, j)
            held.append((own, y, _items(minus), _items(plus), size, component))
    if held:
        yield _family_links(held, key)


def _family_links(rows: list[tuple], key: tuple) -> pa.RecordBatch:
    _, i, j = key
    part = np.array([r[0] for r in rows])
    names = np.array([r[1] for r in rows], np.int64)
    gone, size = np.array([len(r[2]) for r in rows]), np.array([r[4] for r in rows])
    base = size + gone - np.array([len(r[3]) for r in rows])  # the size of x
    _, label = np.unique(np.array([r[5] for r in rows], np.int64), return_inverse=True)
    differs = [np.concatenate([K.mix(r[2]), K.mix(r[3] ^ K.U64(0x5851F42D4C957F2D))]) for r in rows]
    right = np.flatnonzero(part == j)
    element = np.concatenate([differs[k] for k in right] or [np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(right)), [len(differs[k]) for k in right])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    us, vs = [], []
    for y in np.flatnonzero(part == i).tolist():
        lo, hi = np.searchsorted(element, differs[y], side="left"), np.searchsorted(element, differs[y], side="right")
        times = hi - lo
        at = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        common = base[y] - gone[y] - gone[right] + np.bincount(owner[at], minlength=len(right))
        good = right[(DENOMINATOR * common >= NUMERATOR * (size[y] + size[right] - common)) & (label[right] != label[y])]
        if len(good):
            others, first = np.unique(label[good], return_index=True)
            us += [int(names[y])] * len(first)
            vs += names[good[first]].tolist()
            label = np.where(np.isin(label, others), label[y], label)
    return _arrow([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _answer_derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (x, part, y, kind): the set x, then each set y with how sets z differ from x.  |y & z| is derived
    from |y & x|."""
    y = x = np.empty(0, np.uint64)
    both = 0
    for batch in batches:
        us, vs = [], []
        for u, kind, v, items, minus, plus in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("y", "kind", "z", "items", "minus", "plus")), strict=True):
            if kind == 0:
                x = _items(items)
            elif kind == 1:
                y = _items(items)
                both = int(np.isin(y, x, assume_unique=True).sum())
            else:
                less, more = _items(minus), _items(plus)
                common = both - int(np.isin(less, y, assume_unique=True).sum()) + int(np.isin(more, y, assume_unique=True).sum())
                size = len(x) - len(less) + len(more)
                if DENOMINATOR * common >= NUMERATOR * (len(y) + size - common):
                    us.append(u)
                    vs.append(v)
        yield _arrow([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _spread(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """df with a part number that splits hot keys, and (keys, part) of all parts."""
    many = df.groupBy(*keys).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("_n"))
    split = df.join(many, keys).withColumn("part", F.pmod(F.xxhash64(value), F.col("_n")).cast("int")).drop("_n")
    return split, many.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"))


def _sets(docs: DataFrame, meta: DataFrame, wanted: DataFrame, levels) -> DataFrame:
    """sid, items of the wanted sets, each from one document."""
    rows = keep(meta.groupBy("sid").agg(F.min("_row").alias("_row")).join(wanted, "sid", "left_semi"))  # copies are one row before they meet
    some = flagged(docs.select(F.xxhash64("doc_id", "text").alias("_row"), "text"), "_row", rows, "_row").where("_maybe").drop("_maybe")
    one = some.join(rows, "_row").dropDuplicates(["_row"]).select("sid", "text")
    return keep(one.mapInArrow(_write_sets(levels), "sid long, items binary"))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, _row, n_shingles, sid: equal sets have equal sid."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), "text")
    return rows.mapInArrow(_describe, f"doc_id {kind}, _row long, n_shingles long, sid long")


def links(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """(u, v): links between different sets (sid) that connect every component; copies are not repeated."""
    sc = docs.sparkSession.sparkContext
    buckets = buckets_for(docs.select("text"))
    n = max(parts(docs), buckets // 2)
    total = meta.agg(F.sum("n_shingles")).first()[0] or 0
    levels = sc.broadcast(shingle_levels(docs, total))

    sent = docs.select("text").mapInArrow(_index(buckets, levels), BLOBS)
    first = keep(regroup(sent, tasks=n).mapInArrow(lambda batches: _first_pairs(batches, buckets), PAIR_ROWS))
    pairs = keep(regroup(first.where(F.col("kind") < LIST), tasks=n).mapInArrow(_chosen(False), "u long, v long"))
    lists = first.where(F.col("kind") == LIST).select("bucket", "a", "b")

    # the sets that take part, from one document each
    involved = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid")))

    sets = _sets(docs, meta, involved, levels)

    # leaders answer first
    split, every = _spread(pairs, ["u"], "v")
    members = split.join(sets.withColumnRenamed("sid", "v"), "v").select("u", "part", "v", "items")
    heads = every.join(sets.withColumnRenamed("sid", "u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "items")
    rows = members.unionByName(heads).repartition(n, "u", "part").sortWithinPartitions("u", "part", F.col("v").isNotNull())
    answered = keep(rows.mapInArrow(_answer_leaders, "u long, v long, minus binary, plus binary, size long, linked boolean"))
    direct = answered.where("linked").select("u", "v")
    labels = keep(components(direct).withColumnRenamed("node", "sid"))

    # families of sets near one leader
    members = _families(answered, labels)
    inside = keep(_in_families(members, n))
    if inside.limit(1).count():
        direct = direct.unionByName(inside)
        labels = keep(components(direct).withColumnRenamed("node", "sid"))

    # pairs of different components that meet in long lists
    family = members.select(F.col("y").alias("sid"), F.col("x").alias("family"))
    own = labels.join(family, "sid", "full").select("sid", F.coalesce("component", "sid").alias("component"), F.coalesce("family", F.lit(0)).alias("family"))
    marks = lists.mapInArrow(_names_of_lists, "bucket int, sid long").distinct().join(own, "sid")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            every = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)])
            values = np.unique(bucket)
            yield _arrow([pa.array(values.astype(np.int32)), pa.array([every[:, bucket == b].tobytes() for b in values], pa.binary())], ["bucket", "c"])

    none = F.lit(None).cast("binary")
    marked = marks.select("bucket", "sid", "component", "family").mapInArrow(pack, "bucket int, c binary").select("bucket", none.alias("a"), none.alias("b"), "c")
    opened = regroup(lists.withColumn("c", none).unionByName(marked), tasks=n).mapInArrow(lambda batches: _open_pairs(batches, buckets), PAIR_ROWS)
    more = keep(regroup(opened.unionByName(first.where(F.col("kind") < OPEN)), tasks=n).mapInArrow(_chosen(True), "u long, v long"))
    # z is the side with the more likely leader: v if it has one
    led = answered.where("linked").groupBy("v").agg(F.min_by(F.struct("u", "minus", "plus"), F.struct(F.length("minus") + F.length("plus"), "u")).alias("by")).select(F.col("v").alias("z"), "by.*")
    asked = more.select(F.col("u").alias("y"), F.col("v").alias("z")).join(led.withColumnRenamed("u", "x"), "z", "left")
    empty = F.lit(b"")
    asked = asked.select("y", F.coalesce("x", "z").alias("x"), "z", F.coalesce("minus", empty).alias("minus"), F.coalesce("plus", empty).alias("plus"))
    for side in ("y", "z"):
        own = labels.select(F.col("sid").alias(side), F.col("component").alias(f"c{side}"))
        asked = asked.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    asked = keep(asked)
    later = asked.select(F.col("y").alias("sid")).unionByName(asked.select(F.col("x").alias("sid"))).distinct()
    sets = sets.unionByName(_sets(docs, meta, later.join(sets, "sid", "left_anti"), levels))
    found = [direct]
    for round_ in range(ROUNDS):
        # one pair of each two components first: where it links, their other pairs need no answer
        a, b = F.least("cy", "cz").alias("ca"), F.greatest("cy", "cz").alias("cb")
        if round_ < ROUNDS - 1:
            one = asked.groupBy(a, b).agg(F.min(F.struct(F.xxhash64("y", "z", F.lit(round_)).alias("h"), "y", "z")).alias("p")).select("p.y", "p.z")
            chosen = keep(asked.join(one, ["y", "z"], "left_semi"))
        else:
            chosen = asked
        got = keep(_derived(chosen, sets, n))
        found.append(got)
        if round_ == ROUNDS - 1:
            break
        merged = components(got.join(chosen, (got["u"] == chosen["y"]) & (got["v"] == chosen["z"])).select(F.col("cy").alias("u"), F.col("cz").alias("v")))
        asked = asked.join(chosen.select("y", "z"), ["y", "z"], "left_anti")
        for side in ("cy", "cz"):
            asked = asked.join(merged.select(F.col("node").alias(side), F.col("component").alias("_c")), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
        asked = keep(asked.where("cy <> cz"))
        if not asked.limit(1).count():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _families(answered: DataFrame, labels: DataFrame) -> DataFrame:
    """x, y, minus, plus, size, component: each set y with the one set x near it that most sets are near to, if these are
    FAMILY or more; how y differs from x, and y's size and component."""
    near = answered.select(F.col("u").alias("x"), F.col("v").alias("y"), "minus", "plus", "size")
    size = F.col("size") + (F.length("minus") - F.length("plus")) / ITEM
    near = near.unionByName(answered.select(F.col("v").alias("x"), F.col("u").alias("y"), F.col("plus").alias("minus"), F.col("minus").alias("plus"), size.cast("long").alias("size")))
    many = near.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= FAMILY)
    best = near.select("x", "y").join(many, "x").groupBy("y").agg(F.max(F.struct("n", "x"))["x"].alias("x"))
    own = near.join(best, ["x", "y"]).join(labels.select(F.col("sid").alias("y"), "component"), "y", "left")
    return keep(own.select("x", "y", "minus", "plus", "size", F.coalesce("component", "y").alias("component")))


def _in_families(members: DataFrame, tasks: int) -> DataFrame:
    """Links that connect the components of each family.  A family of more than SPLIT sets is dealt into parts, and each
    two parts meet in one task."""
    parts_ = members.groupBy("x").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("_n"))
    rows = members.join(parts_, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select("x", F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "part", "y", "minus", "plus", "size", "component")
    return rows.repartition(tasks, "x", "i", "j").sortWithinPartitions("x", "i", "j", "y").mapInArrow(_answer_family, "u long, v long")


def _derived(asked: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """Which of the pairs (y, z) link, where z differs by `minus` and `plus` from x.  A set x travels once to each of its
    parts, a set y once for each x."""
    split, every = _spread(asked.select("y", "x", "z", "minus", "plus"), ["x"], "y")
    columns = ["x", "part", "y", "kind", "z", "items", "minus", "plus"]
    gone, none = F.lit(None).cast("long"), F.lit(None).cast("binary")
    of_x = every.join(sets.withColumnRenamed("sid", "x"), "x").select("x", "part", gone.alias("y"), F.lit(0).alias("kind"), gone.alias("z"), "items", none.alias("minus"), none.alias("plus"))
    of_y = split.select("x", "part", "y").distinct().join(sets.withColumnRenamed("sid", "y"), "y").select("x", "part", "y", F.lit(1).alias("kind"), gone.alias("z"), "items", none.alias("minus"), none.alias("plus"))
    of_z = split.select("x", "part", "y", F.lit(2).alias("kind"), "z", none.alias("items"), "minus", "plus")
    rows = of_x.unionByName(of_y).unionByName(of_z).select(*columns).repartition(tasks, "x", "part").sortWithinPartitions("x", "part", F.asc_nulls_first("y"), "kind")
    return rows.mapInArrow(_answer_derived, "u long, v long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """What `describe` says; sid, n, least, component for each set that is not empty; how many documents there are.

    Copies share a set and near copies a component, however many they are, so nothing is joined by either of them
    without dealing hot ones over several tasks.
    """
    meta = keep(describe(docs))
    labels = components(links(docs, meta)).select(F.col("node").alias("sid"), "component")
    per_set = meta.where("n_shingles > 0").groupBy("sid").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    sets = keep(per_set.join(labels, "sid", "left").select("sid", "n", "least", F.coalesce("component", "sid").alias("component")))
    return meta, sets, meta.count()


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each document.

    Defined results: null and wordless texts have no set, link with nothing and are their own component; fewer than
    five words are one shingle; equal rows are in one component; null ids are larger than others, so a component of null
    ids alone is null; documents that share an id are told apart by their text; a tie at the threshold is a link; very
    long texts are whole sets; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    meta, sets, total = _grouped(docs)
    groups = sets.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    named = spread_join(sets.select("sid", "component"), groups.drop("n"), "component", groups.select("component", "n"), ["sid"], total)
    some = spread_join(meta.where("n_shingles > 0"), named.select("sid", "component_id"), "sid", sets.select("sid", "n"), ["_row"], total)
    return some.select("doc_id", "n_shingles", "component_id").unionByName(meta.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (nulls last, then by text hash), with all
    columns; of rows with equal doc_id and text one stays.  Documents that share an id, or have none, are told apart by
    their text.  Only documents that may go are moved."""
    given, docs = docs.columns, shielded(docs)
    none = F.col("doc_id").isNull()
    key = F.xxhash64(F.xxhash64("doc_id", "text"), none).alias("_key")
    meta, sets, total = _grouped(docs)
    named = spread_join(meta, sets.select("sid", "component"), "sid", sets.select("sid", "n"), ["_row"], total)
    named = named.select(F.xxhash64("_row", none).alias("_key"), "doc_id", "n_shingles", "component")
    rows = keep(named.groupBy("_key").agg(F.count("*").alias("_n"), F.first("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("component").alias("component")))
    full = rows.where("n_shingles > 0")
    best = full.groupBy("component").agg(F.min(F.struct(none.alias("none"), "doc_id", "_key"))["_key"].alias("_best"), F.count("*").alias("n"))
    linked = spread_join(full, best.drop("n"), "component", best.select("component", "n"), ["_key"], total).select("_key", "_n", (F.col("_key") == F.col("_best")).alias("_stays"))
    ids = linked.unionByName(rows.where("n_shingles = 0").select("_key", "_n", F.lit(True).alias("_stays")))
    special = keep(ids.where("not _stays or _n > 1").select("_key", "_stays"))
    both = flagged(docs.select("*", key), "_key", special, "_key")
    rest = both.where("_maybe").join(special, "_key", "left").where("coalesce(_stays, true)").dropDuplicates(["_key"])
    return both.where("not _maybe").select(*docs.columns).unionByName(rest.select(*docs.columns)).toDF(*given)
