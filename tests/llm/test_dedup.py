"""Jaccard join, substring dedup and decontamination against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from cairnframe.llm import _components, decontaminate, jaccard, substring

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(70)]
    rows = []
    for k in range(n):
        kind = rnd.random()
        if rows and kind < 0.25:
            w = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randint(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(words)
        else:
            w = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 4, 5, 40, 120, 200]))]
            if kind < 0.45:
                at = rnd.randint(0, len(w))
                w[at:at] = passage
        rows.append((k, rnd.choice([" ", "\n", " \t "]).join(w).title() if kind > 0.8 else " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "loop " * 90), (n + 4, "Loop loop " * 44), (n + 5, rows[7][1]), (n + 6, "x" * 20000), (n + 7, "é ü " * 30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", -1) for k, t in rows], "doc_id long, text string, bucket string, sid long")


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


@pytest.mark.parametrize(("short", "local"), [(1, 0), (8, 10**6)])
def test_jaccard(spark, monkeypatch, short, local):
    """With short = 1 every shared list goes by leaders and derived answers; with local = 0 links are contracted by joins."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(_components, "LOCAL_LINKS", local)
    rows = corpus(1)
    got = sorted(map(tuple, jaccard.cluster(frame(spark, rows)).collect()))
    assert got == brute_components(rows)


def test_jaccard_near_group(spark, monkeypatch):
    """A group of near copies, some of which link only through others."""
    monkeypatch.setattr(jaccard, "SHORT", 2)
    rnd = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(25):
        w = list(base)
        for _ in range(rnd.randint(0, 8)):
            w[rnd.randrange(120)] = f"n{rnd.randrange(9999)}"
        rows.append((k, " ".join(w)))
        base = w if k % 6 == 5 else base
    assert sorted(map(tuple, jaccard.cluster(frame(spark, rows)).collect())) == brute_components(rows)


def test_jaccard_empty_and_keep_one(spark):
    df = frame(spark, corpus(2, 10))
    assert jaccard.cluster(df.limit(0)).count() == 0
    rows = corpus(2, 10)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _, c in brute_components(rows) if k == c)


def brute_removed(rows, window=35):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("hot", [10_000, 2])
def test_substring(spark, monkeypatch, hot):
    """With hot = 2 the windows of nearly all repeated minimisers travel one by one."""
    monkeypatch.setattr(substring, "HOT", hot)
    rows = corpus(4) + [(3, corpus(4)[3][1])]
    got = sorted(map(tuple, substring.digest(frame(spark, rows)).collect()))
    assert got == [r[:4] for r in brute_removed(rows)]


def test_substring_remove(spark):
    rows = corpus(5, 30)
    df = frame(spark, rows)
    got = substring.remove(df)
    assert got.columns == df.columns
    assert substring.digest(df.limit(0)).count() == 0
    texts = dict(rows)
    want = {k: (kept if gone else texts[k]) for k, n, gone, _, kept in brute_removed(rows) if not (gone and gone == n)}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def brute_hits(docs, items, window=13):
    norm = [(None if k is None else str(k), decontaminate.normal(t)) for k, t in items]
    out = []
    for k, t in docs:
        w = decontaminate.normal(t)
        hit, ids = [False] * len(w), set()
        for name, item in norm:
            size = min(window, len(item))
            for s in range(len(item) - size + 1) if size else ():
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == item[s : s + size]:
                        hit[i : i + size] = [True] * size
                        ids |= {name} - {None}
        n = sum(hit)
        out.append((k, len(w), n, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_decontamination(spark, monkeypatch, most):
    """One group of items, and many of which two are held at once, give the same rows."""
    monkeypatch.setattr(decontaminate, "HELD", 2)
    rnd = random.Random(6)
    words = [f"q{k}" for k in range(25)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 13, 20, 40])))) for k in range(20)] + [(20, None), (21, "?!"), (22, "Q1, q2; q3"), (23, "q1 q2 q3"), (5, "q7 q8 q9"), (5, "q7 q8 q9 q1"), (None, "q11 q12 q11")]
    docs = []
    for k in range(40):
        w = [rnd.choice(words + ["zz", "yy"]) for _ in range(rnd.choice([0, 5, 60]))]
        if rnd.random() < 0.5:
            w += ["zz"] + (rnd.choice(items)[1] or "").split() + ["zz"]
        docs.append((k, " -".join(w).upper()))
    docs += [(40, None), (41, ""), (42, " ".join(rnd.choice(words) for _ in range(700)) + " " + items[3][1]), (43, "q11 q12 q11"), (None, items[7][1]), (None, "zz"), (44, docs[3][1]), (44, docs[3][1])]
    docs += [(45, " ".join(max((t or "" for _, t in items), key=len).split() * 30))]
    df = frame(spark, docs).withColumnRenamed("sid", "n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(df, bench, max_item_words=most).drop("spans", "items")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items)
    clean = decontaminate.clean(df, bench, max_item_words=most)
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((r[0] for r in brute_hits(docs, items) if not r[5]), key=repr)
    assert decontaminate.hits(df.limit(0), bench).count() == 0
    assert decontaminate.hits(df, bench.limit(0)).where("contaminated").count() == 0
    left = decontaminate.remove_spans(df, bench, max_length=12)
    again = {r["doc_id"]: r["n_hit"] for r in decontaminate.hits(left, spark.createDataFrame([x for x in items if x[1] and len(x[1].split()) >= 13], "item_id long, text string")).collect()}
    assert all(n == 0 for k, n in again.items() if any(r[0] == k and r[5] for r in brute_hits(docs, items)))


def test_keep_one_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    clean = [" ".join(f"c{k}x{rnd.randrange(999)}" for _ in range(30)) for k in range(8)]
    near = clean[0] + " more"
    rows = [(None, clean[1]), (None, clean[2]), (None, clean[2]), (5, clean[3]), (5, clean[4]), (1, clean[0]), (7, near), (7, clean[5]), (None, clean[5] + " more"), (None, ""), (None, None), (8, None)]
    left = jaccard.keep_one(frame(spark, rows)).collect()
    want = [(None, clean[1]), (None, clean[2]), (5, clean[3]), (5, clean[4]), (1, clean[0]), (7, clean[5]), (None, ""), (None, None), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=repr) == sorted(want, key=repr)


def test_decontamination_groups_keep_rows_apart(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(4)]
    texts = [items[0][1], items[3][1] + " zz", items[1][1] + " yy " + items[2][1], "nothing of it here", "nothing of it here", "something else"]
    for key in (5, None):
        docs = [(key, t) for t in texts]
        df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.hits(df, bench, max_item_words=20).drop("spans", "items")
        assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items)
        assert sorted(r["text"] for r in decontaminate.clean(df, bench).collect()) == sorted(texts[3:])


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(_components, "LOCAL_LINKS", local)
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in _components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in links if u != v for x in (u, v)}


@pytest.mark.parametrize(("family", "split"), [(10**6, 2000), (3, 2000), (3, 10)])
def test_near_group_in_rounds(spark, monkeypatch, family, split):
    """Pairs between components are answered in rounds, or in families of one part or several; no link is lost."""
    monkeypatch.setattr(jaccard, "SHORT", 1)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "FAMILY", family)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    rnd = random.Random(11)
    base = [f"v{k}" for k in range(90)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(90)] = f"n{rnd.randrange(9999)}"
        rows.append((k, " ".join(w)))
        if k % 10 == 9:
            base = [x if rnd.random() < 0.97 else f"b{rnd.randrange(9999)}" for x in base]
    assert sorted(map(tuple, jaccard.cluster(frame(spark, rows)).collect())) == brute_components(rows)


def test_jaccard_odd_rows(spark):
    """Null and repeated ids, ties at the threshold, a long text."""
    tie = "a b c d e f g h"  # four shingles; with one more word five, of which four are shared: 80 %
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, tie), (5, tie + " i"), (5, "other words that stand alone here"), (7, tie + " i j k"), (8, long), (9, long + " end"), (None, None), (3, "few"), (2, "few")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.cluster(frame(spark, rows)).collect()), key=repr)
    want = [(None, 4, 5), (5, 5, 5), (5, 2, 5), (7, 7, 7), (8, 29_996, 8), (9, 29_997, 8), (None, 0, None), (3, 1, 2), (2, 1, 2)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("split", [2000, 7])
def test_family_answers_every_pair(split):
    """Links of a family by differences connect what links of all pairs connect."""
    import numpy as np

    rnd = random.Random(3)
    base = set(range(1, 101))
    sets = []
    for k in range(60):
        edits = rnd.choice([0, 2, 5, 12, 20])
        own = base - set(rnd.sample(range(1, 101), edits)) | {1000 + rnd.randrange(60) for _ in range(edits)}
        sets.append(own if k % 3 else own - set(range(1, 30)) | set(range(5000, 5025)))
    rows = [(k, np.array(sorted(base - x), np.uint64), np.array(sorted(x - base), np.uint64), len(x)) for k, x in enumerate(sets)]
    parts = -(-len(rows) // split)
    links = []
    for i in range(parts):
        for j in range(i, parts):
            held = [(k % parts, k, minus, plus, size, k) for k, minus, plus, size in rows if k % parts in (i, j)]
            got = jaccard._family_links(held, (0, i, j))
            links += zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)
    every = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert all((max(a, b), min(a, b)) in every for a, b in links) and len(links) < len(every)

    def groups(pairs):
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(k) for k in range(60)]

    assert groups(links) == groups(every)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cairnframe.llm import _kernel as K

    rnd = random.Random(6)
    texts = [" ".join("x" * rnd.randint(1, 300) + str(rnd.randrange(50)) for _ in range(rnd.randint(0, 60))) for _ in range(20)] + ["y" * 3000, ""]
    data, offsets = K.buffers(pa.array(texts))
    w = K.find_words(data, offsets, K.SPACE_WORDS)
    whole = K.hash_words(w, True)
    monkeypatch.setattr(K, "HASH_BYTES", 512)
    assert np.array_equal(whole, K.hash_words(w, True))
    assert len({x for t in texts for x in t.split()}) == len(set(whole.tolist()))
