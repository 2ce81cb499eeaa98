"""Networks against plain computations in memory."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.operators import blocks, funding, network, similar, tags


def graph(seed, n=14, m=40):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "u string, v string")


def weighted(spark, edges, seed=1):
    rnd = random.Random(seed)
    rows = {(min(e), max(e)): round(rnd.uniform(0.1, 1), 3) for e in edges if e[0] != e[1]}
    return spark.createDataFrame([(*e, w) for e, w in rows.items()], "u string, v string, sim double"), rows


def sparse_sets(seed, n=60):
    rnd = random.Random(seed)
    return [(f"s{k}", f"i{min(int(rnd.expovariate(0.12)), 40)}", float(rnd.randint(1, 5))) for k in range(n) for _ in range(rnd.randint(1, 12))]


def test_prefixes_lose_no_pair(spark):
    rows = spark.createDataFrame(sorted(set((a, b) for a, b, _ in sparse_sets(1))), "k string, i string")
    for least in (0.2, 0.34, 0.5, 0.8):
        whole = {(r["u"], r["v"]): r["jaccard"] for r in similar.set_jaccard(rows, "k", "i").collect() if r["jaccard"] > least}
        assert {(r["u"], r["v"]): r["jaccard"] for r in similar.set_jaccard(rows, "k", "i", least).collect()} == whole
    own = {(a, b): w for a, b, w in sparse_sets(2)}
    f = spark.createDataFrame([(a, b, w) for (a, b), w in own.items()], "k string, t string, w double")
    for least in (0.3, 0.6, 0.9):
        whole = {(r["u"], r["v"]): r["sim"] for r in network.cosine_edges(f, "k", "t", "w").collect() if r["sim"] >= least + 1e-9}
        got = {(r["u"], r["v"]): r["sim"] for r in network.cosine_edges(f, "k", "t", "w", least).collect() if r["sim"] >= least + 1e-9}
        assert got == pytest.approx(whole) and whole


def test_set_rows_are_dealt_once_and_not_written(spark, monkeypatch):
    sets = {(a, b) for a, b, _ in sparse_sets(3)}
    rows = [*sets, *sorted(sets)[::3], *((a, None) for a, _ in sorted(sets)[::40]), (None, "i1"), (None, None)]
    kept = []
    monkeypatch.setattr(blocks, "keep", lambda df, f=blocks.keep: kept.append(n := f(df)) or n)
    got = {(r["u"], r["v"]): (r["common"], r["jaccard"]) for r in similar.set_jaccard(spark.createDataFrame(rows, "k string, i string"), "k", "i", 0.2).collect()}
    assert [x.columns for x in kept] == [["_block", "size", "packed"]]
    own = {}
    for a, b in rows:
        own.setdefault(a, set()).add(b)
    want = {}
    for u, v in itertools.combinations(sorted(x for x in own if x), 2):
        c = len((own[u] & own[v]) - {None})
        if c / (len(own[u]) + len(own[v]) - c) > 0.2:
            want[u, v] = (c, pytest.approx(c / (len(own[u]) + len(own[v]) - c)))
    assert got == want and want


def test_pairs_to_merge_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    pairs = frame(spark, [("b", "a"), ("c", "b"), ("x", "y")]).mapInPandas(count, "u string, v string")
    got = similar.merge_identical(frame(spark, [("c", "p"), ("a", "p"), ("y", "c"), ("b", "c"), ("p", "q")]), pairs)
    assert {tuple(r) for r in got.collect()} == {("a", "p"), ("x", "a"), ("p", "q")} and seen.value == 3


def test_isolated_pairs_get_a_further_link(spark):
    sims = {("a", "b"): 0.9, ("a", "c"): 0.3, ("b", "c"): 0.35, ("c", "d"): 0.8, ("c", "e"): 0.7, ("d", "e"): 0.75, ("a", "d"): 0.2}
    edges = spark.createDataFrame([(*e, s) for e, s in sims.items()], "u string, v string, sim double")
    plain = {(r["u"], r["v"]) for r in network.threshold_edges(edges, 1.0, connect_pairs=False).collect()}
    got = {(r["u"], r["v"]) for r in network.threshold_edges(edges, 1.0).collect()}
    assert {e for e in plain if e[0] in "ab"} == {("a", "b"), ("b", "a")}
    assert got - plain >= {("a", "c"), ("b", "c")}
    assert len(network.threshold_edges(edges, 0).collect()) == 2 * len(sims)


def test_keystone_by_sets(spark):
    edges = graph(3)
    after = {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)
    nodes = sorted({x for e in edges for x in e})
    before = {n: {u for u, v in edges if v == n} for n in nodes}
    oo = {n: len(set().union(*[after.get(m, set()) for m in after.get(n, ())], set())) for n in nodes}
    ii = {n: len(set().union(*[before[m] for m in before[n]], set())) for n in nodes}
    reach = {n: 100 * oo[n] / len(nodes) for n in nodes}
    lever = {n: (oo[n] - ii[n]) / (oo[n] + ii[n]) if oo[n] + ii[n] else None for n in nodes}
    scale = lambda x, d: (x - min(v for v in d.values() if v is not None)) / (max(v for v in d.values() if v is not None) - min(v for v in d.values() if v is not None))
    for r in network.reach(frame(spark, edges)).collect():
        n = r["node"]
        assert (r["outout"], r["inin"], r["reach"]) == (oo[n], ii[n], pytest.approx(reach[n]))
        assert r["keystone"] == (pytest.approx(scale(reach[n], reach) * scale(lever[n], lever)) if lever[n] is not None else None)


def test_cluster_measures_by_hand(spark):
    edges = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("c", "d"), ("d", "a")]
    clusters = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "node string, cluster string")
    got = {r["node"]: r for r in network.cluster_diversity(frame(spark, edges), clusters, normalise=False).collect()}
    # a has degree 5 (3 out, 2 in); of its successors one is in its cluster and two are in others
    p = 1 / 5
    assert got["a"]["inter"] == pytest.approx(2 / 5)
    assert got["a"]["diversity"] == pytest.approx(-3 * p * math.log(p))
    assert got["a"]["bridging"] == pytest.approx(got["a"]["diversity"] * 2 / 2)
    assert got["a"]["centrality"] == pytest.approx(3 / 5 * 5 / (1 + got["a"]["diversity"]))
    assert got["b"]["bridging"] == 0
    z = {r["node"]: r for r in network.cluster_diversity(frame(spark, edges), clusters).collect()}
    assert z["a"]["diversity"] == pytest.approx(1) and z["b"]["diversity"] == pytest.approx(-1)  # two nodes of one cluster
    assert z["c"]["centrality"] == pytest.approx(got["c"]["centrality"])  # alone in its cluster: raw


def test_projections_by_matrices(spark):
    rnd = random.Random(5)
    t = np.array([[rnd.choice([0, 0, 1, 2, 5]) for _ in range(7)] for _ in range(6)], float)
    t[:, 0] += 1
    rows = spark.createDataFrame([(i, j, float(t[i, j])) for i in range(6) for j in range(7) if t[i, j]], "a int, b int, w double")
    s, sb = t.sum(1, keepdims=True), t.sum(0, keepdims=True)
    walk = (t / s) @ (t / sb).T
    share = (t > 0).astype(float)
    both = share @ share.T
    k = share.sum(1)
    r = np.corrcoef(t)
    hybrid = (np.sqrt(t / s) @ (t / sb).T) * (np.sqrt(t / s) @ (t / sb).T).T
    pi = (s / s.sum()).ravel()
    assert np.allclose(pi @ walk, pi)  # stationary
    ycn = walk * pi[None, :]
    want = {
        "simple": t @ t.T, "hyperbolic": (t / sb) @ (t / sb).T, "jaccard": both / (k[:, None] + k[None] - both), "cosine": (t @ t.T) / np.sqrt((t**2).sum(1)[:, None] * (t**2).sum(1)[None]),
        "euclidean": np.array([[1 / d if (d := np.linalg.norm(x - y)) > 0 else 1 for y in t] for x in t]), "pearson": np.where((1 + r) / 2 >= 0.5, (1 + r) / 2, 0),
        "probs": (walk + walk.T) / 2, "heats": (walk + walk.T) / 2, "hybrid": (hybrid + hybrid.T) / 2, "ycn": (ycn + ycn.T) / 2,
    }
    assert set(want) == set(network.KINDS)
    for kind, m in want.items():
        got = {(x["u"], x["v"]): x["weight"] for x in network.project(rows, kind).collect()}
        assert got == pytest.approx({(i, j): m[i, j] for i in range(6) for j in range(i + 1, 6) if m[i, j] > 0}), kind
    got = {(x["u"], x["v"]): x["weight"] for x in network.project(rows, "probs", True).collect()}
    assert got == pytest.approx({(i, j): walk[i, j] for i in range(6) for j in range(6) if i != j})


def plain_modularity(rows, label, resolution=1.0):
    m = sum(rows.values())
    deg = {}
    for (u, v), w in rows.items():
        deg[u], deg[v] = deg.get(u, 0) + w, deg.get(v, 0) + w
    inside = sum(w for (u, v), w in rows.items() if label[u] == label[v]) / m
    return inside - resolution * sum(sum(d for n, d in deg.items() if label[n] == c) ** 2 for c in set(label.values())) / (4 * m * m)


def ring_of_cliques(n=6, size=6):
    edges = []
    for c in range(n):
        names = [f"c{c}m{k}" for k in range(size)]
        edges += itertools.combinations(names, 2)
        edges.append((names[0], f"c{(c + 1) % n}m1"))
    return edges


def test_clusters_of_cliques(spark):
    edges = ring_of_cliques() + [("x", "y"), ("y", "z")]
    df = spark.createDataFrame([(min(e), max(e), 1.0) for e in edges], "u string, v string, sim double")
    rows = {(min(e), max(e)): 1.0 for e in edges}
    for found in (network.louvain_clusters(df), network.add_clustering(df, "leiden"), network.louvain_clusters(df, local_edges=60)):
        label = {r["node"]: r["cluster"] for r in found.collect()}
        assert len(label) == 39
        for c in range(6):
            assert len({label[f"c{c}m{k}"] for k in range(6)}) == 1
        assert len(set(label.values())) == 7
        assert network.modularity(df, found).first()["modularity"] == pytest.approx(plain_modularity(rows, label))
    split = network.hierarchical_clusters(df, [0.2, 4.0], 6).collect()
    assert len({r["level0"] for r in split}) < len({r["cluster"] for r in split}) and all(r["cluster"].startswith(r["level0"]) for r in split)
    assert {r["cluster"] for r in split if r["node"] in "xyz"} == {r["level0"] + "_0" for r in split if r["node"] in "xyz"}


def test_refined_clusters_are_connected(spark):
    for seed in range(4):
        df, rows = weighted(spark, graph(seed, 40, 90), seed)
        nodes = sorted({x for e in rows for x in e})
        levels = network.communities(nodes, [e[0] for e in rows], [e[1] for e in rows], list(rows.values()), refine=True)
        label = levels[-1]
        for c in set(label.values()):
            own = {n for n in nodes if label[n] == c}
            seen, todo = set(), [min(own)]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [b if a == x else a for a, b in rows if x in (a, b) and a in own and b in own]
            assert seen == own
        assert plain_modularity(rows, label) > 0.3


def test_stability_by_hand(spark):
    rnd = random.Random(2)
    base = {k: f"A{k % 3}" for k in range(30)}
    runs = [(0, k, c) for k, c in base.items()]
    for r in range(1, 5):
        runs += [(r, k, f"B{(k % 3 + r) % 3}" if rnd.random() < 0.8 else f"B{rnd.randrange(3)}") for k in base if rnd.random() < 0.95]
    nodes, clusters = network.cluster_stability(spark.createDataFrame(runs, "run int, node int, cluster string"))
    counts = {k: {c: 1} for k, c in base.items()}
    sims = {}
    for r in range(1, 5):
        own = {}
        for _, k, c in (x for x in runs if x[0] == r):
            own.setdefault(c, set()).add(k)
        for c0 in sorted(set(base.values())):
            members = {k for k, c in base.items() if c == c0}
            best = min(own, key=lambda c: (-len(own[c] & members) / len(own[c] | members), c))
            sims.setdefault(c0, []).append(len(own[best] & members) / len(own[best] | members))
            for k in own[best]:
                counts[k][c0] = counts[k].get(c0, 0) + 1
    for r in nodes.collect():
        p = sorted(((n / sum(counts[r["node"]].values()), c) for c, n in counts[r["node"]].items()), key=lambda x: (-x[0], x[1]))
        assert (r["best"], r["best_prob"], r["reclustered"]) == (p[0][1], pytest.approx(p[0][0]), p[0][1] != base[r["node"]])
        assert r["alternate"] == (p[1][1] if len(p) > 1 else None)
        assert r["entropy"] == pytest.approx(-sum(x * math.log(x) for x, _ in p))
    assert {r["cluster"]: r["mean_similarity"] for r in clusters.collect()} == pytest.approx({c: sum(x) / 4 for c, x in sims.items()})


def test_betweenness_by_paths(spark):
    edges = graph(7, 9, 22)
    nodes = sorted({x for e in edges for x in e})
    after = {n: [v for u, v in edges if u == n] for n in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, found = [[s]], []
        while paths and not found:
            found = [p for p in paths if p[-1] == t]
            paths = [[*p, v] for p in paths for v in after[p[-1]] if v not in p]
        for p in found:
            for x in p[1:-1]:
                total[x] += 1 / len(found)
    n = len(nodes)
    got = {r["node"]: r["betweenness"] for r in network.betweenness(frame(spark, edges)).collect()}
    assert got == pytest.approx({k: x / ((n - 1) * (n - 2)) for k, x in total.items()})


def test_betweenness_of_many_sources_together(spark, monkeypatch):
    rnd = random.Random(5)
    path = [(f"p{k:02}", f"p{k + 1:02}") for k in range(30)]
    star = [("hub", f"x{k}") for k in range(60)] + [(f"x{k}", "hub") for k in range(0, 60, 2)]
    edges = graph(9, 25, 60) + path + star + [("loop", "loop"), ("n01", "n02"), ("n01", "n02")] + [(f"x{rnd.randrange(60)}", f"x{rnd.randrange(60)}") for _ in range(40)]
    nodes = sorted({x for e in edges for x in e})
    for directed in (True, False):
        links = {*edges} | (set() if directed else {(v, u) for u, v in edges})
        after = {n: [v for u, v in links if u == n] for n in nodes}
        total = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            far, ways, order = {s: 0}, {s: 1}, [s]
            for x in order:
                for y in after[x]:
                    if y not in far:
                        far[y], ways[y] = far[x] + 1, 0
                        order.append(y)
                    ways[y] += ways[x] * (far[y] == far[x] + 1)
            share = dict.fromkeys(order, 0.0)
            for x in order[:0:-1]:
                share[x] = sum(ways[x] / ways[y] * (1 + share[y]) for y in after[x] if far[y] == far[x] + 1)
                total[x] += share[x]
        n = len(nodes)
        for sources, held in ((network.SOURCES, network.HELD), (7, 100)):
            monkeypatch.setattr(network, "SOURCES", sources)
            monkeypatch.setattr(network._dependencies, "__defaults__", (held,))
            rows = network.betweenness(frame(spark, edges), directed).collect()
            assert {r["node"]: r["betweenness"] for r in rows} == pytest.approx({k: x / ((n - 1) * (n - 2)) for k, x in total.items()})
            assert len(rows) == n


def test_betweenness_by_every_kind_of_step(monkeypatch):
    rng = np.random.default_rng(4)
    shops = np.r_[np.c_[rng.integers(20, 320, 1500), rng.integers(0, 20, 1500)], np.c_[rng.integers(0, 20, 400), rng.integers(20, 320, 400)]]
    path = np.r_[np.c_[np.arange(59), np.arange(1, 60)], rng.integers(0, 60, (20, 2))]
    for edges in (shops, path, np.c_[np.minimum(rng.zipf(1.5, 300), 80) - 1, rng.integers(0, 80, 300)]):
        edges = np.unique(edges, axis=0)
        edges = edges[np.argsort(edges[:, 1], kind="stable")]
        n = int(edges.max()) + 1
        after = [edges[edges[:, 0] == x, 1].tolist() for x in range(n)]
        total = np.zeros(n)
        for s in range(n):
            far, ways, order = {s: 0}, {s: 1}, [s]
            for x in order:
                for y in after[x]:
                    if y not in far:
                        far[y], ways[y] = far[x] + 1, 0
                        order.append(y)
                    ways[y] += ways[x] * (far[y] == far[x] + 1)
            share = dict.fromkeys(order, 0.0)
            for x in order[:0:-1]:
                share[x] = sum(ways[x] / ways[y] * (1 + share[y]) for y in after[x] if far[y] == far[x] + 1)
                total[x] += share[x]
        links = network._Links(n, edges[:, 0], edges[:, 1])
        for dear, pairs, long in ((1, 1 << 22, 64), (16, 1 << 22, 8), (16, 200, 64), (10**9, 0, 8)):
            monkeypatch.setattr(network, "DEAR", dear)
            monkeypatch.setattr(network, "PAIRS", pairs)
            monkeypatch.setattr(network, "LONG", long)
            got = sum(network._dependencies(links, np.arange(s, min(s + 64, n))) for s in range(0, n, 64))
            assert got == pytest.approx(total)


def test_betweenness_of_a_dense_graph_takes_seconds(spark):
    rnd = np.random.default_rng(3)
    edges = np.unique(rnd.integers(0, 3000, (150_000, 2)), axis=0)
    began = time.time()
    rows = network.betweenness(spark.createDataFrame(edges.tolist(), "u int, v int")).collect()
    assert len(rows) == 3000 and all(r["betweenness"] > 0 for r in rows)
    assert time.time() - began < 45  # plain loops over 3000 * 150000 edges take minutes


def test_embedding_network_thresholds_all_pairs(spark, tmp_path, monkeypatch):
    import pandas as pd

    from cairnframe.operators import taxonomy
    from cairnframe.plans import graphs

    rnd = np.random.default_rng(8)
    centers = rnd.normal(size=(3, 8))
    vectors = np.concatenate([centers[[0] * 40 + [1] * 12 + [2] * 8] + 0.3 * rnd.normal(size=(60, 8)), np.repeat(centers[:1], 15, 0), [np.zeros(8)], -centers[:1]])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<float>")
    own = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    sims = [(a, b, float(sum(x * y for x, y in zip(own[int(a)], own[int(b)], strict=True)))) for a, b in itertools.combinations(map(str, range(len(own))), 2)]
    every = spark.createDataFrame(pd.DataFrame(sims, columns=["u", "v", "sim"])).coalesce(1).cache()
    rows = lambda edges: sorted((r["u"], r["v"], round(r["sim"], 8)) for r in edges.collect())
    for size, links in ((20_000, 1.0), (40, 6.0)):
        monkeypatch.setattr(taxonomy, "MAX_CATEGORIES", size)
        assert rows(network.embed_threshold_edges(df, "vec_id", "embedding", links)) == rows(network.threshold_edges(every, links))
    kept = network.threshold_edges(every, 6.0).cache()
    assert kept.groupBy("u").count().agg(F.max("count")).first()[0] > 6  # more than six partners of one node
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = network.louvain_clusters(network.undirected(kept))
    assert sorted(graphs.embedding_network(spark, str(tmp_path)).collect()) == sorted(want.collect())


def test_trophic_levels_by_solving(spark):
    edges = graph(8, 8, 16)
    nodes = sorted({x for e in edges for x in e})
    at = {n: k for k, n in enumerate(nodes)}
    b = np.zeros((len(nodes), len(nodes)))
    for u, v in edges:
        b[at[v], at[u]] = 1
    b /= b.sum(1, keepdims=True) + 1  # the root is one more
    level = np.linalg.solve(np.eye(len(nodes)) - b, np.ones(len(nodes)))
    want = {n: (1 + level[k] - level.min(), (level[k] - level.min()) / (level.max() - level.min())) for n, k in at.items()}
    for local in (10**6, 1):
        got = {r["node"]: (r["level"], r["scaled"]) for r in network.trophic_levels(frame(spark, edges), 60 if local == 1 else 20_000, 1e-4 if local == 1 else 1e-12, local).collect()}
        for n, pair in want.items():
            assert got[n] == pytest.approx(pair, abs=1e-2 if local == 1 else 1e-8)


def test_soft_clusters_add_up(spark):
    rnd = np.random.default_rng(1)
    rows = [(k, (rnd.normal(size=4) + 8 * (k % 2)).tolist()) for k in range(60)]
    got = network.soft_clusters(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 2, 2).collect()
    assert all(sum(r["memberships"]) == pytest.approx(1) for r in got)
    assert len({r["cluster"] for r in got if r["k"] % 2}) == 1 and len({r["cluster"] for r in got}) == 2


def test_tag_network_parts(spark):
    rnd = random.Random(4)
    words = {0: ["wind", "sun", "wave", "heat"], 1: ["farm", "soil", "seed", "crop"]}
    rows = [(f"o{k}", t) for k in range(30) for t in rnd.sample(words[k % 2], 3)] + [("o1", "once")]
    parts = network.tag_network(spark.createDataFrame(rows, "o string, t string"), "o", "t", 3.0, idf=True, blacklist=["heat"])
    cluster = {r["node"]: r["cluster"] for r in parts["clusters"].collect()}
    assert all((cluster[a] == cluster[b]) <= (int(a[1:]) % 2 == int(b[1:]) % 2) for a in cluster for b in cluster)
    assert "heat" not in " ".join(r["name"] for r in parts["names"].collect())
    assert {r["node"] for r in parts["nodes"].collect()} == set(cluster)


def test_cluster_names_drop_inner_words(spark):
    rows = [("x", t) for t in ["solar energy", "solar energy", "solar", "solar", "wind"]] + [("y", t) for t in ["wind", "wind", "farm", "farm", "once"]]
    got = {r["c"]: (r["name"], r["top_tags"]) for r in tags.cluster_names(spark.createDataFrame(rows, "c string, t string"), "t", "c", 1).collect()}
    assert got == {"x": ("solar energy", "solar energy"), "y": ("farm", "farm, wind")}


def test_permutations_by_sorting(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.random() < 0.3, rnd.choice([1.0, 2.0, 7.5])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, y boolean, v double")
    h = {r["k"]: r["h"] for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    m, n, total = sum(y for _, y, _ in rows), len(rows), sum(v for *_, v in rows)
    own = sum(v for _, y, v in rows if y)
    higher = 0
    for r in range(1, 41):
        salt = funding._mixed(np.array([r * 0x9E3779B97F4A7C15 + 9 & (2**64 - 1)], np.uint64))[0]
        x = funding._mixed(np.array([h[k] for k, _, _ in rows], np.int64).view(np.uint64) ^ salt)
        part = sum(rows[i][2] for i in np.argsort(x)[:m])
        higher += part / m - (total - part) / (n - m) >= own / m - (total - own) / (n - m)
    got = funding.permutation_test(df, "y", F.col("v"), "k", 40, 9).first()
    assert got["observed"] == pytest.approx(own / m - (total - own) / (n - m)) and got["p_value"] == pytest.approx(higher / 40)
    assert funding.permutation_test(df.where("y"), "y", F.col("v"), "k", 5, 9).first()["p_value"] is None


def test_dot_products_are_made_in_blocks():
    """The best of many others, in bounded memory, with equal vectors in the table's order."""
    import tracemalloc

    import pandas as pd

    rnd = np.random.default_rng(3)
    others = rnd.normal(size=(20_000, 8))
    others[::97] = others[5]
    names = np.array([f"c{k:05}" for k in range(len(others))], object)
    own = pd.DataFrame({"id": range(2000), "embedding": list(rnd.normal(size=(1997, 8))) + [others[5], others[97], np.zeros(8)]})
    tracemalloc.start()
    got = pd.concat(network.blocked_dot(iter([own]), others, names, 7))
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    for k in (0, 1, 500, 1997, 1999):
        sims = np.zeros(len(others))
        for x, y in zip(own["embedding"][k], others.T, strict=True):
            sims += x * y
        assert list(got["category"][got["id"] == k]) == list(names[np.argsort(-sims, kind="stable")[:7]])
    assert len(got) == 7 * len(own)


def test_blocks_meet_in_ranges(monkeypatch):
    """Shared rows of two blocks, held a few at a time, against a plain count."""
    from cairnframe.operators import blocks

    rnd = np.random.default_rng(4)
    local, ids = np.unique(np.c_[rnd.integers(0, 30, 400), rnd.integers(0, 25, 400)], axis=0).T
    order = np.argsort(ids, kind="stable")
    block = (np.arange(30), local[order], ids[order], {})
    want = {(u, v): len(set(ids[local == u]) & set(ids[local == v])) for u in range(30) for v in range(30)}
    for most in (1, 7, 50, 1 << 21):
        monkeypatch.setattr(blocks, "MET", most)
        got = {(int(u), int(v)): c for us, vs, cs in blocks.met(block[1:3], block[1:3], 30) for u, v, c in zip(us, vs, cs, strict=True)}
        assert got == {k: c for k, c in want.items() if c}
        u, v = np.array(sorted(want)).T
        assert list(blocks.common_items(u, v, block, block)) == [want[k] for k in sorted(want)]
