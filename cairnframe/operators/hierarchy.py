"""Hierarchical tags: term cleaning, average linkage, labels of a tree, small clusters merged into large ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarities closer than this are equal; sums of vectors are only exact to rounding.
EQUAL = 1e-12


def singular_terms(terms: DataFrame, key: str, term: str) -> DataFrame:
    """key, term with a plural as its singular where both occur."""
    rows = terms.select(key, F.lower(F.trim(F.col(term))).alias("term")).where("term <> ''").distinct()
    known = rows.select(F.col("term").alias("single")).distinct()
    guess = F.when(F.col("term").endswith("ies"), F.regexp_replace("term", "ies$", "y")).when(F.col("term").endswith("s"), F.regexp_replace("term", "s$", ""))
    return rows.withColumn("g", guess).join(known, F.col("g") == F.col("single"), "left").select(key, F.coalesce("single", "term").alias("term")).distinct()


def average_linkage(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, similarity) by cosine with average linkage; leaves are 0..n-1, merge k makes node n + k.

    Chains of nearest neighbours: each step compares one cluster with the others, so n terms take n^2 comparisons; merges
    come out in order of their similarity.  The mean cosine of two clusters is the product of their sums of unit vectors
    over their sizes, so no table of pairs is held: memory grows as the terms."""
    n = len(vectors)
    total = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    size, alive, leaf = np.ones(n), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    found: list[tuple[float, int, int]] = []
    dead = 0
    while len(found) < n - 1:
        if dead * 4 > len(leaf):
            at = np.cumsum(alive) - 1
            chain = [int(at[x]) for x in chain]
            total, size, leaf, alive, dead = total[alive], size[alive], leaf[alive], np.ones(int(alive.sum()), bool), 0
        if not chain:
            chain = [int(np.argmax(alive))]
        i = chain[-1]
        sim = np.where(alive, total @ total[i] / (size * size[i]), -np.inf)
        sim[i] = -np.inf
        most = sim.max()
        if len(chain) > 1 and sim[chain[-2]] >= most - EQUAL:
            j = chain[-2]
            chain = chain[:-2]
            i, j = min(i, j), max(i, j)
            found.append((float(total[i] @ total[j] / (size[i] * size[j])), int(leaf[i]), int(leaf[j])))
            total[i] += total[j]
            size[i] += size[j]
            alive[j] = False
            dead += 1
        else:
            chain.append(int(np.argmax(sim >= most - EQUAL / 10)))
    name, out = list(range(n)), []
    for k, (s, i, j) in enumerate(sorted(found, key=lambda x: -x[0])):
        out.append((_top(name, i), _top(name, j), s))
        node = n + k
        name.append(node)
        name[out[-1][0]] = name[out[-1][1]] = node
    return out


def _top(name: list[int], x: int) -> int:
    while name[x] != x:
        name[x] = x = name[name[x]]
    return x


def without_places(terms: DataFrame, key: str, term: str, places: DataFrame) -> DataFrame:
    """key, term without terms that are a place (place) or hold one as consecutive words."""
    words = terms.select(key, F.col(term).alias("term"), F.explode(_runs(F.col(term))).alias("run"))
    bad = words.join(places.select(F.lower("place").alias("run")).distinct(), "run").select("term").distinct()
    return terms.select(key, F.col(term).alias("term")).join(bad, "term", "left_anti").select(key, "term")


def _runs(c: Column, most: int = 5) -> Column:
    from .tags import ngrams

    return ngrams(F.split(F.lower(c), " "), most)


def synonym_groups(similar: DataFrame, frequency: DataFrame, least: float = 0.9, min_count: int = 2, excluded: list[str] | None = None) -> DataFrame:
    """term, representative: terms joined by similarities (u, v, sim) of at least `least`, and the most frequent term of
    each group, for groups of min_count documents in all.  frequency: term, n."""
    from .network import min_label_components

    label = min_label_components(similar.where(F.col("sim") >= least).select("u", "v"))
    own = frequency.join(label, frequency["term"] == label["node"], "left").withColumn("g", F.coalesce("component", "term"))
    if excluded:
        own = own.where(~F.col("term").isin(excluded))
    best = own.groupBy("g").agg(F.sum("n").alias("_s"), F.min(F.struct((-F.col("n")).alias("n"), "term"))["term"].alias("representative")).where(F.col("_s") >= min_count)
    return own.join(best, "g").select("term", "representative")


def tag_tree(terms: DataFrame, group: str, term: str, vector: str, freq: str) -> DataFrame:
    """group, node, parent, label, sim: the tree of each group's terms; a node is named by its term with the largest
    frequency-weighted similarity to the node's centre, of equal ones by the last in order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([freq, term], ascending=[False, True])
        vectors, names, counts = np.stack(pdf[vector].to_numpy()).astype(float), pdf[term].to_numpy(object), pdf[freq].to_numpy(float)
        n = len(names)
        merges = average_linkage(vectors)
        size, start, parent = np.ones(2 * n - 1, int), np.zeros(2 * n - 1, int), np.full(2 * n - 1, -1)
        for k, (a, b, _) in enumerate(merges):
            size[n + k] = size[a] + size[b]
            parent[a] = parent[b] = n + k
        for k, (a, b, _) in reversed(list(enumerate(merges))):
            start[a], start[b] = start[n + k], start[n + k] + size[a]
        leaves = np.argsort(start[:n])  # a node's terms are next to each other
        unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))[leaves]
        counts, place = counts[leaves], np.argsort(np.argsort(names, kind="stable"))[leaves]
        label = np.arange(2 * n - 1)
        for node in range(n, 2 * n - 1):
            own = slice(start[node], start[node] + size[node])
            centre = unit[own].mean(0)
            score = counts[own] * (unit[own] @ centre)
            near = np.flatnonzero(score >= score.max() - EQUAL * np.abs(score).max()) + start[node]
            label[node] = leaves[near[np.argmax(place[near])]]
        order = np.r_[n : 2 * n - 1, 0:n]
        sims = np.r_[[m[2] for m in merges], np.ones(n)]
        return pd.DataFrame({group: pdf[group].iloc[0], "node": order, "parent": parent[order], "label": names[label[order]], "sim": sims})

    kind = terms.schema[group].dataType.simpleString()
    return terms.groupBy(group).applyInPandas(build, f"{group} {kind}, node int, parent int, label string, sim double")


def merge_small_clusters(assign: DataFrame, edges: DataFrame, ratio: float = 10, largest: int = 40) -> DataFrame:
    """node, cluster with small clusters in the large one they are most similar to (mean edge weight).

    A cluster moves if it has less than `largest` nodes and the other is more than `ratio` times as large; only the
    clusters' own assignments count, so moves do not chain."""
    size = assign.groupBy("cluster").agg(F.count("*").alias("n"))
    of_u, of_v = assign.select(F.col("node").alias("u"), F.col("cluster").alias("a")), assign.select(F.col("node").alias("v"), F.col("cluster").alias("b"))
    between = edges.join(of_u, "u").join(of_v, "v").where("a <> b").groupBy("a", "b").agg(F.avg("sim").alias("s"))
    sized = between.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
    moves = sized.where((F.col("na") < largest) & (F.col("nb") > ratio * F.col("na"))).groupBy("a").agg(F.max_by("b", F.struct("s", "b")).alias("to"))
    return assign.join(moves, assign["cluster"] == moves["a"], "left").select("node", F.coalesce("to", "cluster").alias("cluster"))


def tag_documents(documents: DataFrame, key: str, term: str, nodes: DataFrame, closure: DataFrame, least_similarity: float = 0.2, least_score: float = 0.15) -> DataFrame:
    """key, tag, score: document terms (key, term) as tags of a tree.

    nodes: term, tag (the node a term is closest to); closure: tag, ancestor, sim, the node itself included.  A tag's
    weight in a document is the sum of similarities of at least least_similarity from the document's nodes to it; the
    score is that weight times ln(documents / documents with the tag), over the length of the document's vector; scores
    up to least_score go."""
    from pyspark.sql import Window

    own = documents.join(nodes, documents[term] == nodes["term"]).select(key, "tag")
    up = own.join(closure.where(F.col("sim") >= least_similarity), "tag").groupBy(key, F.col("ancestor").alias("tag")).agg(F.sum("sim").alias("w"))
    total = documents.select(key).distinct().agg(F.count("*").alias("_n"))
    df = up.groupBy("tag").agg(F.count("*").alias("_df"))
    rows = up.join(df, "tag").crossJoin(F.broadcast(total)).withColumn("x", F.col("w") * F.log(F.col("_n") / F.col("_df")))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return rows.withColumn("score", F.try_divide("x", norm)).where(F.col("score") > least_score).select(key, "tag", "score")


def pruned_tree(tree: DataFrame, group: str) -> DataFrame:
    """group, node, parent, label of a tag tree without inner nodes named like their parent: their children move up.
    One step of joins for each level that goes."""
    out = tree.select(group, "node", "parent", "label")
    for _ in range(64):
        up = out.select(F.col(group).alias("_g"), F.col("node").alias("_n"), F.col("label").alias("_l"), F.col("parent").alias("_p"))
        same = out.join(up, (out[group] == up["_g"]) & (out["parent"] == up["_n"])).where(F.col("label") == F.col("_l")).select(F.col(group).alias("_g"), F.col("node").alias("_gone"), F.col("parent").alias("_to"))
        inner = out.select(F.col(group).alias("_h"), F.col("parent").alias("_q")).distinct()
        same = same.join(inner, (F.col("_g") == F.col("_h")) & (F.col("_gone") == F.col("_q")), "left_semi")
        same = same.join(same.select(F.col("_g").alias("_g2"), F.col("_gone").alias("_x")), (F.col("_g") == F.col("_g2")) & (F.col("_to") == F.col("_x")), "left_anti")  # one of a chain at a time
        from ..sources.shared import keep

        same = keep(same)
        if not same.count():
            return out
        moved = out.join(same, (out[group] == F.col("_g")) & (out["parent"] == F.col("_gone")), "left").select(group, "node", F.coalesce("_to", "parent").alias("parent"), "label")
        gone = same.select(F.col("_g").alias(group), F.col("_gone").alias("node"))
        out = keep(moved.join(gone, [group, "node"], "left_anti"))
    return out
