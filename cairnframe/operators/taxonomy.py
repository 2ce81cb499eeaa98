"""Taxonomy mapping: similarities of entities and categories, parents, flattening."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import blocked_dot

#: Categories that are broadcast as one matrix; a taxonomy beyond it is joined in pieces of this size.
MAX_CATEGORIES = 20_000


def top_categories(entities: DataFrame, key: str, vector: str, categories: DataFrame, name: str, category_vector: str, n: int = 5, places: int | None = None, own: str | None = None) -> DataFrame:
    """id, category, sim, rank: the n categories with the largest dot product, rounded if places are given; of an entity
    as many as its column `own` says, n at most (n of each piece, where there are several).  The taxonomy is read in pieces of
    bounded size, each multiplied with blocks of entities; the pieces' best are ranked again.  Of equal vectors in a
    piece, the first n by name are enough."""
    rows = entities.select(F.col(key).alias("id"), F.col(vector).alias("embedding"), *([F.col(own).alias("n")] if own else []))
    kind = rows.schema["id"].dataType.simpleString()
    out, piece = [], []

    def multiply(piece: list) -> DataFrame:
        names = np.array([r[0] for r in piece], object)
        matrix = np.array([r[1] for r in piece], float)
        seen: Counter[bytes] = Counter()
        first = np.zeros(len(piece), bool)
        for k, x in enumerate(matrix):
            first[k] = seen[x.tobytes()] < n
            seen[x.tobytes()] += 1
        names, matrix = names[first], matrix[first]
        send = entities.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = send.value
            yield from blocked_dot(batches, matrix, names, n, places)

        return rows.mapInPandas(run, f"id {kind}, category string, sim double, rank int")

    for r in categories.select(F.col(name).cast("string"), category_vector).orderBy(name).toLocalIterator():
        piece.append(r)
        if len(piece) == MAX_CATEGORIES:
            out.append(multiply(piece))
            piece = []
    if piece or not out:
        out.append(multiply(piece))
    if len(out) == 1:
        return out[0]
    from pyspark.sql import Window

    both = reduce(DataFrame.unionByName, out).drop("rank")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "category"))).where(F.col("rank") <= n)


def within_delta(mapping: DataFrame, key: str, score: str, delta: float, threshold: float) -> DataFrame:
    """Rows over the threshold and within delta of the entity's best; the best always stays."""
    from pyspark.sql import Window

    best = F.max(score).over(Window.partitionBy(key))
    return mapping.withColumn("_b", best).where((F.col(score) == F.col("_b")) | ((F.col(score) > threshold) & (F.col(score) >= F.col("_b") - delta))).drop("_b")


def closure(tree: DataFrame, node: str, parent: str, depth: int) -> DataFrame:
    """node, ancestor, distance up to `depth`; joins as many times as the tree is deep, each on the parent."""
    step = tree.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null")
    up = step.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    rows, out = step.withColumn("distance", F.lit(1)), []
    for d in range(1, depth + 1):
        out.append(rows)
        rows = rows.join(up, rows["ancestor"] == up["_n"]).select("node", F.col("_a").alias("ancestor"), F.lit(d + 1).alias("distance"))
    return reduce(DataFrame.unionByName, out)


def missing_parents(levels: DataFrame, upper: DataFrame, parent: str, name: str) -> DataFrame:
    """Parents named one level down that do not exist; a taxonomy is valid if there are none."""
    return levels.select(F.col(parent).alias("name")).where("name is not null").distinct().join(upper.select(F.col(name).alias("name")).distinct(), "name", "left_anti")


def similarity_percentiles(entities: DataFrame, key: str, vector: str, categories: DataFrame, name: str, category_vector: str, n: int = 5, threshold: float = 90.0, delta: float = 1.0) -> DataFrame:
    """id, category, sim, pct, rank: per entity its best category, and up to n whose percentile is over the threshold and
    within delta of the best one's.

    The percentile of a similarity is the share of all pairs strictly below it.  Pairs are multiplied in blocks: a first
    pass counts them in ranges, a second sends the similarities from the smallest candidate on, rounded to 9 places and
    counted by value in each block; what lies below a value is then summed within its range only."""
    from pyspark.sql import Window

    names, matrix = _matrix(categories, name, category_vector)
    rows = entities.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    kind = rows.schema["id"].dataType.simpleString()
    send = entities.sparkSession.sparkContext.broadcast((names, matrix))
    best = top_categories(entities, key, vector, categories, name, category_vector, n)
    low, high = (float(x or 0.0) for x in best.agg(F.min("sim"), F.max("sim")).first())
    steps = np.linspace(low, high, 4097)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, m = send.value
        total = np.zeros(len(steps) + 1, np.int64)
        for pdf in batches:
            sims = np.round(np.stack(pdf["embedding"].to_numpy()).astype(float) @ m.T, 9)
            total += np.bincount(np.searchsorted(steps, sims.ravel(), side="right"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"b": at, "n": total[at]})

    counted = {r["b"]: r["n"] for r in rows.mapInPandas(sums, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()}  # at most 4,098 rows
    below = np.cumsum([0] + [counted.get(b, 0) for b in range(len(steps) + 1)])
    every = int(below[-1])

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Similarities of the ranges that hold candidates, counted by value."""
        _, m = send.value
        for pdf in batches:
            sims = np.round(np.stack(pdf["embedding"].to_numpy()).astype(float) @ m.T, 9).ravel()
            x, c = np.unique(sims[sims >= low - 1e-9], return_counts=True)
            yield pd.DataFrame({"b": np.searchsorted(steps, x, side="right"), "x": x, "c": c})

    inside = rows.mapInPandas(values, "b long, x double, c long").groupBy("b", "x").agg(F.sum("c").alias("c"))
    under = F.coalesce(F.sum("c").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = entities.sparkSession.createDataFrame([(k, int(v)) for k, v in enumerate(below[:-1])], "b long, s long")
    pct = inside.withColumn("u", under).join(F.broadcast(starts), "b").select("x", (100.0 * (F.col("s") + F.col("u")) / every).alias("pct"))
    out = best.withColumn("x", F.round("sim", 9)).join(pct, "x", "left").withColumn("_m", F.max("pct").over(Window.partitionBy("id")))
    good = (F.col("rank") == 1) | ((F.col("pct") > threshold) & (F.col("pct") > F.col("_m") - delta))
    return out.where(good).select(F.col("id").cast(kind).alias("id"), "category", "sim", "pct", "rank")


def _matrix(categories: DataFrame, name: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Names and vectors of a taxonomy of at most MAX_CATEGORIES categories."""
    rows = categories.select(F.col(name).cast("string"), vector).orderBy(name).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    return np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], float)


def level_paths(nodes: DataFrame, node: str, parent: str, root: str, depth: int) -> DataFrame:
    """node, level0 ... level{depth - 1}: the names from the root down to the node.  Of deeper nodes, what lies beyond
    the last level is one name, parts joined by ` - `."""
    kids = nodes.select(F.col(node).alias("node"), F.col(parent).alias("_p"))
    level = kids.where(F.col("_p") == root).select("node", F.array(F.col("node")).alias("path"))
    out = level
    for _ in range(depth + 8):
        level = kids.join(level.select(F.col("node").alias("_p"), "path"), "_p").select("node", F.concat("path", F.array("node")).alias("path"))
        out = out.unionByName(level)
    deep = F.array_join(F.slice("path", depth, 99), " - ")
    names = [F.when(F.size("path") > depth, deep).otherwise(F.get("path", F.lit(k))) if k == depth - 1 else F.get("path", F.lit(k)) for k in range(depth)]
    return out.select("node", *[x.alias(f"level{k}") for k, x in enumerate(names)])


def forced_parents(mapping: DataFrame, key: str, category: str, closure_: DataFrame) -> DataFrame:
    """mapping (key, category) with all ancestors of its categories.  closure_: node, ancestor."""
    up = mapping.join(closure_, mapping[category] == closure_["node"]).select(key, F.col("ancestor").alias(category))
    return mapping.select(key, category).unionByName(up).distinct()


def unique_children(terms: DataFrame, term: str, parent: str) -> DataFrame:
    """terms where a name that stands under several parents gets its parent as a suffix."""
    many = terms.groupBy(F.col(term).alias("_t")).agg(F.countDistinct(parent).alias("_n")).where(F.col("_n") > 1).select("_t")
    out = terms.join(many, terms[term] == many["_t"], "left")
    return out.withColumn(term, F.when(F.col("_t").isNotNull(), F.concat(F.col(term), F.lit(" ("), F.col(parent), F.lit(")"))).otherwise(F.col(term))).drop("_t")


def over_mean(mapping: DataFrame, key: str, value: str, threshold: float, order: str | None = None) -> DataFrame:
    """All rows of entities whose mean value passes the threshold.  A sum of doubles depends on the order of its terms, and
    so does a mean that lies on the threshold; with `order`, an entity's values are held together and added in its order,
    however rows are dealt."""
    if order is None:
        mean = F.avg(value)
    else:
        values = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
        mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x[value].cast("double")), F.size(values).cast("double"))
    good = mapping.groupBy(key).agg(mean.alias("_m")).where(F.col("_m") > threshold).select(key)
    return mapping.join(good, key, "left_semi")


def mapping_to_entities(entities: DataFrame, mapping: DataFrame, key: str, pct: str, levels: list[str]) -> DataFrame:
    """entities with the levels of their best mapping (the first by level names of equals) as best_*, and distinct lists
    of all their levels as all_*."""
    best = mapping.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct((-F.col(pct)).alias("p"), *levels)).alias("b"), *[F.array_sort(F.collect_set(c)).alias(f"all_{c}") for c in levels])
    own = best.select("_k", *[F.col(f"b.{c}").alias(f"best_{c}") for c in levels], *[f"all_{c}" for c in levels])
    return entities.join(own, entities[key] == own["_k"], "left").drop("_k")


def share_table(rows: DataFrame, path: list[str], amount: Column) -> DataFrame:
    """The table behind a sunburst: the amount of each path, its part of the whole and of its parent, and the cumulative
    part within the parent, largest first."""
    from pyspark.sql import Window

    out = []
    for d in range(1, len(path) + 1):
        own = rows.groupBy(*path[:d]).agg(F.sum(amount).alias("amount"))
        above = Window.partitionBy(*path[: d - 1])
        order = above.orderBy(F.desc("amount"), path[d - 1])
        part = F.try_divide("amount", F.sum("amount").over(above))
        own = own.withColumn("of_parent", part).withColumn("cumulative", F.sum("of_parent").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        out.append(own.select(F.lit(d).alias("depth"), F.concat_ws("/", *path[:d]).alias("path"), "amount", "of_parent", "cumulative"))
    whole = rows.agg(F.sum(amount).alias("_w"))
    return reduce(DataFrame.unionByName, out).crossJoin(F.broadcast(whole)).withColumn("of_whole", F.try_divide("amount", "_w")).drop("_w")


def several_mappings(entities: DataFrame, key: str, mappings: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """entities with the best and all levels of several mappings (mapping, its score, its levels), under each one's
    name."""
    out = entities
    for name, (mapping, score, levels) in mappings.items():
        got = mapping_to_entities(entities.select(key), mapping, key, score, levels)
        out = out.join(got.toDF(key, *[f"{name}_{c}" for c in got.columns if c != key]), key, "left")
    return out


def filled_sheet(rows: DataFrame, order: str, columns: list[str], exclude: str | None = None) -> DataFrame:
    """Rows of a sheet with merged cells: each empty cell of the columns takes the last value above it; then rows that
    `exclude` marks with 1 go.  A sheet is a bounded table, so one ordered pass fills it."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})
    return out.where(F.coalesce(F.col(exclude).cast("int"), F.lit(0)) != 1) if exclude else out


def tree_document(tree: DataFrame, group: str) -> DataFrame:
    """group, document: a tag tree (node, parent, label, sim) as JSON."""
    items = F.array_sort(F.collect_list(F.struct("node", "parent", "label", "sim")))
    return tree.groupBy(group).agg(F.to_json(items).alias("document"))


def tree_from_document(documents: DataFrame, group: str) -> DataFrame:
    """The tree that `tree_document` wrote."""
    return documents.select(group, F.inline(F.from_json("document", "array<struct<node: int, parent: int, label: string, sim: double>>")))
