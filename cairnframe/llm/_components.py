"""Connected components of a table of links: in one task where the links are few, else by alternating large-star and
small-star contraction.  Both give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import keep, spread_join


#: Links that one task contracts (16 bytes each); more are contracted by joins.
LOCAL_LINKS = 2_000_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links in these batches: each link gives both ends' labels the smaller one, and labels
    jump to their labels, until no link has two."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not pairs:
        return
    nodes, at = np.unique(np.concatenate([x for p in pairs for x in p]), return_inverse=True)
    cuts = np.cumsum([0] + [len(x) for p in pairs for x in p])
    u, v = (np.concatenate([at[cuts[k] : cuts[k + 1]] for k in range(side, 2 * len(pairs), 2)]) for side in (0, 1))
    label = np.arange(len(nodes))
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """A hub's links are dealt over several tasks."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    nearest = least.select("u", F.least("u", "m").alias("m"))
    seen = spread_join(both, nearest, "u", least.select("u", "n"), ["v"], 2 * total)
    if large:
        out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(nearest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) for every node with a link; edges: u, v of type long."""
    directed = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, total = None, directed.count()
    if total <= LOCAL_LINKS:
        return directed.repartition(1).mapInArrow(contract, "node long, component long")
    while True:
        # large-star links every larger neighbour of a node to the smallest; then small-star the others
        turned = _star(directed, True, total).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        directed = keep(_star(turned, False, total).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(directed.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, total = now, now[0]
    nodes = directed.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(directed.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
