"""Set similarities and spatial joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .blocks import block_pairs, common_items, met


def set_jaccard(df: DataFrame, key: str, item: str, least: float = 0.0) -> DataFrame:
    """(u, v, common, jaccard), u < v, for sets given as rows: through their items, never all pairs.

    With a bound, only prefixes meet: a set's items in order from the rarest, without the last ceil(least * size) but
    one.  Two sets that reach the bound share an item of both prefixes, so common items are not joined.  Prefixes meet in
    blocks of sets; pairs whose shared items and the rest of a set could reach the bound are answered from whole sets.

    Rows are shuffled once, by set, and told apart there: whole numbers are items themselves, others are told apart by 64
    bits.  How common an item is is read from a table of bounded size, which only orders items and never changes a result.
    """
    if least <= 0:
        f = df.select(F.col(key).alias("u"), F.col(item).alias("i")).distinct()
        size = f.groupBy("u").agg(F.count("*").alias("n"))
        pairs = f.join(f.select(F.col("u").alias("v"), "i"), "i").where("u < v").groupBy("u", "v").agg(F.count("*").alias("common"))
        both = pairs.join(size.withColumnRenamed("n", "nu"), "u").join(size.select(F.col("u").alias("v"), F.col("n").alias("nv")), "v")
        return both.select("u", "v", "common", (F.col("common") / (F.col("nu") + F.col("nv") - F.col("common"))).alias("jaccard"))
    kind, whole = df.schema[key].dataType.simpleString(), df.schema[item].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col(item).cast("long") if whole else F.xxhash64(item)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.coalesce(number, F.lit(0)).alias("id"), F.col(item).isNull().alias("none"))
    often = rows.groupBy(F.pmod("id", F.lit(PLACES)).cast("int").alias("place")).agg(F.count("*").alias("n")).toArrow()
    place, n = (often.column(c).to_numpy() for c in ("place", "n"))
    table = np.zeros(PLACES, np.int32)
    table[place] = np.minimum(n, 2**31 - 1)
    send = df.sparkSession.sparkContext.broadcast(table)

    def answer(a: tuple, b: tuple, same: bool) -> Iterator[pd.DataFrame]:
        (pa_, na), (pb, nb) = a[3], b[3]
        for u, v, c in met((a[1][pa_], a[2][pa_]), (b[1][pb], b[2][pb]), len(b[0]), None, same):
            x, y = na[u], nb[v]
            small, large = np.minimum(x, y), np.maximum(x, y)
            rest = np.ceil(large * least - 1e-9) - 1  # what the prefixes leave out of either set, at most
            good = (small >= large * (least - 1e-9)) & ((c + rest) * (1 + least) >= least * (x + y) - 1e-6)
            u, v, x, y = u[good], v[good], x[good], y[good]
            c = common_items(u, v, a, b)
            jaccard = c / (x + y - c)
            good = jaccard > least
            s, t = a[0][u[good]], b[0][v[good]]
            yield pd.DataFrame({"u": np.where(s < t, s, t), "v": np.where(s < t, t, s), "common": c[good], "jaccard": jaccard[good]})

    return block_pairs(rows, answer, f"u {kind}, v {kind}, common long, jaccard double", lambda block: _prefix(block, least, send.value), int(n.sum()))


#: Places of the table of how common items are.
PLACES = 1 << 20


def _prefix(block: tuple, least: float, often: np.ndarray) -> tuple:
    """The block with each row once and without null items, and as its numbers which rows are in their sets' prefixes and
    the sizes of the sets.  The order of items: the counts of their places in the table, then ids."""
    names, local, ids, x = block
    order = np.lexsort((x["none"], ids, local))
    local, ids, none = local[order], ids[order], x["none"][order]
    new = np.r_[True, (local[1:] != local[:-1]) | (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]
    size = np.bincount(local[new], minlength=len(names))  # a null item is one that no other set has
    good = new & ~none
    local, ids = local[good], ids[good]
    order = np.lexsort((ids, often[ids % len(often)], local))
    start = np.flatnonzero(np.diff(local[order], prepend=-1))
    own = np.diff(np.r_[start, len(local)])
    place = np.empty(len(local), np.int64)
    place[order] = np.arange(len(local)) - np.repeat(start + own - size[local[order][start]], own)  # null items come first
    chosen = place < size[local] - np.ceil(size[local] * least - 1e-9) + 1
    order = np.argsort(ids, kind="stable")
    return names, local[order], ids[order], (np.flatnonzero(chosen[order]), size)


def neighbour_jaccard(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Jaccard of nodes' neighbourhoods, where in- and out-neighbours count apart."""
    ends = edges.select(F.col("u").alias("node"), F.concat(F.lit("o"), F.col("v").cast("string")).alias("i")).unionByName(edges.select(F.col("v").alias("node"), F.concat(F.lit("i"), F.col("u").cast("string")).alias("i")))
    return set_jaccard(ends, "node", "i", least)


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(point, box) of points inside boxes (box, x0, x1, y0, y1), by a join on grid cells of a size."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    rows = points.withColumn("cx", at("x")).withColumn("cy", at("y")).join(cells, ["cx", "cy"])
    return rows.where("x >= x0 and x <= x1 and y >= y0 and y <= y1").select("point", "box")


def points_in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(point, polygon) by ray casting; polygons as edges (polygon, x1, y1, x2, y2).  Edges whose heights hold the
    point's are found by bands of height, and crossings to its right are counted."""
    band = edges.withColumn("b", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    rows = points.withColumn("b", F.floor("y")).join(band, "b").where("(y1 > y) <> (y2 > y)")
    cross = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1") > F.col("x")
    return rows.where(cross).groupBy("point", "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").select("point", "polygon")


def influence_overlap(edges: DataFrame, keystones: DataFrame, least: int = 2) -> DataFrame:
    """source, n: sources with at least `least` edges to keystones (node)."""
    k = keystones.select(F.col("node").alias("v"))
    return edges.join(k, "v", "left_semi").groupBy(F.col("u").alias("source")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def overlap_forms(a, b):
    """Column functions of two sets given as arrays: Jaccard; Jaccard over the largest one their sizes allow; which
    elements of a are in b (1 or 0)."""
    common, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    small, large = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    jaccard = F.try_divide(common.cast("double"), every.cast("double"))
    return jaccard, jaccard * F.try_divide(large.cast("double"), small.cast("double")), F.transform(a, lambda x: F.array_contains(b, x).cast("int"))


#: Rows of a table of labels that is broadcast, at most.
BROADCAST_LABELS = 500_000


def merge_identical(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges whose nodes of similar pairs (u, v; v is the one that goes) are replaced by the smallest node they are
    linked with; edges that become equal are one."""
    from .network import min_label_components

    label = min_label_components(stored(pairs.select("u", "v")))  # pairs are read twice
    few = label.count() <= BROADCAST_LABELS
    at = lambda c, n: (F.broadcast(label) if few else label).select(F.col("node").alias(c), F.col("component").alias(n))
    rows = edges.join(at("u", "_a"), "u", "left").join(at("v", "_b"), "v", "left")
    return rows.select(F.coalesce("_a", "u").alias("u"), F.coalesce("_b", "v").alias("v")).where("u <> v").distinct()
