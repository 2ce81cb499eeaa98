"""Pairs of nodes that share items, block by block: nodes are dealt into blocks, each packed into one row and written
once; a task reads two blocks and answers their pairs, so no row of a pair crosses a shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

#: Rows (node, item) of two blocks that share an item, held at once.
MET = 1 << 21


def block_pairs(rows: DataFrame, answer: Callable, schema: str, prepare: Callable | None = None, n: int | None = None) -> DataFrame:
    """What answer(block, other, same) gives for each two blocks of rows (node, id, and numbers), itself included.

    A block is (names, local, id, numbers): distinct nodes in order, and its rows by id with the node's place; what
    prepare(block) makes of it, once for each block, is what answer gets.  Blocks grow as the root of the rows, up to two million rows each.
    n: the number of rows, about; where it is not given, rows are written once to count them."""
    spark = rows.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > 4 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    if n is None:
        rows = keep(rows)
        n = rows.count()
    blocks = max(1, int(np.ceil(np.sqrt(n / 30_000))), -(-n // 2_000_000))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        local, names = pd.factorize(pdf["node"], sort=True)
        order = np.argsort(pdf["id"].to_numpy(), kind="stable")
        numbers = {c: pdf[c].to_numpy()[order] for c in pdf.columns if c not in ("node", "id", "_block")}
        block = (np.asarray(names), local[order].astype(np.int32), pdf["id"].to_numpy()[order], numbers)
        whole = pickle.dumps(prepare(block) if prepare else block, 5)
        return pd.DataFrame({"_block": [int(pdf["_block"].iloc[0])], "size": [len(whole)], "packed": [pa.compress(whole, "zstd", asbytes=True)]})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).repartition(blocks, "_block")
    packed = keep(dealt.groupBy("_block").applyInPandas(pack, "_block int, size long, packed binary"))
    other = packed.toDF("_other", "_size", "_packed")
    pairs = packed.join(other.hint("shuffle_replicate_nl"), F.col("_block") <= F.col("_other"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lambda size, x: pickle.loads(pa.decompress(x, size, "zstd", asbytes=True))  # noqa: E731, S301  our own rows
        for pdf in batches:
            for k, size, packed_, o, osize, opacked in pdf.itertuples(index=False, name=None):
                a = load(size, packed_)
                yield from answer(a, a if k == o else load(osize, opacked), k == o)

    return pairs.mapInPandas(run, schema)


def met(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int, values: Callable | None = None, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, sum): for nodes of two blocks, given as (place, id) of rows by id, the pairs that share an
    id, and over the shared rows the sum of values(row of a, row of b), or their number.  size: nodes of b."""
    (la, ia), (lb, ib) = a, b
    if not len(ia) or not len(ib):
        return
    low = np.searchsorted(ib, ia, "left")
    count = np.searchsorted(ib, ia, "right") - low
    order = np.argsort(la, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return
    node, low, count = la[order], low[order], count[order]
    every = np.cumsum(count)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # a node's rows are in one range
    group = (every[first] - count[first]) // MET
    cuts = first[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
    for x, y in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        total = int(every[y - 1] - every[x] + count[x])
        base, cells = int(node[x]), (int(node[y - 1]) - int(node[x]) + 1) * size
        dense = cells <= max(4 * total, size)
        sums, tally = (np.zeros(cells), np.zeros(cells, bool)) if dense else (None, None)
        parts = [x, y] if not dense else np.unique(np.r_[x, x + np.flatnonzero(np.diff(every[x:y] // MET)) + 1, y])
        for p, q in zip(parts[:-1], parts[1:], strict=True):
            c = count[p:q]
            i = np.repeat(np.arange(p, q), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + low[i]
            key = (node[i].astype(np.int64) - base) * size + lb[j]
            w = values(order[i], j) if values else None
            if dense:
                sums += np.bincount(key, w, cells)
                tally[key] = True
        if dense:
            key = np.flatnonzero(tally)
            sums = sums[key]
        else:
            at = np.argsort(key, kind="stable")
            key = key[at]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums = np.diff(np.r_[start, len(key)]) if w is None else np.add.reduceat(w[at], start)
            key = key[start]
        u, v = key // size + base, key % size
        if same:
            u, v, sums = u[u < v], v[u < v], sums[u < v]
        yield u, v, sums


def common_items(u: np.ndarray, v: np.ndarray, a: tuple, b: tuple) -> np.ndarray:
    """The number of ids that each two nodes (place in block a, place in block b) share."""
    if not len(u):
        return np.zeros(0, np.int64)
    ids, back = np.unique(b[2], return_inverse=True)
    keys = np.sort(b[1].astype(np.int64) * len(ids) + back)
    at = np.minimum(np.searchsorted(ids, a[2]), len(ids) - 1)
    known = ids[at] == a[2]
    order = np.argsort(a[1][known], kind="stable")
    node, at = a[1][known][order], at[known][order]
    low, high = np.searchsorted(node, u, "left"), np.searchsorted(node, u, "right")
    every, out = np.cumsum(high - low), np.zeros(len(u), np.int64)
    cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(every // MET)) + 1, len(u)])
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        c = (high - low)[p:q]
        i = np.repeat(np.arange(p, q), c)
        want = v[i].astype(np.int64) * len(ids) + at[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + low[i]]
        found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        out[p:q] = np.bincount(i - p, keys[found] == want, q - p)
    return out
