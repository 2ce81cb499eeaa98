"""Joins of the landscape tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_enrich(left: DataFrame, right: DataFrame, key: str, prefer: dict[str, str]) -> DataFrame:
    """Left join; each column of `prefer` becomes the first of itself and the right table's column that is not null."""
    r = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in prefer.values()])
    out = left.join(r, left[key] == r["_k"], "left")
    for mine, theirs in prefer.items():
        value = F.coalesce(F.col(mine), F.col(f"_r_{theirs}")) if mine in left.columns else F.col(f"_r_{theirs}")
        out = out.withColumn(mine, value)
    return out.drop("_k", *[f"_r_{c}" for c in prefer.values()])


def outer_provenance(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and where it stands: prior, new or both."""
    a, b = old.select(key).distinct().withColumn("_a", F.lit(1)), new.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    return both.select(key, F.when(F.col("_b").isNull(), "prior").when(F.col("_a").isNull(), "new").otherwise("both").alias("provenance"))


def best_mapping(mapping: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """Per entity: the best-scored name (ties to the smaller name) and all names."""
    ranked = mapping.groupBy(key).agg(F.max(score).alias("best_score"), F.array_sort(F.collect_set(name)).alias("names"))
    top = mapping.join(ranked, key).where(F.col(score) == F.col("best_score")).groupBy(key).agg(F.min(name).alias("best"))
    return ranked.join(top, key)


def cache_split(rows: DataFrame, cache: DataFrame, key: str, text_key: str, max_errors: int = 1) -> DataFrame:
    """rows with `state`: found, run (missing, changed text, or an error below the budget) or skip (budget used up)."""
    c = cache.select(F.col(key).alias("_k"), F.col(text_key).alias("_t"), F.col("response").alias("_r"), F.col("num_errors").alias("_e"))
    joined = rows.join(c, (rows[key] == c["_k"]) & (rows[text_key] == c["_t"]), "left")
    state = F.when(F.col("_k").isNull(), "run").when(F.col("_r").isNotNull(), "found").when(F.col("_e") < max_errors, "run").otherwise("skip")
    return joined.withColumn("state", state).withColumn("response", F.col("_r")).drop("_k", "_t", "_r", "_e")


def cached_map(rows: DataFrame, cache: DataFrame, key: str, text_key: str, run, schema: str, max_errors: int = 1) -> tuple[DataFrame, DataFrame]:
    """Results for all rows and the new cache rows: only rows in state `run` reach `run`, a function of batches (pandas
    frames) that stands for an outside service."""
    split = cache_split(rows, cache, key, text_key, max_errors)
    fresh = split.where(F.col("state") == "run").drop("state", "response").mapInPandas(run, schema)
    return split.where(F.col("state") == "found").drop("state"), fresh


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The cache with the last row (by `order`) of each key."""
    both = cache.unionByName(fresh, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def dedupe_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_votes(df: DataFrame, key: str, first: str, second: str, tie: str) -> DataFrame:
    """One row of each key: a vote for the largest of each of two columns; most votes, then the first column, then `tie`."""
    w = Window.partitionBy(key)
    votes = (F.col(first) == F.max(first).over(w)).cast("int") + (F.col(second) == F.max(second).over(w)).cast("int")
    return dedupe_first(df.withColumn("votes", votes), [key], F.desc("votes"), F.desc(first), F.col(tie))


def fuzzy_names(left: DataFrame, right: DataFrame, a: str, b: str, ratio: float = 0.7, jaccard: float = 0.6) -> DataFrame:
    """Pairs of names that share a word and are alike: sequence ratio or word Jaccard at a threshold.

    Candidates come from an equi-join on words; distinct names only.
    """
    import difflib

    def words(df: DataFrame, c: str, out: str) -> DataFrame:
        return df.select(F.col(c).alias(out)).distinct().withColumn("w", F.explode(F.array_distinct(F.split(F.lower(out), " +"))))

    x, y = words(left, a, "name_a"), words(right, b, "name_b")
    pairs = x.join(y, "w").select("name_a", "name_b").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r, j = [], []
            for p, q in zip(pdf["name_a"], pdf["name_b"], strict=True):
                s, t = set(p.lower().split()), set(q.lower().split())
                r.append(difflib.SequenceMatcher(None, p.lower(), q.lower()).ratio())
                j.append(len(s & t) / max(1, len(s | t)))
            out = pdf.assign(ratio=r, jaccard=j)
            yield out[(out["ratio"] >= ratio) | (out["jaccard"] >= jaccard)]

    return pairs.mapInPandas(compare, "name_a string, name_b string, ratio double, jaccard double")
