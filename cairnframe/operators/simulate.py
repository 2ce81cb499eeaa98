"""Sensitivity simulations: every draw is a hash of (id, round, seed), so results repeat and need no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) fixed by the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def jittered_relevance(skills: DataFrame, person: str, skill: str, relevant: str, rounds: int, seed: int, flip: float = 0.005, threshold: float = 0.5, spread: float = 0.05) -> DataFrame:
    """round, person, share, passed: per round, labels of a skill flip with probability `flip` and the threshold moves by
    a draw from a normal distribution (sum of twelve uniforms).

    Rows are summed by person and skill once; a round only adds what its few flipped skills change."""
    rows = skills.groupBy(F.col(person).alias("p"), F.col(skill).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(relevant).cast("long")).alias("y"))
    people = rows.groupBy("p").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    flipped = rows.select("s").distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).where(uniform(seed, "s", "round") < flip)
    change = rows.join(flipped, "s").groupBy("p", "round").agg(F.sum(F.col("n") - 2 * F.col("y")).alias("d"))
    normal = sum((uniform(seed + k, "round") for k in range(1, 13)), F.lit(-6.0))
    shares = people.join(change, ["p", "round"], "left").withColumn("share", (F.col("y") + F.coalesce("d", F.lit(0))) / F.col("n"))
    return shares.select("round", F.col("p").alias("person"), "share", (F.col("share") >= F.lit(threshold) + spread * normal).alias("passed"))


def changed_skills(skills: DataFrame, person: str, skill: str, pool: DataFrame, round_: int, seed: int, most_gone: int = 4, most_new: int = 3) -> DataFrame:
    """person, skill of one round: each person loses min(most_gone, ceil(n / 4)) skills at most and gains most_new at
    most from a pool (skill), chosen by hashes."""
    rows = skills.select(F.col(person).alias("person"), F.col(skill).alias("skill")).distinct()
    n = F.count("*").over(Window.partitionBy("person"))
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.xxhash64("person", "skill", F.lit(round_), F.lit(seed)), "skill"))
    gone = F.floor(uniform(seed + 1, "person", F.lit(round_)) * (F.least(F.lit(most_gone), F.ceil(F.col("n") / 4)) + 1))
    kept = rows.withColumn("n", n).withColumn("r", rank).where(F.col("r") > gone).select("person", "skill")
    more = rows.select("person").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most_new)))).where(F.col("k") <= F.floor(uniform(seed + 2, "person", F.lit(round_)) * (most_new + 1)))
    size = pool.select("skill").distinct().agg(F.count("*").alias("_n"))
    numbered = pool.select("skill").distinct().withColumn("i", F.row_number().over(Window.orderBy("skill")) - 1)  # a bounded list of skills
    more = more.crossJoin(F.broadcast(size)).withColumn("i", F.pmod(F.xxhash64("person", "k", F.lit(round_), F.lit(seed)), F.col("_n"))).join(F.broadcast(numbered), "i").select("person", "skill")
    return kept.unionByName(more).distinct()


def wide_means(runs: DataFrame, group: str, value: str, groups: list) -> DataFrame:
    """round, and a column of means for each group."""
    return runs.groupBy("round").pivot(group, groups).agg(F.avg(value))


def sample_rows(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About a share of the rows, the same ones each time."""
    return df.where(uniform(seed, key) < share)


def per_round_means(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Means of each round by group."""
    return runs.groupBy("round", group).agg(F.avg(value).alias("mean"))


def stability(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Per entity over all rounds: mean, population deviation, median and quartiles."""
    v = F.col(value).cast("double")
    return runs.groupBy(key).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.75)).alias("p75"))
