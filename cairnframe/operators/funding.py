"""Funding rounds: sequences, intervals, flags, survival, fractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_sequence(rounds: DataFrame, key: str, date: str, kind: str, tie: str) -> DataFrame:
    """Per organisation: types and dates of rounds in order of date."""
    items = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(tie).alias("t"), F.col(kind).alias("k"))))
    rows = rounds.groupBy(key).agg(items.alias("i"))
    return rows.select(key, F.transform("i", lambda x: x["k"]).alias("kinds"), F.transform("i", lambda x: x["d"]).alias("dates"))


def interval_stats(rounds: DataFrame, key: str, date: str, tie: str, least: int = 3) -> DataFrame:
    """Days between consecutive rounds: mean, median, smallest, largest and sample deviation, for organisations with at
    least `least` rounds."""
    w = Window.partitionBy(key).orderBy(date, tie)
    gaps = rounds.withColumn("gap", F.datediff(F.col(date), F.lag(date).over(w)))
    return (
        gaps.groupBy(key)
        .agg(F.count("*").alias("n_rounds"), F.avg("gap").alias("mean_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.stddev_samp("gap").alias("std_gap"))
        .where(F.col("n_rounds") >= least)
    )


def outlier_limit(stats: DataFrame, column: str) -> DataFrame:
    """Q1, Q3, the range between, and Q3 + 1.5 times it."""
    q = stats.agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    return q.select("q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("limit"))


def path_flags(sequences: DataFrame, key: str, kinds: str, grants: list[str], loans: list[str], ventures: list[str]) -> DataFrame:
    """A fold over the rounds in order: grant or loan before the first venture round, and after it."""
    start = F.struct(*[F.lit(False).alias(n) for n in ("venture", "grant_before", "grant_after", "loan_before", "loan_after")])

    def step(a: Column, k: Column) -> Column:
        grant, loan = k.isin(grants), k.isin(loans)
        return F.struct(
            (a["venture"] | k.isin(ventures)).alias("venture"), (a["grant_before"] | (grant & ~a["venture"])).alias("grant_before"), (a["grant_after"] | (grant & a["venture"])).alias("grant_after"),
            (a["loan_before"] | (loan & ~a["venture"])).alias("loan_before"), (a["loan_after"] | (loan & a["venture"])).alias("loan_after"),
        )

    return sequences.select(key, F.aggregate(kinds, start, step).alias("f")).select(key, "f.*")


def funnel(df: DataFrame, keys: list[str], stages: dict[str, tuple[Column, Column]]) -> DataFrame:
    """stages: name -> (succeeded, failed).  Failure rates failed / (failed + succeeded) and the chained survival."""
    aggs = []
    for name, (good, bad) in stages.items():
        aggs += [F.sum(good.cast("int")).alias(f"{name}_ok"), F.sum(bad.cast("int")).alias(f"{name}_failed")]
    out = (df.groupBy(*keys) if keys else df).agg(*aggs)
    survival = F.lit(1.0)
    for name in stages:
        rate = F.try_divide(F.col(f"{name}_failed").cast("double"), (F.col(f"{name}_ok") + F.col(f"{name}_failed")).cast("double"))
        out = out.withColumn(f"{name}_rate", rate)
        survival = survival * (1 - F.col(f"{name}_rate"))
    return out.withColumn("survival", survival)


def equal_fractions(mapping: DataFrame, key: str) -> DataFrame:
    """Each of an entity's rows gets an equal part."""
    return mapping.withColumn("fraction", F.lit(1.0) / F.count("*").over(Window.partitionBy(key)))


def most_specific(mapping: DataFrame, key: str, levels: list[str]) -> DataFrame:
    """Fractions in which rows covered by a more specific row of the same entity get 0, and the others are renormalised.

    A row is covered where another row of the entity has the same values at all its filled levels and more of them.
    """
    out = mapping.withColumn("depth", sum((F.col(c).isNotNull().cast("int") for c in levels), F.lit(0)))
    for d in range(1, len(levels)):
        w = Window.partitionBy(key, *levels[:d])
        deeper = F.max("depth").over(w) > d
        out = out.withColumn(f"_c{d}", (F.col("depth") == d) & deeper)
    covered = F.lit(False)
    for d in range(1, len(levels)):
        covered = covered | F.col(f"_c{d}")
    raw = F.when(covered, 0.0).otherwise(1.0)
    out = out.withColumn("_r", raw)
    return out.withColumn("fraction", F.try_divide(F.col("_r"), F.sum("_r").over(Window.partitionBy(key)))).drop("_r", *[f"_c{d}" for d in range(1, len(levels))])


def spread_parents(mapping: DataFrame, key: str, parent: str, child: str, amount: str, taxonomy: DataFrame) -> DataFrame:
    """Amounts mapped to a parent alone are spread evenly over its children in the taxonomy (parent, child)."""
    kids = taxonomy.groupBy(parent).agg(F.array_sort(F.collect_set(child)).alias("_kids"))
    known = mapping.where(F.col(child).isNotNull()).select(key, parent, child, F.col(amount).cast("double").alias(amount))
    loose = mapping.where(F.col(child).isNull()).join(kids, parent).select(key, parent, F.explode("_kids").alias(child), (F.col(amount) / F.size("_kids")).alias(amount))
    return known.unionByName(loose).groupBy(key, parent, child).agg(F.sum(amount).alias(amount))


#: Ranges of hashes that a permutation's rows are summed by before one range is sorted.
RANGES = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutation_test(df: DataFrame, label: str, outcome: Column, key: str, rounds: int, seed: int, ratio: bool = False) -> DataFrame:
    """Observed difference (or ratio) of mean outcome between labels, and its place among seeded permutations of the
    label.

    A permutation gives each row a hash of (key, round, seed); as many rows as have the label, those with the smallest
    hashes, get it.  Rows are not multiplied by the rounds: tasks sum counts and outcomes by (round, range of hashes);
    only rows of the one range in which the label ends are sorted.
    """
    base = df.select(F.xxhash64(key).alias("h"), F.col(label).cast("int").alias("y"), outcome.cast("double").alias("v"))
    stat = base.agg(F.sum("y").alias("m"), F.count("*").alias("n"), F.sum("v").alias("t"), F.sum(F.when(F.col("y") == 1, F.col("v"))).alias("a")).first()
    m, n, total, own = int(stat["m"] or 0), int(stat["n"]), float(stat["t"] or 0), float(stat["a"] or 0)
    salt = [_mixed(np.array([r * 0x9E3779B97F4A7C15 + seed & (2**64 - 1)], np.uint64))[0] for r in range(1, rounds + 1)]
    shift = np.uint64(64 - (RANGES - 1).bit_length())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, values = np.zeros((rounds, RANGES), np.int64), np.zeros((rounds, RANGES))
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for r in range(rounds):
                at = (_mixed(h ^ salt[r]) >> shift).astype(np.int64)
                counts[r] += np.bincount(at, minlength=RANGES)
                values[r] += np.bincount(at, v, RANGES)
        r, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(b), pa.array(counts[r, b]), pa.array(values[r, b])], names=["r", "b", "c", "s"])

    per = base.select("h", "v").mapInArrow(sums, "r long, b long, c long, s double").groupBy("r", "b").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    before = Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cut = per.withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("s0", F.coalesce(F.sum("s").over(before), F.lit(0.0))).where((F.col("c0") < m) & (F.col("c0") + F.col("c") >= m))
    found = {x["r"]: (x["b"], x["c0"], x["s0"]) for x in cut.select("r", "b", "c0", "s0").collect()}  # one row a round

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for r, (b, _, _) in found.items():
                x = _mixed(h ^ salt[r])
                at = np.flatnonzero((x >> shift).astype(np.int64) == b)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r)), pa.array((x[at] >> np.uint64(1)).astype(np.int64)), pa.array(h[at].view(np.int64)), pa.array(v[at])], names=["r", "x", "h", "v"])

    need = F.create_map(*[F.lit(x) for r, (_, c0, _) in found.items() for x in (r, m - c0)]) if found else F.create_map(F.lit(0), F.lit(0))
    ranked = base.select("h", "v").mapInArrow(edge, "r long, x long, h long, v double").withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy("x", "h")))
    last = {x["r"]: x["s"] for x in ranked.where(F.col("i") <= F.try_element_at(need, F.col("r").cast("int"))).groupBy("r").agg(F.sum("v").alias("s")).collect()}
    compare = (lambda a: a / m / ((total - a) / (n - m))) if ratio else (lambda a: a / m - (total - a) / (n - m))
    spark = df.sparkSession
    if not 0 < m < n:
        return spark.createDataFrame([(None, None, rounds)], "observed double, p_value double, rounds long")
    observed = compare(own)
    higher = sum(compare(s0 + last.get(r, 0.0)) >= observed for r, (_, _, s0) in found.items())
    return spark.createDataFrame([(observed, higher / rounds, rounds)], "observed double, p_value double, rounds long")


#: Stages of funding in order; those from `ipo` on are an exit.
STAGES = (
    "grant equity_crowdfunding initial_coin_offering angel pre_seed seed series_a series_b series_c series_d series_e series_f series_g series_h series_i series_j"
    " ipo post_ipo_equity post_ipo_debt post_ipo_secondary"
).split()


def outcome(types: Column, exited: Column, acquired: Column, closed: Column, days: Column, stage: str, outlier: int, stages: list[str] | None = None, late: str = "series_b", acquired_from: str = "series_a") -> tuple[Column, Column]:
    """(succeeded, failed) of an organisation at a stage.

    The stage `late` means all from it to the exit.  It succeeded with a round of a later stage, an exit, or if it was
    acquired with a round of acquired_from or later; it failed if its last rounds stop at the stage, it did not succeed,
    and it is closed or its last round is more than `outlier` days ago.
    """
    order = stages or STAGES
    exit_at = order.index("ipo") if "ipo" in order else len(order)
    if stage == "late":
        focal, later = order[order.index(late) : exit_at], order[exit_at:]
    elif stage == "seed":
        focal, later = order[: order.index("seed") + 1], order[order.index("seed") + 1 :]
    else:
        focal, later = [stage], order[order.index(stage) + 1 :]
    has = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names))) if names else F.lit(False)
    good = F.coalesce(has(later) | exited | (acquired & has(order[order.index(acquired_from) :])), F.lit(False))
    bad = F.coalesce(has(focal) & ~good & (closed | (days > outlier)), F.lit(False))
    return good, bad


def expected_survival(df: DataFrame, stage_flags: dict[str, tuple[Column, Column]], n_seed: Column, n_a: Column) -> DataFrame:
    """Failure rates of seed, a and late, chained into the organisations expected to survive each: of those at seed, of
    these and those at a, and of these the late stage; and the share of all."""
    aggs = [F.sum(c.cast("int")).alias(f"{n}_{k}") for n, (good, bad) in stage_flags.items() for k, c in (("ok", good), ("failed", bad))]
    out = df.agg(*aggs, F.sum(n_seed.cast("int")).alias("n_seed"), F.sum(n_a.cast("int")).alias("n_a"))
    rate = lambda n: F.try_divide(F.col(f"{n}_failed").cast("double"), (F.col(f"{n}_failed") + F.col(f"{n}_ok")).cast("double"))
    out = out.select("n_seed", "n_a", (F.col("n_seed") + F.col("n_a")).alias("n_total"), *[rate(n).alias(f"{n}_failure_rate") for n in ("seed", "a", "late")])
    out = out.withColumn("expected_seed", (1 - F.col("seed_failure_rate")) * F.col("n_seed"))
    out = out.withColumn("expected_a", (1 - F.col("a_failure_rate")) * (F.col("n_a") + F.col("expected_seed")))
    out = out.withColumn("expected_late", (1 - F.col("late_failure_rate")) * F.col("expected_a"))
    return out.withColumn("overall", F.try_divide(F.col("expected_late"), F.col("n_total").cast("double")))


def by_year(rounds: DataFrame, orgs: DataFrame, key: str, org: str, date: str, amount: Column, years: list[int]) -> DataFrame:
    """orgs with a column of the amount raised in each year; 0 where nothing, null for organisations without rounds."""
    own = rounds.groupBy(F.col(key).alias("_k")).agg(*[F.coalesce(F.sum(F.when(F.year(date) == y, amount)), F.lit(0)).alias(f"raised_{y}") for y in years])
    return orgs.join(own, orgs[org] == own["_k"], "left").drop("_k")


def spread_by_funding(mapping: DataFrame, key: str, parent: str, child: str, amount: str, groups: list[str]) -> DataFrame:
    """Amounts mapped to a parent alone are spread over its children in proportion to what is mapped to them, within the
    groups (kinds of funding); evenly where nothing is."""
    known = mapping.where(F.col(child).isNotNull())
    seen = known.groupBy(parent, child, *groups).agg(F.sum(amount).alias("_s"))
    part = F.sum("_s").over(Window.partitionBy(parent, *groups))
    n = F.count("*").over(Window.partitionBy(parent, *groups))
    share = seen.withColumn("_f", F.when(part > 0, F.col("_s") / part).otherwise(1.0 / n)).select(parent, *groups, F.col(child).alias("_child"), "_f")
    loose = mapping.where(F.col(child).isNull()).join(share, [parent, *groups])
    rows = known.select(key, parent, child, *groups, F.col(amount).cast("double").alias(amount)).unionByName(loose.select(key, parent, F.col("_child").alias(child), *groups, (F.col(amount) * F.col("_f")).alias(amount)))
    return rows.groupBy(key, parent, child, *groups).agg(F.sum(amount).alias(amount))


def leaf_rows(mapping: DataFrame, key: str, levels: list[str]) -> DataFrame:
    """An entity's most specific branches: a row goes where another row of the entity begins with its filled levels and
    goes deeper; equal rows are one."""
    rows = mapping.dropDuplicates([key, *levels])
    rows = rows.withColumn("_d", sum((F.col(c).isNotNull().cast("int") for c in levels), F.lit(0)))
    covered = F.lit(False)
    for d in range(1, len(levels)):
        covered = covered | ((F.col("_d") == d) & (F.max("_d").over(Window.partitionBy(key, *levels[:d])) > d))
    return rows.withColumn("_c", covered).where(~F.col("_c")).drop("_c", "_d")


def run_statistics(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Per key over all runs: mean, sample deviation, median and quartiles."""
    q = lambda p, n: F.percentile(value, F.lit(p)).alias(n)
    return runs.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), q(0.5, "median"), q(0.25, "p25"), q(0.75, "p75"))
