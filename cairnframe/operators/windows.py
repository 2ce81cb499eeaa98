"""Analytic functions over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_difference(df: DataFrame, column: str) -> DataFrame:
    """(x - mean) / (x + mean), to 4 places; one row of statistics is broadcast instead of one task windowing all rows."""
    stat = df.agg(F.avg(column).alias("_m"))
    return df.crossJoin(F.broadcast(stat)).withColumn("norm_diff", F.bround(F.try_divide(F.col(column) - F.col("_m"), F.col(column) + F.col("_m")), 4)).drop("_m")


def min_max(df: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    stat = df.agg(F.min(column).cast("double").alias("_a"), F.max(column).cast("double").alias("_b"))
    return df.crossJoin(F.broadcast(stat)).withColumn(name, F.try_divide(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def max_rank_percentile(df: DataFrame, column: str, name: str = "pct", buckets: int = 200) -> DataFrame:
    """100 * (largest rank among equals - 1) / (rows - 1).

    Rows are not brought to one task: distinct values are counted, put into buckets between approximate quantiles (a
    short list, broadcast), summed within each bucket, and offset by the buckets before.
    """
    rows = df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    bounds = rows.agg(F.percentile_approx(column, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(1000)).alias("_q"))
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("_p", F.size(F.filter("_q", lambda q: q < F.col("_v")))).drop("_q")
    inner = placed.withColumn("_s", F.sum("_c").over(Window.partitionBy("_p").orderBy("_v")))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_p").agg(F.sum("_c").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).select("_p", "_before")
    total = counts.agg(F.sum("_c").alias("_n"))
    ranks = inner.join(F.broadcast(before), "_p").crossJoin(F.broadcast(total))
    ranks = ranks.select("_v", (F.lit(100.0) * (F.col("_s") + F.col("_before") - 1) / F.nullif(F.col("_n") - 1, F.lit(0))).alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def zscore_in_group(df: DataFrame, key: str, column: str) -> DataFrame:
    """(x - mean) / population deviation in the group; x itself where the deviation is 0."""
    stat = df.groupBy(key).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.when(F.col("_s") == 0, F.col(column)).otherwise((F.col(column) - F.col("_m")) / F.col("_s"))
    return df.join(stat, key).withColumn("z", z).drop("_m", "_s")


def position_in_group(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def top_n(df: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def cumulative_share(df: DataFrame, key: str, amount: str, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(key)
    up = F.sum(amount).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cum_share", F.try_divide(up, F.sum(amount).over(w)))


def fill_forward(df: DataFrame, key: str, column: str, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def pack_budget(df: DataFrame, key: str, order: str, size: str, budget: int, stop: bool = False) -> DataFrame:
    """Rows of each group taken in order while they fit a budget.  With stop, the first that does not fit ends it;
    without, later smaller rows may still fit.  A fold over the group's sizes, which depends on the order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["s"] <= budget) & ~(a["over"] & F.lit(stop))
        return F.struct(F.when(fits, a["used"] + x["s"]).otherwise(a["used"]).alias("used"), (a["over"] | ~fits).alias("over"), F.when(fits, F.concat(a["kept"], F.array(x["o"]))).otherwise(a["kept"]).alias("kept"))

    packed = rows.select(key, F.aggregate("rows", start, step).alias("p"))
    return packed.select(key, F.size("p.kept").alias("n_kept"), F.col("p.used").alias("used"), F.col("p.kept").alias("kept"))
