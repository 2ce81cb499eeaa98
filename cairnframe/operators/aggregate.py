"""Grouped aggregates with the library's rules: null keys drop, sums of nothing are 0, lists are ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def aggregate_tags_text(df: DataFrame, keys: list[str], tags: dict[str, str], sums: dict[str, str], first: dict[str, str], order: str) -> DataFrame:
    """tags: name -> column, joined distinct and sorted by `|`; sums; and the first value that is not null in `order`."""
    aggs = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(n) for n, c in tags.items()]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(n) for n, c in first.items()]
    return _keyed(df, keys).groupBy(*keys).agg(*aggs, F.count("*").alias("n_rows"))


def category_fraction(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """Share of rows whose text matches; null text counts as empty."""
    hit = F.coalesce(F.col(text), F.lit("")).rlike(pattern)
    return _keyed(df, keys).groupBy(*keys).agg(F.avg(hit.cast("int")).alias("frac"), F.count("*").alias("n"))


def percent_value(df: DataFrame, keys: list[str], column: str, value: object) -> DataFrame:
    """100 * share of rows with the value, half to even."""
    return _keyed(df, keys).groupBy(*keys).agg(F.bround(100.0 * F.sum((F.col(column) == F.lit(value)).cast("int")) / F.count("*"), 0).cast("long").alias("pct"))


def relative_fraction(df: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """Share of the value in each group, and (f - g) / (f + g) against the share g overall."""
    hit = (F.col(column) == F.lit(value)).cast("int")
    whole = df.where(F.col(column).isNotNull()).agg(F.avg(hit).alias("g"))
    rows = df.where(F.col(column).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(hit).alias("f")).crossJoin(F.broadcast(whole))
    return rows.select(key, F.col("f").alias("frac"), F.try_divide(F.col("f") - F.col("g"), F.col("f") + F.col("g")).alias("rel_frac"))


def group_share(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """Total of each group and its share of the whole."""
    totals = _keyed(df, [key]).groupBy(key).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
    whole = totals.agg(F.sum("total").alias("_all"))
    return totals.crossJoin(F.broadcast(whole)).select(key, "total", F.try_divide(F.col("total").cast("double"), F.col("_all").cast("double")).alias("share"))


def normalised_totals(df: DataFrame, keys: list[str], within: list[str], value: Column) -> DataFrame:
    """Aggregate by all keys, the total by the keys in `within`, and their ratio; partial sums once."""
    rows = _keyed(df, keys).groupBy(*keys).agg(value.alias("aggregated_value"))
    total = F.sum("aggregated_value").over(Window.partitionBy(*within))
    return rows.withColumn("totals", total).withColumn("normalized_value", F.try_divide(F.col("aggregated_value").cast("double"), F.col("totals").cast("double")))


def pivot_counts(df: DataFrame, key: str, column: Column, values: list) -> DataFrame:
    """One count column for each value; missing counts are 0."""
    wide = df.withColumn("_p", column).groupBy(key).pivot("_p", values).count()
    return wide.na.fill(0, [str(v) for v in values])


def multi_level(df: DataFrame, entity: str, levels: list[str], thing: str, amount: Column) -> DataFrame:
    """Grouping sets: for the entity alone and with every combination of levels, count, distinct things and sum.

    Rows are summed by entity, all levels and thing first; only these sums are repeated for each set, and a thing is
    counted where its sums of a set have met, so nothing is made distinct twice."""
    from itertools import combinations

    names = [entity, *levels]
    base = df.withColumn("_a", amount).groupBy(*names, thing).agg(F.count("*").alias("_n"), F.sum("_a").alias("_s"))
    kinds = {f.name: f.dataType for f in df.schema}
    sets = []
    for n in range(len(levels) + 1):
        for chosen in combinations(levels, n):
            gid = sum(1 << (len(levels) - 1 - k) for k, x in enumerate(levels) if x not in chosen)
            sets.append(F.struct(F.lit(gid).cast("long").alias("gid"), *[(F.col(x) if x in chosen else F.lit(None).cast(kinds[x])).alias(x) for x in levels]))
    rows = base.select(entity, thing, "_n", "_s", F.explode(F.array(*sets)).alias("_g")).select(entity, thing, "_n", "_s", "_g.*")
    things = rows.groupBy("gid", *names, thing).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return things.groupBy(*names, "gid").agg(F.sum("_n").alias("n"), F.count(thing).alias("n_things"), F.sum("_s").alias("total"))


def transformed(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with the sum, mean and count of its group on each row; the group's sums are made first and joined."""
    own = df.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias("group_sum"), F.avg(value).alias("group_mean"), F.count(value).alias("group_count"))
    return df.join(own, df[key] == own["_k"], "left").drop("_k")


def merged_weights(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """Weighted tags (arrays of struct<tag, wt>) of a group: as they are for a group of one row; else summed by tag and
    divided by their total; largest first, ties by tag."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    rows = df.select(*keys, F.inline(tags)).groupBy(*keys, "tag").agg(F.sum("wt").alias("wt")).join(size, keys)
    total = F.sum("wt").over(Window.partitionBy(*keys))
    rows = rows.withColumn("wt", F.when(F.col("_rows") == 1, F.col("wt")).otherwise(F.col("wt") / total))
    order = F.array_sort(F.collect_list(F.struct((-F.col("wt")).alias("n"), "tag")))
    return rows.groupBy(*keys).agg(order.alias("_t")).select(*keys, F.transform("_t", lambda x: F.struct(x["tag"].alias("tag"), (-x["n"]).alias("wt"))).alias("tags"))


def subset_ratios(df: DataFrame, key: str, subset: Column, amounts: dict[str, Column], weighted: bool = True) -> DataFrame:
    """Per entity and amount: the subset's part of the total, and (if weighted) that part times ln(total); null where
    the total is 0."""
    aggs = [F.sum(F.when(subset, a).otherwise(0)).alias(f"{n}_subset") for n, a in amounts.items()] + [F.sum(a).alias(f"{n}_total") for n, a in amounts.items()]
    out = df.groupBy(key).agg(*aggs)
    for n in amounts:
        part = F.try_divide(F.col(f"{n}_subset").cast("double"), F.col(f"{n}_total").cast("double"))
        out = out.withColumn(f"{n}_ratio", part)
        if weighted:
            out = out.withColumn(f"{n}_weighted", part * F.when(F.col(f"{n}_total") > 0, F.log(F.col(f"{n}_total").cast("double"))))
    return out


def metrics(df: DataFrame, keys: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean, population deviation, median and two percentiles (linear interpolation)."""
    v = F.col(value)
    return _keyed(df, keys).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(low)).alias("p_low"), F.percentile(v, F.lit(high)).alias("p_high")
    )


def min_year(df: DataFrame, key: str, date: str) -> DataFrame:
    return _keyed(df, [key]).groupBy(key).agg(F.min(F.year(date)).alias("first_year"))
