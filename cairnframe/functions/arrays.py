"""Functions on lists, tag lists and weighted tag lists (arrays of struct<tag, wt>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def literal_list(c: Column) -> Column:
    """A list written as text, with single or double quotes; null and empty text give an empty list."""
    parsed = F.from_json(F.translate(c, "'", '"'), "array<string>")
    return F.coalesce(F.when(F.trim(c) != "", parsed), F.array().cast("array<string>"))


def clean_tags(c: Column, separator: str = r"\|") -> Column:
    """Trimmed, not empty, distinct and in order."""
    parts = F.transform(F.split(c, separator), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def rename_tags(c: Column, names: dict[str, str]) -> Column:
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(c, lambda t: F.coalesce(F.try_element_at(table, F.trim(t)), t))


def remove_tags(c: Column, blacklist: list[str]) -> Column:
    return F.filter(c, lambda t: ~t.isin(blacklist))


def add_related(c: Column, related: dict[str, list[str]], depth: int = 3) -> Column:
    """Related tags added, then theirs, up to `depth` times, so that cycles end."""
    if not related:
        return c
    table = F.create_map(*[x for k, v in related.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    for _ in range(depth):
        c = F.array_distinct(F.concat(c, F.flatten(F.transform(c, lambda t: F.coalesce(F.try_element_at(table, t), none)))))
    return c


def sort_weighted(c: Column) -> Column:
    """By weight, largest first; ties by tag."""
    return F.array_sort(c, lambda a, b: F.when(a["wt"] > b["wt"], -1).when(a["wt"] < b["wt"], 1).when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).otherwise(0))


def renormalise(c: Column) -> Column:
    """Weights divided by their sum."""
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x["wt"])
    return F.transform(c, lambda x: F.struct(x["tag"].alias("tag"), F.try_divide(x["wt"], total).alias("wt")))


def remove_weighted(c: Column, blacklist: list[str]) -> Column:
    return renormalise(F.filter(c, lambda x: ~x["tag"].isin(blacklist)))


def threshold_weighted(c: Column, relative: float = 0.1, at_least: int = 10) -> Column:
    """Weights above `relative` of the largest, and always the first `at_least`."""
    ordered = sort_weighted(c)
    return F.filter(ordered, lambda x, i: (i < at_least) | (x["wt"] > relative * ordered[0]["wt"]))


def pluck(c: Column, field: str) -> Column:
    """One field of each element that is not null."""
    return F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: x[field])


def dedupe_by(c: Column, field: str) -> Column:
    """Elements with the first occurrence of each value of a field."""
    return F.filter(c, lambda x, i: F.array_position(F.transform(c, lambda y: y[field]), x[field]) == i + 1)
