"""Filters as data: predicates {field, operator, values} and their combination, turned into Column conditions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    values: tuple = ()


@dataclass(frozen=True)
class AllOf:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class AnyOf:
    parts: tuple = field(default_factory=tuple)


def condition(p: Predicate | AllOf | AnyOf) -> Column:
    """The Column condition; an empty AllOf is true and an empty AnyOf false.  Simple comparisons reach the scan."""
    if isinstance(p, AllOf):
        return reduce(lambda a, b: a & b, map(condition, p.parts), F.lit(True))
    if isinstance(p, AnyOf):
        return reduce(lambda a, b: a | b, map(condition, p.parts), F.lit(False))
    c, v = F.col(p.column), p.values
    table = {
        "blank": lambda: c.isNull() | (F.trim(c.cast("string")) == ""),
        "not_blank": lambda: c.isNotNull() & (F.trim(c.cast("string")) != ""),
        "eq": lambda: c == v[0], "not_eq": lambda: c != v[0], "gt": lambda: c > v[0], "gte": lambda: c >= v[0], "lt": lambda: c < v[0], "lte": lambda: c <= v[0],
        "between": lambda: c.between(*v), "includes": lambda: c.isin(*v), "not_includes": lambda: ~c.isin(*v),
        "contains": lambda: F.lower(c).contains(str(v[0]).lower()), "not_contains": lambda: ~F.lower(c).contains(str(v[0]).lower()), "starts": lambda: c.startswith(v[0]),
        "has": lambda: F.array_contains(c, v[0]), "domain_eq": lambda: F.lower(c).rlike(rf"^(?:[a-z]+://)?(?:www\.)?{v[0]}(?:[/?:]|$)"),
    }
    return table[p.operator]()


def without_nulls(value):
    """A nested filter without null members; lists keep their order, and scalars in lists stay."""
    if isinstance(value, dict):
        return {k: w for k, v in value.items() if (w := without_nulls(v)) is not None}
    if isinstance(value, (list, tuple)):
        return [w for v in value if (w := without_nulls(v)) is not None]
    return value
