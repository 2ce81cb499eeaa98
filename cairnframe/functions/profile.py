"""Profile and record functions: network ids, reply parsing, dated collections, rule chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def profile_url(c: Column) -> Column:
    """Canonical profile address: lower-cased, no query, https and www., one company part, a slash at the end."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"\?.*$", "")
    x = F.regexp_replace(x, r"^(?:https?://)?(?:[a-z]{2,3}\.)?linkedin", "https://www.linkedin")
    x = F.regexp_replace(F.regexp_replace(x, r"(company/)+", "company/"), r"/(?:about|mycompany)(?:/.*)?$", "/")
    return F.when(x != "", F.concat(F.regexp_replace(x, r"/+$", ""), F.lit("/")))


def profile_id(c: Column) -> Column:
    """Last path segment of a profile address."""
    x = F.regexp_replace(F.regexp_replace(c, r"\?.*$", ""), r"/about.*$|/+$", "")
    return F.regexp_extract(F.regexp_replace(x, r"/+$", ""), r"([^/]+)$", 1)


def parse_reply(c: Column, schema: str) -> Column:
    """JSON in a reply of a model: code fences off, a comma before the end repaired; null where it is no JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-z]*\s*|\s*```$", ""), r",\s*([}\]])", "$1")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def talks_of_itself(c: Column) -> Column:
    """Replies such as "I am unable to ..."."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(r"^\s*(?:i am|i'm|as an ai|i cannot|i can't)\b")


def longer(a: Column, b: Column) -> Column:
    """The longer of two texts, the first of equals; null counts as no text."""
    return F.when(F.coalesce(F.length(b), F.lit(0)) > F.coalesce(F.length(a), F.lit(0)), b).otherwise(a)


def newest_per(c: Column, keys: list[str], created: str = "created") -> Column:
    """A collection in order of creation, latest first, with the oldest of each key where the key first stands."""
    ordered = F.array_sort(c, lambda a, b: F.when(a[created] > b[created], -1).when(a[created] < b[created], 1).otherwise(0))
    key = lambda x: F.concat_ws("\u0001", *[F.coalesce(x[k].cast("string"), F.lit("\u0002")) for k in keys])
    names = F.transform(ordered, key)
    oldest = lambda x: F.element_at(F.filter(ordered, lambda y: key(y) == key(x)), -1)
    return F.transform(F.filter(ordered, lambda x, i: F.array_position(names, key(x)) == i + 1), oldest)


def first_year(c: Column, fieldname: str) -> Column:
    """Smallest year 1900-2099 in a text field of a collection."""
    years = F.filter(F.transform(c, lambda x: F.regexp_extract(F.coalesce(x[fieldname], F.lit("")), r"\b((?:19|20)\d\d)\b", 1)), lambda y: y != "")
    return F.array_min(F.transform(years, lambda y: y.cast("int")))


def funding_kind(types: Column, grants: list[str], ventures: list[str]) -> Column:
    """Ordered rules on the set of round types: none, philanthropy (only grants), venture (only those), mixed, other."""
    g, v = F.array(*map(F.lit, grants)), F.array(*map(F.lit, ventures))
    only = lambda s: F.size(F.array_except(types, s)) == 0
    return (
        F.when(F.coalesce(F.size(types), F.lit(0)) == 0, "none").when(only(g), "philanthropy").when(only(v), "venture")
        .when(F.arrays_overlap(types, g) & F.arrays_overlap(types, v), "mixed").otherwise("other")
    )


def place(city: Column, state: Column, country: Column, home: str = "United States") -> Column:
    """City, state (at home only) and country, without blanks and repeats, joined by a comma."""
    return F.array_join(F.array_distinct(F.filter(F.array(city, F.when(country == home, state), country), lambda x: x.isNotNull() & (x != ""))), ", ")
