"""Scalar text functions.  All are Column -> Column and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name spaces of version-5 identifiers (RFC 4122) as hexadecimal.
NAMESPACES = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8"}


def blank_to_null(c: Column) -> Column:
    """Null for null and for text of white space alone."""
    return F.when(F.trim(c) != "", c)


def fill_nodata(c: Column, fill: str = "no data") -> Column:
    """`fill` where the value is null or empty."""
    return F.when(c.isNull() | (c == ""), F.lit(fill)).otherwise(c)


def collapse_spaces(c: Column) -> Column:
    """Line breaks, tabs and runs of white space become one space."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def drop_non_ascii(c: Column) -> Column:
    """Without characters beyond ASCII; then runs of three spaces or more as one."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]", ""), r" {3,}", " ")


def collapse_repeats(c: Column) -> Column:
    """A token of letters, digits and `!:.@#$%^&*()-` that is repeated immediately stands once."""
    return F.regexp_replace(c, r"(?U)(\b[\w!:.@#$%^&*()-]+)(?:\s+\1)+", "$1")


def collapse_same_space(c: Column) -> Column:
    """A run of one and the same white-space character as one."""
    return F.regexp_replace(c, r"([ \t\n\r\f\x0B\x1C-\x1F])\1+", "$1")


def clean_scraped(c: Column, ascii_only: bool = True, repeats: bool = True, spaces: bool = True) -> Column:
    """Text of a scraped page: without characters beyond ASCII, repeated tokens and repeated white space."""
    if ascii_only:
        c = drop_non_ascii(c)
    if repeats:
        c = collapse_repeats(c)
    return collapse_same_space(c) if spaces else c


def length_key(c: Column) -> Column:
    """A sort key: length, then md5."""
    return F.struct(F.length(c).alias("length"), F.md5(c).alias("md5"))


def employee_range(c: Column) -> Column:
    """Range label of an enumerated head count such as `c_00011_00050`; null for null and for what is none."""
    low, high = (F.regexp_extract(c, r"^c_0*(\d+)_(?:0*(\d+)|max)$", k) for k in (1, 2))
    return F.when(low != "", F.when(high != "", F.concat(low, F.lit("-"), high)).otherwise(F.concat(low, F.lit("+"))))


def repeats_itself(c: Column, sizes: tuple[int, ...] = (2,), threshold: float = 0.2) -> Column:
    """Whether the most frequent sequence of one of the sizes covers so large a part of a text; false for shorter texts."""
    out = F.lit(False)
    for n in sizes:
        out = out | (repeated_share(c, n) >= threshold)
    return F.coalesce(out, F.lit(False))


def join_nonmissing(*columns: Column, sep: str = "|") -> Column:
    """Values that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.when(x != "", x) for x in columns])


def sentence_case(c: Column) -> Column:
    """Each sentence with a capital first letter, the rest in lower case."""
    one = F.transform(F.split(c, r"\. "), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2)))))
    return F.array_join(one, ". ")


def drop_codes(c: Column) -> Column:
    """`; `-separated tags without their first word, a code; null where any is unknown."""
    tags = F.split(c, "; ")
    return F.when(~F.lower(c).contains("unknown"), F.array_join(F.transform(tags, lambda t: F.regexp_replace(t, r"^\S+ ", "")), "; "))


def replace_all(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def map_values(c: Column, pairs: dict[str, str]) -> Column:
    """Whole values replaced, in order, so chains apply."""
    for old, new in pairs.items():
        c = F.when(c == old, F.lit(new)).otherwise(c)
    return c


def split_any(c: Column, separators: list[str]) -> Column:
    """Split on any of several literal separators."""
    import re

    return F.split(c, "|".join(map(re.escape, separators)))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words."""
    x, y = F.array_distinct(F.split(F.lower(a), r" +")), F.array_distinct(F.split(F.lower(b), r" +"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def drop_last_word(c: Column, words: list[str]) -> Column:
    """Without the last word where it is one of `words`."""
    return F.when(F.element_at(F.split(c, " "), -1).isin(words), F.regexp_replace(c, r" ?\S+$", "")).otherwise(c)


def first_sentence(c: Column) -> Column:
    return F.regexp_extract(c, r"^([^.]*\.?)", 1)


def uuid5(name: Column, namespace: str = "url") -> Column:
    """Version-5 identifier of a name, by SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACES[namespace])), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def size_band(c: Column) -> Column:
    """Range label of a head count."""
    return F.when(c <= 10, "1-10").when(c <= 50, "11-50").when(c <= 100, "51-100").when(c <= 250, "101-250").when(c <= 500, "251-500").when(c <= 1000, "501-1000").when(c.isNotNull(), "1001+")


def repeated_share(c: Column, n: int) -> Column:
    """Share of a text covered by its most frequent substring of n characters; 0 for shorter texts."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    most = F.aggregate(F.array_sort(grams), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda a: a["best"])
    return F.when(F.length(c) >= n, most * n / F.length(c)).otherwise(F.lit(0.0))
