"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(c: Column) -> Column:
    """Host without scheme, `www.` and port, lower-cased."""
    return F.regexp_replace(F.regexp_extract(F.lower(c), r"^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)", 1), r"^www\.", "")


def normalise(c: Column) -> Column:
    """https, lower-cased, without query, fragment, `www.` and the last slash."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z]+://(?:www\.)?|[?#].*$|/+$", "")
    return F.concat(F.lit("https://"), F.regexp_replace(bare, r"/+$", ""))


def site_key(c: Column) -> Column:
    """A key for file names: what stands after the scheme and before the query, without one last slash, with `/` and `:`
    as `_`."""
    after = F.when(c.contains("//"), F.element_at(F.split(c, "//"), 2)).otherwise(c)
    return F.translate(F.regexp_replace(F.trim(F.regexp_extract(F.trim(after), r"^([^?]*)", 1)), r"/$", ""), "/:", "__")


def cache_key(c: Column) -> Column:
    """A key of a whole address: after the scheme and `www.`, without last slashes, with `/`, `?`, `=` and `:` as `_`."""
    return F.translate(F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://", ""), r"^www\.|/+$", ""), "/?=:", "____")


def host_key(c: Column) -> Column:
    """The host of a site key, without `www.`."""
    return F.regexp_replace(F.regexp_extract(site_key(c), r"^([^_]*)", 1), r"^www\.", "")


#: Hosts of social networks.
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "twitter.com", "x.com", "youtube.com")


def clean_url(c: Column, home: Column | None = None, drop_social: bool = False, home_only: bool = False) -> Column:
    """https, lower-cased unless it names a pdf, relative paths joined to `home`; null for hosts of social networks if
    they are dropped; the home page alone if only that is asked for."""
    x = F.trim(c)
    if home is not None:
        x = F.when(x.startswith("/"), full_url(home, x)).otherwise(x)
    x = F.when(~F.lower(x).rlike(r"^https?://"), F.concat(F.lit("https://"), x)).otherwise(F.regexp_replace(x, r"^(?i)http://", "https://"))
    x = F.when(F.lower(x).endswith(".pdf"), x).otherwise(F.lower(x))
    if home_only:
        x = F.regexp_extract(x, r"^(https://[^/?#]+)", 1)
    return F.when(~host(x).isin(*SOCIAL), x) if drop_social else x


def last_segment(c: Column) -> Column:
    """Last part of the path, without query; empty if there is no path."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", ""), r"^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]*)$", 1)


def path_slug(c: Column) -> Column:
    """Path and query with every run of other characters as `_`; null where the path holds `www`."""
    path = F.regexp_replace(c, r"^[a-zA-Z]+://[^/]+/?", "")
    return F.when(~path.contains("www"), F.regexp_replace(path, r"[^A-Za-z0-9]+", "_"))


def full_url(site: Column, path: Column) -> Column:
    """Site and path joined by exactly one slash."""
    return F.concat(F.regexp_replace(site, r"/+$", ""), F.lit("/"), F.regexp_replace(path, r"^/+", ""))
