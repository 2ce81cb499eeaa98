"""Web pages as data: which pages of a site to read, sections of a page, text of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose_pages(links: DataFrame, site: str, path: str, keep: list[str], most: int = 8) -> DataFrame:
    """site, path: links with a part among `keep`; all of one part, and of the deeper ones those that lead nowhere
    deeper, at most `most` under each first part.  Order: how many paths start like it, then the path."""
    rows = links.select(F.col(site).alias("site"), F.regexp_replace(F.col(path), r"^/+|/+$", "").alias("path")).where("path <> ''").distinct()
    rows = rows.withColumn("parts", F.split("path", "/")).where(F.exists("parts", lambda p: F.lower(p).isin(keep)))
    prefixes = rows.select("site", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("path"))
    rows = rows.join(prefixes.groupBy("site", "path").agg(F.count("*").alias("n")), ["site", "path"]).withColumn("top", F.col("parts")[0])
    rank = F.row_number().over(Window.partitionBy("site", "top", F.size("parts") == 1).orderBy(F.desc("n"), "path"))
    return rows.where((F.size("parts") == 1) | (F.col("n") == 1)).withColumn("r", rank).where((F.size("parts") == 1) | (F.col("r") <= most)).select("site", "path", "n")


def sections(elements: Column) -> Column:
    """A page's elements (array<struct<kind, depth, text>>) cut into sections, in one fold: before a Title that follows
    something that is no Title or whose depth decreases, and where a list ends."""
    kind = "array<array<struct<kind:string,depth:int,text:string>>>"

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        before = F.try_element_at(last, F.lit(-1))
        title = (x["kind"] == "Title") & ((before["kind"] != "Title") | (x["depth"] < before["depth"])) & (F.size(last) > 1)
        list_ends = (before["kind"] == "ListItem") & (x["kind"] != "ListItem")
        fresh = last.isNull() | title | list_ends
        return F.when(fresh, F.concat(done, F.array(F.array(x)))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.array(x)))))

    return F.aggregate(elements, F.array().cast(kind), step)


def section_text(section: Column) -> Column:
    """Titles as `#` by depth, list items as `* `, other text as it is; one line each."""
    line = lambda x: F.when(x["kind"] == "Title", F.concat(F.repeat(F.lit("#"), x["depth"] + 1), F.lit(" "), x["text"])).when(x["kind"] == "ListItem", F.concat(F.lit("* "), x["text"])).otherwise(x["text"])
    return F.array_join(F.transform(section, line), "\n")


def markdown_inline(c: Column) -> Column:
    """Strong, emphasis, code and links of a paragraph of Markdown as HTML in a <p>."""
    for pattern, html in ((r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), (r"`(.+?)`", "<code>$1</code>"), (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')):
        c = F.regexp_replace(c, pattern, html)
    return F.concat(F.lit("<p>"), c, F.lit("</p>"))


def number_texts(*columns: Column) -> Column:
    """The texts that are not empty, numbered, with blank lines between."""
    kept = F.filter(F.array(*columns), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n\n")


#: Texts of a page shorter than this fall back to its paragraphs; with section links, the second.
SHORT_TEXT, SHORT_TEXT_LINKS = 500, 1_000


def page_text(html: Column, links: bool = False) -> Column:
    """Text of a page: strong and em marks off, tags as spaces, runs of white space as one; where that is short, the text
    of its p and section elements, if that is longer; `empty` where there is none."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)</?(strong|em|b|i)\b[^>]*>", ""), r"<[^>]*>", " "), r"\s+", " "))
    whole = plain(bare)
    parts = plain(F.array_join(F.regexp_extract_all(bare, F.lit(r"(?is)<(?:p|section)\b[^>]*>(.*?)</(?:p|section)>"), F.lit(1)), " "))
    least = SHORT_TEXT_LINKS if links else SHORT_TEXT
    text = F.when((F.length(whole) < least) & (F.length(parts) > F.length(whole)), parts).otherwise(whole)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty")).otherwise(F.replace(text, F.lit("\u0000"), F.lit("\ufffd")))


def site_pages(pages: DataFrame, url: str, html: str) -> DataFrame:
    """cache_id (`site` or `site/path`), kind (index or page) and text of each page."""
    from ..functions.url import host

    path = F.regexp_replace(F.regexp_extract(F.col(url), r"^[a-zA-Z]+://[^/?#]+/?([^?#]*)", 1), r"/+$", "")
    key = F.when(path == "", host(F.col(url))).otherwise(F.concat(host(F.col(url)), F.lit("/"), path))
    return pages.select(key.alias("cache_id"), F.when(path == "", "index").otherwise("page").alias("kind"), page_text(F.col(html)).alias("text"))


def combined_sites(pages: DataFrame, site: str, text: str, order: str) -> DataFrame:
    """One text for each site: its pages' in order, apart by blank lines."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return pages.where(F.col(text) != "empty").groupBy(site).agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n").alias("text"))


def packed_texts(pages: DataFrame, site: str, order: str, text: str, budget: int, shortest: int = 1, fallback: int = 5_000) -> DataFrame:
    """Per site, pages in order whose words fit a budget together; a page that does not fit is passed over and later ones
    may.  Where none fits, the first page's beginning.  One fold over a site's pages."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), words.alias("n"), F.col(text).alias("t"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit("").alias("t"))

    def step(a: Column, x: Column) -> Column:
        fits = (x["n"] >= shortest) & (a["used"] + x["n"] <= budget)
        joined = F.when(a["kept"] > 0, F.concat(a["t"], F.lit("\n\n"), x["t"])).otherwise(x["t"])
        return F.struct(F.when(fits, a["used"] + x["n"]).otherwise(a["used"]).alias("used"), F.when(fits, a["kept"] + 1).otherwise(a["kept"]).alias("kept"), F.when(fits, joined).otherwise(a["t"]).alias("t"))

    rows = pages.groupBy(site).agg(items.alias("i")).withColumn("f", F.aggregate("i", start, step))
    first = F.substring(F.element_at("i", 1)["t"], 1, fallback)
    return rows.select(site, F.col("f.used").alias("n_words"), F.col("f.kept").alias("n_pages"), F.when(F.col("f.kept") > 0, F.col("f.t")).otherwise(first).alias("text"))


def definitions(html: Column) -> Column:
    """The terms and descriptions of a page's definition lists, as a map of plain texts; of a term twice the first."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    pairs = F.regexp_extract_all(html, F.lit(r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>.*?</dd>"), F.lit(0))
    items = F.transform(pairs, lambda p: F.struct(plain(F.regexp_extract(p, r"(?is)<dt\b[^>]*>(.*?)</dt>", 1)).alias("k"), plain(F.regexp_extract(p, r"(?is)<dd\b[^>]*>(.*?)</dd>", 1)).alias("v")))
    names = F.transform(items, lambda x: x["k"])
    return F.map_from_entries(F.filter(items, lambda x, i: F.array_position(names, x["k"]) == i + 1))
