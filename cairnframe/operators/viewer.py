"""Documents of the network viewer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(df: DataFrame, key: str, label: str, attributes: list[str], lists: list[str] | None = None, markdown: list[str] | None = None, plain: list[str] | None = None) -> DataFrame:
    """id, title and a JSON text of the attributes; null becomes ''.  Attributes in `lists` are texts joined by `|` and
    become lists; those in `markdown` (texts that are no lists) are rendered unless they are also in `plain`."""
    from .pages import markdown_inline

    def value(a: str) -> Column:
        text = F.coalesce(F.col(a).cast("string"), F.lit(""))
        if a in (lists or []):
            return F.filter(F.split(text, r"\|"), lambda x: x != "")
        return F.when(text != "", markdown_inline(text)).otherwise("") if a in (markdown or []) and a not in (plain or []) else text

    attr = F.to_json(F.struct(*[value(a).alias(a) for a in attributes]))
    return df.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(label).cast("string"), F.col(key).cast("string"), F.lit("Node")).alias("title"), attr.alias("attr"))


def links(df: DataFrame, source: str, target: str, attributes: list[str]) -> DataFrame:
    """id (from source and target), ends, and a JSON text of the other columns."""
    attr = F.to_json(F.struct(*[F.col(a).cast("string").alias(a) for a in attributes]))
    return df.select(F.concat_ws("-", source, target).alias("id"), F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), attr.alias("attr"))


def orphan_links(edges: DataFrame, node_ids: DataFrame, key: str) -> DataFrame:
    """Links with an end that is no node."""
    ids = node_ids.select(F.col(key).alias("_k")).distinct()
    good = edges.join(ids, edges["u"] == ids["_k"], "left_semi").join(ids, edges["v"] == ids["_k"], "left_semi")
    return edges.join(good.select("u", "v").distinct(), ["u", "v"], "left_anti")


def attribute_types(df: DataFrame, separator: str = "|") -> DataFrame:
    """attribute, type, n_distinct, n_null: year, timestamp, integer or float for numbers; liststring or string for text.
    All attributes are profiled in one pass."""
    numeric = {f.name for f in df.schema if f.dataType.simpleString() in ("int", "bigint", "double", "float", "smallint", "tinyint") or f.dataType.simpleString().startswith("decimal")}
    aggs: list[Column] = []
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        if f.name in numeric:
            lo, hi, whole = F.min(c.cast("double")), F.max(c.cast("double")), F.min((F.floor(c) == c).cast("int"))
            kind = F.when(whole == 1, F.when((lo >= 1800) & (hi <= 2100), "year").when((lo >= 1e9) & (hi <= 9999999999), "timestamp").otherwise("integer")).otherwise("float")
        else:
            kind = F.when(F.max(F.coalesce(c.cast("string").contains(separator), F.lit(False)).cast("int")) == 1, "liststring").otherwise("string")
        aggs += [kind.alias(f"k{k}"), F.approx_count_distinct(c).alias(f"d{k}"), F.sum(c.isNull().cast("int")).alias(f"n{k}")]
    one = df.agg(*aggs)
    return reduce(DataFrame.unionByName, [one.select(F.lit(f.name).alias("attribute"), F.col(f"k{k}").alias("type"), F.col(f"n{k}").cast("long").alias("n_null")) for k, f in enumerate(df.schema)])


def page_links(pages: DataFrame, html: str, url: str) -> DataFrame:
    """Internal relative paths of a page's links: start with `/`, not `//`, without file extensions other than html."""
    refs = F.expr(f"regexp_extract_all({html}, 'href=\"([^\"]*)\"', 1)")
    rows = pages.select(url, F.explode(F.array_distinct(refs)).alias("path"))
    return rows.where(F.col("path").rlike(r"^/[^/]") & ~F.col("path").rlike(r"\.(?!html?$)[A-Za-z0-9]{2,4}$"))


def missing_attributes(df: DataFrame, layout: list[str]) -> list[str]:
    """Attributes a layout names that the table lacks."""
    return [a for a in layout if a not in df.columns]


def render_types(df: DataFrame, columns: list[str], separator: str = "|") -> DataFrame:
    """attribute, n_values, render: by how many distinct values a text attribute has after it is split: `text` above 100,
    `wordcloud` above 80, `tag-cloud_3` above 60, `tag-cloud_2` above 40, else `tag-cloud`."""
    each = [df.select(F.lit(c).alias("attribute"), F.explode(F.split(F.col(c), f"[{separator}]")).alias("v")) for c in columns]
    counts = reduce(DataFrame.unionByName, each).where("v <> ''").distinct().groupBy("attribute").agg(F.count("*").alias("n_values"))
    n = F.col("n_values")
    return counts.withColumn("render", F.when(n > 100, "text").when(n > 80, "wordcloud").when(n > 60, "tag-cloud_3").when(n > 40, "tag-cloud_2").otherwise("tag-cloud"))


#: Column names that are likely to hold a node's label or image.
LABELS = ("label", "name", "title", "organization", "profile_name")
IMAGES = ("image_url", "profile_image", "logo_url", "image", "logo")


def chosen_attributes(df: DataFrame, exclude: list[str] | None = None) -> dict[str, str | None]:
    """Columns for a node's label and image by name; for its size the numeric column with fewest nulls; for its colour
    the text column with fewest distinct values (two at least), then fewest nulls.  One pass over the table."""
    lower = {c.lower(): c for c in df.columns}
    pick = lambda names: next((lower[n] for n in names if n in lower), None)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name not in (exclude or [])}
    numbers = [c for c, k in kinds.items() if k in ("int", "bigint", "double", "float") or k.startswith("decimal")]
    texts = [c for c, k in kinds.items() if k == "string" and c not in (pick(LABELS), pick(IMAGES))]
    row = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in numbers + texts], *[F.approx_count_distinct(c).alias(f"d_{c}") for c in texts]).first()
    several = [c for c in texts if (row[f"d_{c}"] or 0) >= 2]
    return {
        "label": pick(LABELS), "image": pick(IMAGES), "size": min(numbers, key=lambda c: (row[f"n_{c}"] or 0, c), default=None),
        "color": min(several, key=lambda c: (row[f"d_{c}"], row[f"n_{c}"] or 0, c), default=None),
    }


def settings(snapshots: list[dict], player: dict, types: DataFrame, known: list[str]) -> dict:
    """The viewer's settings: player values over the defaults, snapshots, and an entry for each attribute; unknown player
    values are an error."""
    wrong = [k for k in player if k not in known]
    if wrong:
        raise ValueError(f"unknown settings: {', '.join(wrong)}")
    attributes = {r["attribute"]: {"type": r["type"]} for r in types.collect()}  # one row a column
    return {"player": player, "snapshots": snapshots, "attributes": attributes}


def with_head(page: str, tracker: str = "", meta: dict[str, str] | None = None) -> str:
    """An HTML page with a tracker's script and OpenGraph tags before the end of its head."""
    import html

    tags = "".join(f'<meta property="og:{k}" content="{html.escape(v, quote=True)}">' for k, v in (meta or {}).items())
    script = f'<script async src="https://www.googletagmanager.com/gtag/js?id={html.escape(tracker, quote=True)}"></script>' if tracker else ""
    return page.replace("</head>", f"{tags}{script}</head>", 1)


def sponsors(names: list[str], table: dict[str, tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(name, icon, url) of sponsors in the order given; unknown names go."""
    return [(n, *table[n]) for n in names if n in table]
