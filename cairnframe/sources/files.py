"""Further files: search exports, bibliographic exports, networks as one JSON document, spreadsheets, logs."""

from __future__ import annotations

import json
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def search_exports(spark: SparkSession, pattern: str, schema: str, url: str) -> DataFrame:
    """CSV files named `... - term.csv`: rows with the terms that found their url, distinct and in order, joined by `|`;
    equal rows are one."""
    rows = spark.read.csv(pattern, schema=schema, header=True).withColumn("_f", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    rows = rows.withColumn("_t", F.trim(F.get(F.split(F.replace("_f", F.lit("%20"), F.lit(" ")), " - "), F.lit(1)))).drop("_f")
    terms = rows.groupBy(F.col(url).alias("_u")).agg(F.array_join(F.array_sort(F.collect_set("_t")), "|").alias("search_terms"))
    return rows.drop("_t").dropDuplicates().join(terms, F.col(url) == F.col("_u")).drop("_u")


#: Characters of a line of a bibliographic export that are kept.
LINE = 131_000


def bibliographic(spark: SparkSession, pattern: str, line: int = LINE) -> DataFrame:
    """Tab-delimited exports as one table: the header of the files once, each line cut at `line` characters; columns by
    the header's names."""
    lines = spark.read.text(pattern).select(F.substring("value", 1, line).alias("value"), F.input_file_name().alias("_f"))
    head = lines.select("value").first()
    names = head[0].lstrip("﻿").split("\t") if head else []
    cells = F.split("value", "\t")
    rows = lines.where(F.regexp_replace("value", "^﻿", "") != F.lit("\t".join(names)))
    return rows.select(*[F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(names)])


def bibliographic_documents(rows: DataFrame, title: str, abstract: str, keywords: str, year: str) -> DataFrame:
    """Rows with an abstract and keywords: keywords lower-cased and joined by `|`, all text, and a date."""
    words = F.array_join(F.filter(F.transform(F.split(F.lower(F.col(keywords)), ";"), lambda k: F.trim(k)), lambda k: k != ""), "|")
    good = rows.where((F.col(abstract) != "") & (F.col(keywords) != ""))
    return good.withColumns({"keywords": words, "alltext": F.concat_ws(" ", title, abstract), "date": F.concat(F.col(year), F.lit("-01-01"))})


def most_cited(documents: DataFrame, year: str, citations: str, key: str, fraction: float) -> DataFrame:
    """The first ceil(fraction * n) documents of each year by citations."""
    from pyspark.sql import Window

    w = Window.partitionBy(year)
    ranked = documents.withColumn("_r", F.row_number().over(w.orderBy(F.desc(citations), key))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") <= F.ceil(F.col("_n") * fraction - 1e-9)).drop("_r", "_n")


def write_network(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """A network as one JSON document {nodes: [...], links: [...]}, one element to a line.  As it is one file, one task
    writes it; larger networks go to `save_network`."""
    spark = nodes.sparkSession
    parts = []
    for name, df in (("nodes", nodes), ("links", links)):
        lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        parts.append((name, lines))
    head = spark.createDataFrame([(0, '{"nodes":[')], "o int, value string")
    out = head.unionByName(parts[0][1].withColumn("o", F.lit(1)).select("o", "value")).unionByName(spark.createDataFrame([(2, '],"links":[')], "o int, value string"))
    out = out.unionByName(parts[1][1].withColumn("o", F.lit(3)).select("o", "value")).unionByName(spark.createDataFrame([(4, "]}")], "o int, value string"))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("o").orderBy("value")) == 1
    rows = out.withColumn("value", F.when(F.col("o").isin(1, 3) & ~first, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")))
    rows.coalesce(1).sortWithinPartitions("o", F.col("value").startswith(","), "value").select("value").write.mode("overwrite").text(path)


def save_network(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    """Nodes and links as two tables of delimited text, written by all tasks."""
    for name, df in (("nodes", nodes), ("links", links)):
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def read_network(spark: SparkSession, path: str, node_schema: str, link_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of such a document; of any {nodes, links} document that is a line an element."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", r"^,|,$", ""))
    rows = lines.where(F.col("value").startswith("{") & F.col("value").endswith("}"))
    is_link = F.get_json_object("value", "$.source").isNotNull()
    parse = lambda df, schema: df.select(F.from_json("value", schema).alias("r")).select("r.*")
    return parse(rows.where(~is_link), node_schema), parse(rows.where(is_link), link_schema)


def read_network_document(spark: SparkSession, path: str, node_schema: str, link_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a {nodes, links} document in any layout, read whole by one task as it is one JSON value."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes array<struct<{_typed(node_schema)}>>, links array<struct<{_typed(link_schema)}>>").alias("d"))
    return doc.select(F.inline("d.nodes")), doc.select(F.inline("d.links"))


def _typed(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind what is there, so that a restart can go on."""
    df.write.mode("append").json(path)


# --- spreadsheets: at most 1,048,576 rows, so one process reads and writes them

#: Rows a sheet can have.
SHEET_ROWS = 1_048_576
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_name(n: int) -> str:
    """Letters of a column from 1."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each table, a header first; texts are texts, also where they look like links."""
    names = list(tables)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
                df = tables[name]
                f.write(_sheet_row(1, df.columns).encode())
                for i, row in enumerate(df.toLocalIterator(), 2):
                    if i > SHEET_ROWS:
                        raise ValueError(f"{name} has more rows than a sheet")
                    f.write(_sheet_row(i, row).encode())
                f.write(b"</sheetData></worksheet>")


def _sheet_row(number: int, values) -> str:
    cells = []
    for k, v in enumerate(values, 1):
        if v is None:
            continue
        at = f"{column_name(k)}{number}"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v if isinstance(v, str) else json.dumps(v, default=str))}</t></is></c>')
        else:
            cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, lists: list[str] | None = None) -> DataFrame:
    """A sheet as a table of texts, the first row as the header; columns in `lists`, or those in which every value holds
    `[`, become lists."""
    from ..functions.arrays import literal_list
    from .tables import list_columns

    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        k = sheet if isinstance(sheet, int) else names.index(sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        rows: list[dict[int, str]] = []
        with z.open(f"xl/worksheets/sheet{k + 1}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells = {}
                for c in row.iter(f"{_NS}c"):
                    at = 0
                    for letter in re.match(r"[A-Z]+", c.get("r"))[0]:
                        at = at * 26 + ord(letter) - 64
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else c.findtext(f"{_NS}v")
                    cells[at - 1] = shared[int(text)] if c.get("t") == "s" else text
                rows.append(cells)
                row.clear()
    names = [rows[0].get(k) or f"column_{k + 1}" for k in range(max(rows[0], default=-1) + 1)] if rows else []
    df = spark.createDataFrame([tuple(r.get(k) for k in range(len(names))) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))
    for c in lists if lists is not None else list_columns(df) if len(rows) > 1 else []:
        df = df.withColumn(c, literal_list(F.col(c)))
    return df


def write_taxonomy(levels: DataFrame, names: list[str], path: str) -> None:
    """A workbook with a sheet for each depth of a taxonomy: the distinct rows of the first levels, under their names."""
    tables = {f"Level {d + 1}": levels.select(*[F.col(f"level{k}").alias(names[k]) for k in range(d + 1)]).where(F.col(names[d]).isNotNull()).distinct().orderBy(*names[: d + 1]) for d in range(len(names))}
    write_sheets(tables, path)
