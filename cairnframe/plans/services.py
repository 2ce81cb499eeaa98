"""Services, files, viewer documents and pages over the test tables.  A service is a function that answers from a table
of the test data, as a vendor would from its own."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import models, pages, services, viewer
from ..sources import files, tables
from ..sources.shared import keep, new_path
from ..sources.tables import parquet
from .registry import query


def _records(df) -> list[dict]:
    """A small dimension as records, as a service holds them."""
    return [r.asDict() for r in df.orderBy(df.columns[0]).limit(1_000).collect()]


@query("SELECT n_nationkey, n_name FROM nation")
def offset_pages(spark, d):
    rows = _records(parquet(spark, d, "nation").select("n_nationkey", "n_name"))
    return services.offset_pages(spark, lambda at, n: (rows[at : at + n], len(rows)), "n_nationkey int, n_name string", 7)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def keyset_pages(spark, d):
    rows = _records(parquet(spark, d, "nation").select("n_nationkey", "n_name"))
    fetch = lambda after, n: [r for r in rows if after is None or r["n_nationkey"] > after][:n]
    return services.keyset_pages(spark, fetch, "n_nationkey", "n_nationkey int, n_name string", 6, 20, 8, keep)


@query("SELECT DISTINCT n_nationkey, n_name FROM nation JOIN customer ON n_nationkey = c_nationkey")
def chunked_lookup(spark, d):
    rows = {r["n_nationkey"]: r for r in _records(parquet(spark, d, "nation").select("n_nationkey", "n_name"))}
    values = parquet(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return services.in_chunks(values, "n_nationkey", lambda own: [rows[k] for k in own if k in rows], "n_nationkey int, n_name string", 5)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cached' ELSE 'fresh' END || s_suppkey AS detail FROM supplier")
def read_through(spark, d):
    ids = parquet(spark, d, "supplier").select("s_suppkey")
    cache = ids.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("cached"), F.col("s_suppkey").cast("string")).alias("detail"))
    return services.read_through(ids, "s_suppkey", cache, lambda own: [{"s_suppkey": k, "detail": f"fresh{k}"} for k in own], "s_suppkey long, detail string")[0]


@query("SELECT 'n' || n_nationkey AS name, 'r' || n_regionkey AS parent, 2 AS depth FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root', 1 FROM region")
def tree_of(spark, d):
    kids: dict = {"root": []}
    for r in _records(parquet(spark, d, "region")):
        kids["root"].append({"name": f"r{r['r_regionkey']}"})
    for r in _records(parquet(spark, d, "nation")):
        kids.setdefault(f"r{r['n_regionkey']}", []).append({"name": f"n{r['n_nationkey']}"})
    found = services.tree_of(lambda k: kids.get(k, []), "root", "name")
    return spark.createDataFrame([(r["name"], r["parent"], r["depth"]) for r in found], "name string, parent string, depth int")


_CACHE = "SELECT doc_id, md5(text) AS text_id, CASE WHEN doc_id % 5 <> 0 THEN 'old' END AS response, (doc_id % 3)::INT AS num_errors FROM documents WHERE doc_id % 2 = 0"


def _cached(spark, d):
    rows = parquet(spark, d, "documents").select("doc_id", "text")
    cache = rows.where("doc_id % 2 = 0").select("doc_id", F.md5("text").alias("text_id"), F.when(F.col("doc_id") % 5 != 0, "old").alias("response"), (F.col("doc_id") % 3).cast("int").alias("num_errors"))

    def call(t: str) -> str:
        if len(t) % 7 == 0:
            raise ValueError("no answer")
        return f"new {len(t)}"

    return services.cached_results(rows, cache, "doc_id", "text", call, 2)


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 5 <> 0 THEN 'old' ELSE 'new ' || length(text) END AS response FROM documents d WHERE (d.doc_id % 2 = 0 AND d.doc_id % 5 <> 0) OR ((d.doc_id % 2 = 1 OR d.doc_id % 3 < 2) AND length(text) % 7 <> 0)")
def cached_answers(spark, d):
    return _cached(spark, d)[0]


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'old' WHEN (doc_id % 2 = 1 OR doc_id % 3 < 2) AND length(text) % 7 <> 0 THEN 'new ' || length(text) END AS response, (CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE 0 END + CASE WHEN NOT (doc_id % 2 = 0 AND doc_id % 5 <> 0) AND (doc_id % 2 = 1 OR doc_id % 3 < 2) AND length(text) % 7 = 0 THEN 1 ELSE 0 END)::INT AS num_errors FROM documents")
def cached_store(spark, d):
    return _cached(spark, d)[1].select("doc_id", "response", "num_errors")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= DATE '1998-10-03' - 90")
def still_valid(spark, d):
    return services.still_valid(parquet(spark, d, "orders"), "o_orderdate", F.lit("1998-10-03").cast("date"), 90).select("o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT role AS prompt FROM conversations UNION SELECT 'kept'")
def prompt_registry(spark, d):
    old = spark.createDataFrame([("x", "kept")], "id string, prompt string")
    prompts = parquet(spark, d, "conversations").select(F.col("role").alias("prompt"))
    once = services.prompt_registry(prompts, old)
    return services.prompt_registry(prompts, once).select("prompt")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'done' ELSE 'run' END AS state FROM labels")
def resume_chunks(spark, d):
    l = parquet(spark, d, "labels")
    done = l.where("quality = 1").select("doc_id", F.lit("done").alias("state"))
    return services.resume(l.select("doc_id"), done, "doc_id", lambda rows: rows.select("doc_id", F.lit("run").alias("state")))


# --- model steps


@query("SELECT conv_id, string_agg('Description ' || i || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn % 2 = 0) GROUP BY conv_id")
def numbered_texts(spark, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" ").alias("t")))), lambda x: x["t"])
    return parquet(spark, d, "conversations").groupBy("conv_id").agg(items.alias("l")).select("conv_id", models.numbered(F.col("l")).alias("prompt"))


@query("WITH p AS (SELECT s_suppkey AS e, r_name AS category FROM supplier, region), g AS (SELECT * FROM p WHERE (length('Category: ' || category || chr(10) || 'def' || chr(10) || 'Text: ' || e || chr(10) || 'Answer:') + e) % 3 = 0), l AS (SELECT e FROM p GROUP BY e HAVING e NOT IN (SELECT e FROM g)) SELECT e, category FROM g UNION ALL SELECT e, 'parent' FROM l")
def fewshot_filter(spark, d):
    s, r = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("e"), F.col("s_suppkey").cast("string").alias("t")), parquet(spark, d, "region").select(F.col("r_name").alias("category"))
    pairs = models.pair_prompts(s.crossJoin(F.broadcast(r)).withColumn("def", F.lit("def")), "t", "category", "def").select("e", "category", "prompt")
    cache = spark.createDataFrame([], "pair string, text_id string, response string, num_errors int")
    call = lambda p: "Yes." if (len(p) + int(p.split("Text: ")[1].split("\n")[0])) % 3 == 0 else "no"
    return models.fewshot_filter(pairs, "e", "category", "prompt", cache, call, s.select("e", F.lit("parent").alias("category")))[0]


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'manual' WHEN quality = 1 THEN '1' ELSE '0' END AS label, CASE WHEN doc_id % 10 = 0 THEN 1.0 ELSE round(exp(-0.5::DOUBLE), 9) END::DOUBLE AS probability FROM labels WHERE toxic = 0 OR doc_id % 10 = 0")
def valid_predictions(spark, d):
    l = parquet(spark, d, "labels")
    answers = l.select("doc_id", F.when(F.col("toxic") == 1, "maybe").otherwise(F.col("quality").cast("string")).alias("response"), F.lit(-0.5).alias("logprob"))
    manual = l.where("doc_id % 10 = 0").select("doc_id", F.lit("manual").alias("label"))
    return models.predictions(answers, "doc_id", ["0", "1"], manual)[0].withColumn("probability", F.round("probability", 9))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::BIGINT AS chunk FROM orders")
def chunk_numbers(spark, d):
    return models.chunk_numbers(parquet(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("SELECT c_custkey, c_mktsegment || CASE WHEN c_nationkey <> 3 THEN '|nation' || c_nationkey ELSE '' END AS tags FROM customer")
def geotags(spark, d):
    c = parquet(spark, d, "customer")
    second = F.when(F.col("c_nationkey") != 3, F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))).otherwise("")
    reply = F.concat(F.lit('```json\n{"locations": [{"metadatas": [{"entity": "'), "c_mktsegment", F.lit('"}, {"entity": "'), second, F.lit('"}]},]}\n```'))
    return models.geotags(c.select("c_custkey", reply.alias("response")), "c_custkey").withColumn("tags", F.array_join("tags", "|"))


@query("SELECT c_custkey, c_nationkey::DOUBLE AS lat, 2.0 * c_nationkey::DOUBLE AS lon, 'NATION_' || c_nationkey AS country FROM customer")
def geocoded(spark, d):
    rows = parquet(spark, d, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("address"))
    cache = spark.createDataFrame([], "address_key string, text_id string, response string, num_errors int")
    call = lambda a: '{"lat": %s, "lon": %s, "country": "%s"}' % (a[7:], 2 * int(a[7:]), a)  # noqa: E731, UP031
    return models.geocoded(rows, "address", cache, call)[0].drop("address")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (props::JSON ->> 'k')::INT END AS k, CASE WHEN event_id % 2 = 1 THEN 'no ' || event_type END AS text FROM events")
def reply_or_text(spark, d):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("no "), "event_type"))
    parsed, bare = models.reply_or_text(reply, "k int")
    return parquet(spark, d, "events").select("event_id", parsed["k"].alias("k"), bare.alias("text"))


@query("WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice * p_size DESC, p_partkey) AS i FROM part) SELECT p_brand, string_agg('Description ' || i || chr(10) || p_name, chr(10) || chr(10) ORDER BY i) AS prompt FROM r WHERE i <= 5 GROUP BY p_brand")
def central_texts(spark, d):
    return models.central_texts(parquet(spark, d, "part"), "p_brand", "p_name", "p_retailprice", "p_partkey", 5, "p_size")


@query()
def org_types(spark, d):
    rows = parquet(spark, d, "documents").join(parquet(spark, d, "labels"), "doc_id").withColumn("fr", (F.col("lang") == "fr").cast("int"))
    fitted = models.OrgTypes("text", "fr", ["source"]).fit(rows)
    return fitted.predict(rows, "doc_id", F.length("text") < 5, F.lit(False))


# --- files


@query("SELECT n_nationkey, n_name FROM nation")
def delimited_utf16(spark, d):
    path = new_path(spark)
    parquet(spark, d, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value")).coalesce(1).write.option("encoding", "UTF-16").option("header", "true").csv(path, sep="\u0001", quote="")
    return tables.delimited(spark, path, "n_nationkey string, n_name string", "|", "UTF-16")[0].select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def json_records(spark, d):
    path = new_path(spark)
    tables.write_json(parquet(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return tables.records(spark, path, "c_custkey long, c_name string, c_nationkey int")


@query("SELECT c_nationkey, c_custkey FROM customer")
def partitioned_write(spark, d):
    path = new_path(spark)
    tables.write_partitioned(parquet(spark, d, "customer").select("c_nationkey", "c_custkey"), path, ["c_nationkey"], 100)
    return spark.read.parquet(path).select("c_nationkey", "c_custkey")


@query("SELECT s_suppkey, max(v)::INT AS v FROM (SELECT s_suppkey, 1 AS v FROM supplier UNION ALL SELECT s_suppkey, 2 FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY s_suppkey")
def appended_log(spark, d):
    path = new_path(spark)
    s = parquet(spark, d, "supplier")
    files.append_lines(s.select("s_suppkey", F.lit(1).alias("v")), path)
    files.append_lines(s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(2).alias("v")), path)
    return tables.last_predictions(tables.records(spark, path, "s_suppkey long, v int"), "s_suppkey", "v")


@query("SELECT n_name AS url, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'energy|water' ELSE 'water' END AS search_terms FROM nation")
def search_exports(spark, d):
    path = new_path(spark)
    n = parquet(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("url"), "n_regionkey")
    for term, rows in (("water", n), ("energy", n.where("n_nationkey % 2 = 0"))):
        folder = f"{path}/{term}"
        rows.drop("n_nationkey").coalesce(1).write.csv(folder, header=True)
        _rename(spark, folder, f"{path}/export - {term}.csv")
    return files.search_exports(spark, f"{path}/export*.csv", "url string, n_regionkey int", "url")


def _rename(spark, folder: str, to: str) -> None:
    """The one part file of a folder under a name of its own, in whatever file system the folder is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(to))


@query("SELECT n_nationkey::VARCHAR AS id, lower(n_name) || '|r' || n_regionkey AS keywords, 'Title ' || n_name || ' Abstract' AS alltext, '2001-01-01' AS date FROM nation WHERE n_nationkey % 4 > 0")
def bibliographic(spark, d):
    path = new_path(spark)
    n = parquet(spark, d, "nation")
    lines = n.select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.concat(F.lit("Title "), "n_name"), F.when(F.col("n_nationkey") % 4 > 0, "Abstract").otherwise(""), F.concat(F.col("n_name"), F.lit("; R"), F.col("n_regionkey").cast("string")), F.lit("2001")).alias("value"))
    for k in range(2):
        head = spark.createDataFrame([("UT\tTI\tAB\tDE\tPY",)], "value string")
        head.unionByName(lines.where(F.length("value") % 2 == k)).coalesce(1).write.text(f"{path}/part{k}")
    rows = files.bibliographic(spark, f"{path}/part*")
    return files.bibliographic_documents(rows, "TI", "AB", "DE", "PY").select(F.col("UT").alias("id"), "keywords", "alltext", "date")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER (PARTITION BY year(o_orderdate)) * 0.1 - 1e-9)")
def most_cited(spark, d):
    o = parquet(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return files.most_cited(o, "year", "o_totalprice", "o_orderkey", 0.1).select("o_orderkey")


@query("SELECT n_name AS id, n_regionkey AS region, (SELECT count(*) FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey)::BIGINT AS n_links FROM nation")
def network_document(spark, d):
    path = new_path(spark)
    n = parquet(spark, d, "nation")
    nodes = n.select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("region"))
    m = n.select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("k"), "n_regionkey")
    links = n.join(m, "n_regionkey").where("n_nationkey < k").select(F.col("n_name").alias("source"), "target")
    files.write_network(nodes, links, path)
    got, edges = files.read_network(spark, path, "id string, region int", "source string, target string")
    whole, _ = files.read_network_document(spark, path, "id string, region int", "source string, target string")
    return got.join(whole, ["id", "region"]).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_links"))))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sheet_rows(spark, d):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # a workbook is made and read by the driver alone
        path = os.path.join(folder, "book.xlsx")
        files.write_sheets({"Nodes": parquet(spark, d, "nation"), "Regions": parquet(spark, d, "region")}, path)
        nodes, regions = files.read_sheet(spark, path, "Nodes"), files.read_sheet(spark, path, 1)
    return nodes.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part WHERE p_size = 1")
def sheet_lists(spark, d):
    import tempfile

    p = parquet(spark, d, "part").where("p_size = 1").select("p_partkey", F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']")).alias("words"))
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "book.xlsx")
        files.write_sheets({"Parts": p}, path)
        return files.read_sheet(spark, path).select("p_partkey", F.array_join("words", " ").alias("p_name"))


# --- viewer and pages


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, '{\"words\":[\"' || replace(p_name, ' ', '\",\"') || '\"],\"note\":\"<p><strong>' || p_brand || '</strong></p>\",\"raw\":\"**' || p_type || '**\"}' AS attr FROM part")
def viewer_markdown(spark, d):
    p = parquet(spark, d, "part").withColumns({"words": F.replace("p_name", F.lit(" "), F.lit("|")), "note": F.concat(F.lit("**"), "p_brand", F.lit("**")), "raw": F.concat(F.lit("**"), "p_type", F.lit("**"))})
    return viewer.nodes(p, "p_partkey", "p_name", ["words", "note", "raw"], ["words"], ["note", "raw"], ["raw"])


@query("WITH v AS (SELECT 'p_brand' AS attribute, p_brand AS v FROM part UNION SELECT 'p_type', p_type FROM part UNION SELECT 'words', unnest(string_split(p_name, ' ')) FROM part UNION SELECT 'p_name', p_name FROM part) SELECT attribute, count(*) AS n_values, CASE WHEN count(*) > 100 THEN 'text' WHEN count(*) > 80 THEN 'wordcloud' WHEN count(*) > 60 THEN 'tag-cloud_3' WHEN count(*) > 40 THEN 'tag-cloud_2' ELSE 'tag-cloud' END AS render FROM v GROUP BY attribute")
def render_types(spark, d):
    p = parquet(spark, d, "part").withColumn("words", F.replace("p_name", F.lit(" "), F.lit("|")))
    return viewer.render_types(p, ["p_brand", "p_type", "words", "p_name"])


@query("SELECT * FROM (VALUES ('label', 'p_name'), ('image', NULL), ('size', 'p_partkey'), ('color', 'p_type')) t(what, attribute)")
def chosen_attributes(spark, d):
    p = parquet(spark, d, "part").withColumnRenamed("p_name", "Name").withColumn("p_size", F.when(F.col("p_size") > 1, F.col("p_size")))
    got = viewer.chosen_attributes(p, ["p_retailprice"])
    got["label"] = "p_name" if got["label"] == "Name" else got["label"]
    return spark.createDataFrame(list(got.items()), "what string, attribute string")


_PATH = "regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/?([^?#]*)', 1), '/+$', '')"
_HOST = "regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)', 1), '^www\\.', '')"


def _plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '</?(strong|em|b|i)\\b[^>]*>', '', 'gi'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


@query(f"WITH p AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || '<i>id</i>' || page_id, '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<head\\b.*?</head\\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs') AS h FROM pages), x AS (SELECT url, {_plain('h')} AS whole, {_plain(chr(34) + 'parts' + chr(34))} AS parts FROM (SELECT url, h, coalesce(array_to_string(regexp_extract_all(h, '(?is)<(?:p|section)\\b[^>]*>(.*?)</(?:p|section)>', 1), ' '), '') AS parts FROM p)) SELECT CASE WHEN {_PATH} = '' THEN {_HOST} ELSE {_HOST} || '/' || {_PATH} END AS cache_id, CASE WHEN {_PATH} = '' THEN 'index' ELSE 'page' END AS kind, CASE WHEN length(whole) < 500 AND length(parts) > length(whole) THEN parts ELSE whole END AS text FROM x")
def site_pages(spark, d):
    p = parquet(spark, d, "pages")
    return pages.site_pages(p.withColumn("html", F.concat("html", F.lit("<i>id</i>"), F.col("page_id").cast("string"))), "url", "html")


@query("SELECT host AS site, string_agg(page_id::VARCHAR, chr(10) || chr(10) ORDER BY page_id) AS text FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id FROM pages WHERE page_id % 5 > 0) GROUP BY host")
def combined_sites(spark, d):
    p = parquet(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("site"), "page_id", F.when(F.col("page_id") % 5 > 0, F.col("page_id").cast("string")).otherwise("empty").alias("t"))
    return pages.combined_sites(p, "site", "t", "page_id")


@query()
def packed_texts(spark, d):
    return pages.packed_texts(parquet(spark, d, "conversations"), "conv_id", "turn", "text", 120, 5)


@query("SELECT doc_id, [length(text)::DOUBLE, (doc_id * 0)::DOUBLE + 1] AS vector FROM documents WHERE length(text) % 11 > 0")
def embedded_texts(spark, d):
    def call(t: str) -> list[float]:
        if len(t) % 11 == 0:
            raise ValueError("no vector")
        return [float(len(t)), 1.0]

    cache = spark.createDataFrame([], "id string, text_id string, response string, num_errors int")
    return services.embedded(parquet(spark, d, "documents"), "doc_id", "text", cache, call)[0]


@query("SELECT n_name, CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR END AS n_regionkey FROM nation")
def sheet_service(spark, d):
    sent = services.sheet_rows(parquet(spark, d, "nation").orderBy("n_name").select("n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey")), True)
    return services.sheet_values(spark, lambda: sent)


@query("SELECT s_suppkey, 'name=' || s_name || ';nation=' || s_nationkey AS fields FROM supplier")
def page_definitions(spark, d):
    s = parquet(spark, d, "supplier")
    html = F.concat(F.lit("<dl class='core'><dt>name</dt> <dd><b>"), "s_name", F.lit("</b></dd><dt>nation</dt><dd> "), F.col("s_nationkey").cast("string"), F.lit("</dd><dt>name</dt><dd>twice</dd></dl>"))
    fields = pages.definitions(html)
    return s.select("s_suppkey", F.concat(F.lit("name="), fields["name"], F.lit(";nation="), fields["nation"]).alias("fields"))


@query("SELECT conv_id, CASE WHEN n % 5 > 0 THEN 'S' || n ELSE 'first' END AS summary FROM (SELECT conv_id, sum(length('Description ' || i || chr(10) || t)) + 2 * (count(*) - 1) AS n FROM (SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn < 2) GROUP BY conv_id)")
def text_summaries(spark, d):
    def call(p: str) -> str:
        if len(p) % 5 == 0:
            raise ValueError("no summary")
        return f"S{len(p)}"

    c = parquet(spark, d, "conversations").groupBy("conv_id").pivot("turn", [0, 1]).agg(F.first("text")).toDF("conv_id", "a", "b").withColumn("f", F.lit("first"))
    cache = spark.createDataFrame([], "conv_id long, text_id string, response string, num_errors int")
    return models.summaries(c, "conv_id", ["a", "b"], cache, call, "f")[0].select("conv_id", "summary")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE upper(source) END AS source, CASE WHEN lang = 'en' THEN lang ELSE upper(lang) END AS lang2 FROM documents")
def translated_columns(spark, d):
    rows = parquet(spark, d, "documents").select("doc_id", "lang", "source", F.col("lang").alias("lang2"))
    cache = spark.createDataFrame([], "id string, text_id string, response string, num_errors int")
    return models.translated(rows, "doc_id", ["source", "lang2"], "lang", cache, str.upper)[0].drop("lang")


@query("SELECT count(*) AS n, count(DISTINCT level1) AS nations FROM (SELECT 'r' || n_regionkey AS level0, 'n' || n_nationkey AS level1 FROM nation)")
def taxonomy_workbook(spark, d):
    import tempfile

    levels = parquet(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("level0"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("level1"))
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "book.xlsx")
        files.write_taxonomy(levels, ["Region", "Nation"], path)
        back = files.read_sheet(spark, path, "Level 2")
    return back.agg(F.count("*").alias("n"), F.countDistinct("Nation").alias("nations"))
