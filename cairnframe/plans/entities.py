"""Organisations, people, funding and tags over the test tables: customers stand for organisations, orders for funding
rounds, suppliers for investors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, profile, text
from ..operators import aggregate, entities, funding, hierarchy, simulate, tags, taxonomy
from ..sources.tables import parquet
from .queries import _TREE, _centroids, _levels, _tree
from .registry import money, query

# --- tags and keywords

_GRAMS = "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[`=~!@#$%^&*()_+\\[\\]{};\\\\:\"<,.|>?]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM conversations)".replace("%^&*", "%^*")


@query(_GRAMS + ", g AS (SELECT conv_id, turn, unnest(w) AS ngram FROM w UNION ALL SELECT conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM w), k AS (SELECT conv_id, turn, ngram, count(*) AS n FROM g WHERE ngram NOT IN ('the', 'of', 'and', 'in') GROUP BY ALL) SELECT conv_id, turn, ngram, n, round(n / sum(n) OVER (PARTITION BY conv_id, turn), 9)::DOUBLE AS weight FROM k")
def text_ngrams(spark, d):
    c = parquet(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return tags.text_ngrams(c, "key", F.col("text"), 2, ["the", "of", "and", "in"]).select("key.conv_id", "key.turn", "ngram", "n", F.round("weight", 9).alias("weight"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name || ' / ' || lower(p_type), ' ') AS w FROM part), g AS (SELECT p_partkey, unnest(w) AS ngram FROM w UNION ALL SELECT p_partkey, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM w), k AS (SELECT p_partkey, ngram, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT p_partkey, ngram, n / sum(n) OVER (PARTITION BY p_partkey) AS weight FROM k), t(term, tag) AS (VALUES ('red', 'colour'), ('blue', 'colour'), ('small ring', 'jewel'), ('ring', 'jewel'), ('economy', 'cheap')), m AS (SELECT p_partkey, tag, sum(weight) AS wt FROM c JOIN t ON ngram = term WHERE tag <> 'cheap' GROUP BY ALL) SELECT part.p_partkey, coalesce(string_agg(tag || '=' || round(wt, 6)::VARCHAR, '|' ORDER BY wt DESC, tag), '') AS tags FROM part LEFT JOIN m USING (p_partkey) GROUP BY part.p_partkey")
def keyword_tags(spark, d):
    rows = [("red", ["colour"], None), ("blue", ["colour"], None), ("small ring", ["jewel"], None), ("ring", ["jewel"], None), ("economy", ["cheap"], None)]
    dictionary = spark.createDataFrame(rows, "term string, tags array<string>, related array<string>")
    got = tags.keyword_tags(parquet(spark, d, "part").withColumn("x", F.lit(None).cast("string")), "p_partkey", ["p_name", "x", "p_type"], dictionary, ["cheap"], 2)
    return got.select("p_partkey", F.array_join(F.transform("tags", lambda t: F.concat(t["tag"], F.lit("="), F.round(t["wt"], 6).cast("string"))), "|").alias("tags"))


@query("WITH k AS (SELECT lower(w) AS keyword FROM (SELECT unnest(string_split(p_name, ' ') || [p_name]) AS w FROM part)), m AS (SELECT keyword FROM k WHERE length(keyword) >= 3 AND keyword <> 'red' GROUP BY keyword HAVING count(*) >= 20 UNION SELECT 'economy'), t AS (SELECT doc, unnest(g) AS keyword FROM (SELECT p_partkey AS doc, string_split(p_name, ' ') || [p_name, lower(p_type)] AS g FROM part)) SELECT DISTINCT doc AS p_partkey, keyword FROM t JOIN m USING (keyword)")
def found_keywords(spark, d):
    p = parquet(spark, d, "part")
    master = tags.master_keywords(p.select(F.concat(F.split("p_name", " "), F.array("p_name")).alias("k")), "k", ["red"], ["Economy"], 20)
    return tags.found_keywords(p, "p_partkey", F.concat_ws(" and, ", "p_name", "p_type"), master, 3, True)


@query("WITH m AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || [p_name]) AS keyword FROM part) SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ') || [p_name]) AS keyword FROM part")
def sub_phrases(spark, d):
    p = parquet(spark, d, "part")
    master = p.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_name"))).alias("keyword")).distinct()
    return tags.sub_phrases(p.select("p_partkey", F.col("p_name").alias("keyword")), "p_partkey", master)


@query("WITH r AS (SELECT DISTINCT p_brand, lower(trim(unnest(string_split(p_name, ' ')))) AS t FROM part WHERE p_size < 20) SELECT t, string_agg(p_brand, '|' ORDER BY p_brand) AS groups FROM r GROUP BY t HAVING count(*) > 1")
def terms_in_groups(spark, d):
    m = parquet(spark, d, "part").where("p_size < 20").select("p_brand", F.split("p_name", " ").alias("terms"))
    return tags.regrouped_terms(m, "terms", "p_brand")[1].withColumn("groups", F.array_join("groups", "|"))


@query("WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || [p_name, p_name || ' ' || lower(p_type)]) AS tag FROM part), w AS (SELECT tag, string_split(tag, ' ') AS w FROM t) SELECT tag, 'unigram' AS kind FROM w WHERE len(w) = 1 AND tag IN (SELECT unnest(w) FROM w WHERE len(w) > 1) UNION ALL SELECT tag, 'bigram' FROM w WHERE len(w) = 2 AND tag IN (SELECT unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) FROM w WHERE len(w) = 3)")
def parts_of_tags(spark, d):
    rows = parquet(spark, d, "part").select(F.explode(F.concat(F.split("p_name", " "), F.array(F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_type"))))).alias("tag"))
    return tags.parts_of_tags(rows, "tag")


@query("WITH k AS (SELECT p_brand, p_name AS k, count(*) AS i FROM part GROUP BY ALL), o AS (SELECT k FROM k GROUP BY k HAVING count(*) <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY i DESC, k) AS r FROM k WHERE k IN (SELECT k FROM o)) SELECT p_brand, string_agg(k, '|' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY p_brand")
def distinctive_keywords(spark, d):
    k = parquet(spark, d, "part").groupBy("p_brand", F.col("p_name").alias("k")).agg(F.count("*").alias("i"))
    return tags.distinctive_keywords(k, "p_brand", "k", "i", 5, 20).withColumn("keywords", F.array_join("keywords", "|"))


@query("WITH s AS (SELECT DISTINCT l_suppkey AS person, lower(p_name) AS skill, p_name FROM lineitem JOIN part ON l_partkey = p_partkey), i AS (SELECT skill, 1 + ln((SELECT count(DISTINCT person) FROM s) / count(*) + 1) AS idf FROM s GROUP BY skill), r AS (SELECT person, skill, string_split(skill, ' ')[2] AS parent, starts_with(skill, 'r')::INT AS relevant, idf FROM s JOIN i USING (skill)), p AS (SELECT person, parent, count(*) AS c FROM r GROUP BY ALL), t AS (SELECT person, parent FROM p QUALIFY row_number() OVER (PARTITION BY person ORDER BY c DESC, parent) = 1) SELECT person, count(*) AS n, sum(relevant)::BIGINT AS n_relevant, round(sum(idf), 6)::DOUBLE AS w, round(sum(idf * relevant), 6)::DOUBLE AS w_relevant, any_value(t.parent) AS top_parent, round(sum(relevant) / count(*), 9)::DOUBLE AS ratio, round(sum(idf * relevant) / sum(idf), 9)::DOUBLE AS weighted_ratio, sum(relevant) / count(*) > 0.13 AS relevant FROM r JOIN t USING (person) GROUP BY person")
def skill_relevance(spark, d):
    rows = parquet(spark, d, "lineitem").join(parquet(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name").distinct()
    lists = rows.groupBy("l_suppkey").agg(F.collect_set(F.lower("p_name")).alias("s"))
    idf = tags.term_idf(lists, "s").select(F.col("term").alias("skill"), "idf")
    skills = rows.select(F.lower("p_name").alias("skill")).distinct().select("skill", F.element_at(F.split("skill", " "), 2).alias("parent"), F.col("skill").startswith("r").cast("int").alias("relevant"))
    got = tags.skill_scores(rows, "l_suppkey", "p_name", skills, idf, 0.13)
    return got.withColumns({c: F.round(c, 6 if c in ("w", "w_relevant") else 9) for c in ("w", "w_relevant", "ratio", "weighted_ratio")})


@query("SELECT p_partkey, array_to_string(list_filter(list_sort(list_distinct(string_split(p_name, ' '))), lambda t: t NOT IN ('red', 'blue')), '|') AS tags FROM part")
def tag_blacklist(spark, d):
    return parquet(spark, d, "part").select("p_partkey", F.array_join(arrays.remove_tags(arrays.clean_tags(F.col("p_name"), " "), ["red", "blue"]), "|").alias("tags"))


# --- merges, children and lookups

_KINDS = "list_sort(list_distinct(list(o_orderpriority)))"


@query(f"WITH p AS (SELECT o_custkey AS k, {_KINDS} AS kinds, max(o_orderpriority) AS c_name, CASE min(o_orderstatus) WHEN 'F' THEN 'finished' ELSE min(o_orderstatus) END AS state FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN p.c_name ELSE customer.c_name END AS c_name, array_to_string(list_sort(list_distinct([c_mktsegment] || coalesce(kinds, []))), '|') AS kinds, state FROM customer LEFT JOIN p ON c_custkey = k")
def merge_profiles(spark, d):
    c = parquet(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("c_custkey") % 2 == 0, "")).otherwise(F.col("c_name")).alias("c_name"), F.array("c_mktsegment").alias("kinds"))
    p = parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("kinds"), F.max("o_orderpriority").alias("c_name"), F.min("o_orderstatus").alias("state"))
    return entities.merge_profiles(c, p, "c_custkey", ["c_name"], ["kinds"], {"state": {"F": "finished"}}).withColumn("kinds", F.array_join("kinds", "|"))


@query("WITH b AS (SELECT c_nationkey AS k, c_mktsegment AS kind, c_acctbal AS a, NULL AS b, 0 AS s, c_custkey AS i FROM customer UNION ALL SELECT s_nationkey, 'SUPPLY', NULL, s_acctbal, 1, s_suppkey FROM supplier) SELECT k, CASE kind WHEN 'BUILDING' THEN 'houses' ELSE kind END AS kind, a, b FROM b QUALIFY row_number() OVER (PARTITION BY k, CASE kind WHEN 'BUILDING' THEN 'houses' ELSE kind END ORDER BY s, i) = 1")
def combine_sources(spark, d):
    a = parquet(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("a"), F.col("c_custkey").alias("i"))
    b = parquet(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("SUPPLY").alias("kind"), F.col("s_acctbal").alias("b"), F.col("s_suppkey").alias("i"))
    return entities.combine_sources(a, b, ["k", "kind"], "kind", {"BUILDING": "houses"}, ["i"]).drop("i")


@query("WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1), l AS (SELECT o_custkey, string_agg(o_orderpriority || ':' || r.o_orderkey, '|' ORDER BY o.o_orderdate, r.o_orderkey) AS kids FROM r JOIN orders o USING (o_orderkey, o_custkey, o_orderpriority) GROUP BY o_custkey) SELECT c_custkey, kids FROM customer LEFT JOIN l ON c_custkey = o_custkey")
def children_first(spark, d):
    got = entities.children(parquet(spark, d, "customer").select("c_custkey"), "c_custkey", parquet(spark, d, "orders"), "o_custkey", "o_orderpriority", ["o_orderpriority", "o_orderkey"], ["o_orderdate", "o_orderkey"], "kids")
    return got.withColumn("kids", F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x["o_orderpriority"], x["o_orderkey"].cast("string"))), "|"))


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def distinct_children(spark, d):
    lists = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderpriority", "o_orderkey")).alias("l"))
    return entities.distinct_children(lists, "l", "o_orderpriority", ["o_orderkey"])


@query("SELECT s_suppkey, n_parts, n_late FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL) a ON s_suppkey = a.l_suppkey LEFT JOIN (SELECT l_suppkey, count(*) AS n_late FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b ON s_suppkey = b.l_suppkey")
def with_aggregates(spark, d):
    l = parquet(spark, d, "lineitem")
    return entities.with_aggregates(parquet(spark, d, "supplier").select("s_suppkey"), "s_suppkey", [(l, "l_suppkey", [F.countDistinct("l_partkey").alias("n_parts")]), (l.where("l_returnflag = 'R'"), "l_suppkey", [F.count("*").alias("n_late")])])


@query("SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey")
def has_member(spark, d):
    lists = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("kind"))).alias("l"))
    return lists.select("o_custkey", entities.has_member(F.col("l"), "kind", ["1-Urgent"]).alias("urgent"))


@query("SELECT c_custkey, coalesce(a.v, b.v) AS found, CASE WHEN a.v IS NOT NULL THEN 'c_custkey' WHEN b.v IS NOT NULL THEN 'c_nationkey' END AS found_by FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_totalprice > 300000 GROUP BY 1) a ON c_custkey = o_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS v FROM supplier GROUP BY 1) b ON c_nationkey = s_nationkey")
def cascade_lookup(spark, d):
    first = parquet(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"))
    second = parquet(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("v"))
    return entities.cascade(parquet(spark, d, "customer"), "c_custkey", [(first, "c_custkey", "v"), (second, "c_nationkey", "v")], "found").select("c_custkey", "found", "found_by")


@query("SELECT 'id' || c_nationkey AS org, c_custkey AS person FROM customer UNION SELECT 'ln' || length(c_mktsegment), c_custkey FROM customer")
def union_lookups(spark, d):
    people = parquet(spark, d, "customer").withColumn("n", F.length("c_mktsegment"))
    ids = parquet(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("id"), F.col("n_nationkey").cast("string")).alias("org"))
    links = people.select(F.col("n").alias("link")).distinct().withColumn("org", F.concat(F.lit("ln"), F.col("link").cast("string")))
    return entities.union_lookups(people, "c_custkey", "c_nationkey", "n", ids, links)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN upper(role) ELSE role END AS role FROM conversations")
def fill_translated(spark, d):
    c = parquet(spark, d, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).select("key", "conv_id", "turn", "role")
    better = c.select("key", F.when(F.col("turn") % 3 == 0, F.upper("role")).when(F.col("turn") % 3 == 1, "").alias("role"))
    return entities.filled(c, "key", better, ["role"]).drop("key")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def pending_documents(spark, d):
    results = parquet(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").alias("error"))
    return entities.pending(parquet(spark, d, "documents").select("doc_id"), results, "doc_id", "error")


@query("WITH r AS (SELECT o_custkey, list(o_orderpriority) AS kinds, date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01') AS days, max(o_orderstatus) AS st FROM orders GROUP BY o_custkey) SELECT o_custkey, st = 'P' AND days <= 300 AS active, st = 'P' AND days <= 300 AND list_has_any(kinds, ['1-URGENT', '2-HIGH']) AS late FROM r")
def status_filters(spark, d):
    r = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("kinds"), F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate")).alias("days"), F.max("o_orderstatus").alias("st"))
    status = F.when(F.col("st") == "P", "operating").otherwise("closed")
    return r.select("o_custkey", entities.active(status, F.col("days"), 300).alias("active"), entities.late_venture(status, F.col("kinds"), ["1-URGENT", "2-HIGH"], F.col("days"), 300).alias("late"))


_ROUNDS = "r AS (SELECT l_orderkey, l_partkey, list_distinct(list(l_suppkey)) AS inv FROM lineitem GROUP BY ALL), x AS (SELECT l_orderkey, l_partkey, unnest(inv) AS investor FROM r), p AS (SELECT x.*, p_type, p_partkey IS NOT NULL AS in_original FROM x LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey WHERE investor IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12))"


def _portfolio(spark, d):
    rounds = parquet(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.collect_set("l_suppkey").alias("inv"))
    companies = parquet(spark, d, "part").where("p_size < 10").select("p_partkey", "p_type")
    wanted = parquet(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("investor"))
    return entities.portfolio(rounds, "inv", "l_partkey", companies, "p_partkey", wanted)


@query(f"WITH {_ROUNDS} SELECT l_orderkey, l_partkey, investor, p_type, in_original FROM p")
def investor_portfolio(spark, d):
    return _portfolio(spark, d)


@query(f"WITH {_ROUNDS} SELECT investor, count(*) AS n FROM p WHERE investor IN (SELECT investor FROM p WHERE in_original) GROUP BY investor")
def original_investors(spark, d):
    return entities.original_investors(_portfolio(spark, d)).groupBy("investor").agg(F.count("*").alias("n"))


@query(f"WITH {_ROUNDS} SELECT investor, sum(in_original::INT)::BIGINT AS n_subset, count(*) AS n_total, round(sum(in_original::INT) / count(*), 9)::DOUBLE AS n_ratio, round(sum(in_original::INT) / count(*) * ln(count(*)), 9)::DOUBLE AS n_weighted FROM p GROUP BY investor")
def portfolio_ratios(spark, d):
    got = aggregate.subset_ratios(_portfolio(spark, d), "investor", F.col("in_original"), {"n": F.lit(1)})
    return got.select("investor", "n_subset", "n_total", F.round("n_ratio", 9).alias("n_ratio"), F.round("n_weighted", 9).alias("n_weighted"))


@query("SELECT i AS id, coalesce(s_name, c_name) AS name, CASE WHEN s_name IS NOT NULL THEN 'organisation' WHEN c_name IS NOT NULL THEN 'person' END AS kind, coalesce(s_nationkey < 3, false) AS government FROM (SELECT DISTINCT l_suppkey + 20 AS i FROM lineitem) LEFT JOIN supplier ON i = s_suppkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 110) ON i = c_custkey")
def investor_metadata(spark, d):
    ids = parquet(spark, d, "lineitem").select((F.col("l_suppkey") + 20).alias("id")).distinct()
    o = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.when(F.col("s_nationkey") < 3, "government_office").otherwise("fund")).alias("types"))
    p = parquet(spark, d, "customer").where("c_custkey < 110").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return entities.investor_metadata(ids, o, p, ["government_office"])


@query("WITH f AS (SELECT o_custkey, count(*) AS n, sum((o_orderpriority = '1-URGENT')::INT) AS t, floor(avg(year(o_orderdate))) AS y FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_founders, coalesce(t, 0)::BIGINT AS n_tech, y::BIGINT AS mean_first_year, coalesce(t, 0) > 0 AS any_tech, coalesce(t, 0) > 0 AND t = n AS all_tech, coalesce(t / n > 0.25, false) AS tech_majority, coalesce(t / n > 0.4, false) AS tech_large_majority, (2010 - y)::BIGINT AS years_before FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def founder_toplines(spark, d):
    people = parquet(spark, d, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("tech"), F.year("o_orderdate").alias("y"))
    got = entities.founder_toplines(parquet(spark, d, "customer").select("c_custkey", F.lit(2010).alias("founded")), "c_custkey", people, "o_custkey", ["tech"], "y", "founded", 0.25, 0.4)
    return got.drop("founded")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ', ' ELSE '' END || c_nationkey AS place FROM customer")
def pick_location(spark, d):
    c = parquet(spark, d, "customer")
    place = lambda city, primary, deleted: F.struct(city.alias("city"), F.col("c_nationkey").cast("string").alias("country"), F.lit(primary).alias("is_primary"), F.lit(deleted).alias("deleted"))
    own = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    return c.select("c_custkey", entities.pick_location(F.array(place(F.lit("old"), True, True), place(F.lit("other"), False, False), place(own, True, False)), ["city", "country"]).alias("place"))


@query("SELECT o_custkey, string_agg(v, '|' ORDER BY o_orderkey, i) AS v FROM (SELECT o_custkey, o_orderkey, unnest([o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END]) AS v, unnest([1, 2]) AS i FROM orders) WHERE v IS NOT NULL GROUP BY o_custkey")
def flat_values(spark, d):
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("b"))))
    return parquet(spark, d, "orders").groupBy("o_custkey").agg(items.alias("l")).select("o_custkey", F.array_join(entities.flat_values(F.col("l"), ["a", "b"]), "|").alias("v"))


@query("SELECT position, n_name, n_regionkey FROM (VALUES (0, 'NATION_7'), (1, 'NATION_3'), (2, 'NOWHERE'), (3, 'NATION_11')) t(position, n) LEFT JOIN nation ON n = n_name WHERE n <> 'NOWHERE' UNION ALL SELECT 2, 'NOWHERE', NULL")
def in_given_order(spark, d):
    return entities.in_given_order(["NATION_7", "NATION_3", "NOWHERE", "NATION_11"], parquet(spark, d, "nation").select("n_name", "n_regionkey"), "n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS level1 FROM customer")
def clean_levels(spark, d):
    x = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("No_Level_1_"), F.col("c_mktsegment"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Segment: "), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    return entities.clean_levels(parquet(spark, d, "customer").select("c_custkey", x.alias("level1")), ["level1"])


@query('SELECT c_mktsegment AS "Segment", c_custkey FROM customer')
def apply_settings(spark, d):
    rows = [{"column": "c_mktsegment", "label": "Segment", "keep": 1}, {"column": "c_name", "label": "Name", "keep": 0}, {"column": "c_custkey", "keep": 1}, {"column": "gone", "keep": 1}]
    return entities.apply_settings(parquet(spark, d, "customer"), rows)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_of_each(spark, d):
    return entities.first_of_each(parquet(spark, d, "documents"), "source", 3, ["doc_id"]).select("source", "doc_id")


@query()
def down_sample(spark, d):
    return entities.down_sample(parquet(spark, d, "orders"), "o_orderstatus", {"F": 0.25, "O": 0.5}, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, length(p_name) AS n, md5(p_name) AS h FROM part")
def length_key(spark, d):
    return parquet(spark, d, "part").select("p_partkey", text.length_key(F.col("p_name")).alias("k")).select("p_partkey", F.col("k.length").alias("n"), F.col("k.md5").alias("h"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '1-10' WHEN p_size < 30 THEN '11-50' WHEN p_size < 45 THEN '10001+' END AS size FROM part")
def employee_range(spark, d):
    code = F.when(F.col("p_size") < 10, "c_00001_00010").when(F.col("p_size") < 30, "c_00011_00050").when(F.col("p_size") < 45, "c_10001_max")
    return parquet(spark, d, "part").select("p_partkey", text.employee_range(code).alias("size"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat_ws(', ', CASE WHEN turn > 0 THEN 'City' END, 'State', 'United States') ELSE concat_ws(', ', 'City', 'France') END AS place, turn % 3 = 0 AS selfish FROM conversations")
def place_names(spark, d):
    c = parquet(spark, d, "conversations")
    home = F.col("turn") % 2 == 0
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" I'm unable to say: "), "text")).otherwise(F.concat(F.lit("It is "), "text"))
    return c.select("conv_id", "turn", profile.place(F.when(~home | (F.col("turn") > 0), "City").otherwise(""), F.lit("State"), F.when(home, "United States").otherwise("France")).alias("place"), profile.talks_of_itself(reply).alias("selfish"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '|' ORDER BY f DESC, o_orderkey) AS kept FROM (SELECT o_custkey, o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS f FROM (SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1) GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey")
def newest_per(spark, d):
    from pyspark.sql import Window

    o = parquet(spark, d, "orders").withColumn("_n", F.count("*").over(Window.partitionBy("o_custkey", "o_orderdate"))).where("_n = 1")
    lists = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderdate").alias("created"), "o_orderpriority", "o_orderkey")).alias("l"))
    return lists.select("o_custkey", F.array_join(F.transform(profile.newest_per(F.col("l"), ["o_orderpriority"]), lambda x: x["o_orderkey"].cast("string")), "|").alias("kept"))


# --- funding


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN n > 0 THEN coalesce(r{y}, 0) END::DOUBLE AS raised_{y}" for y in (1996, 1997, 1998)) + " FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, " + ", ".join(f"sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = {y}) AS r{y}" for y in (1996, 1997, 1998)) + " FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def raised_by_year(spark, d):
    got = funding.by_year(parquet(spark, d, "orders"), parquet(spark, d, "customer").select("c_custkey"), "o_custkey", "c_custkey", "o_orderdate", money("o_totalprice"), [1996, 1997, 1998])
    return got.select("c_custkey", *[F.col(f"raised_{y}").cast("double").alias(f"raised_{y}") for y in (1996, 1997, 1998)])


_STAGES = "['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT']"
_FLAGS = "r AS (SELECT o_custkey, list(o_orderpriority) AS t, max(o_orderstatus) AS st, date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01') AS days FROM orders GROUP BY o_custkey)"


def _flagged(spark, d):
    r = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("t"), F.max("o_orderstatus").alias("st"), F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate")).alias("days"))
    stages = ["seed_kind", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    flags = {}
    for name, stage in (("seed", "5-LOW"), ("a", "4-NOT SPECIFIED"), ("late", "3-MEDIUM")):
        flags[name] = funding.outcome(F.col("t"), F.lit(False), F.col("st") == "O", F.col("st") == "F", F.col("days"), stage, 400, stages, acquired_from="2-HIGH")
    return r, flags


def _outcome_sql(focal: str, later: str) -> tuple[str, str]:
    good = f"(list_has_any(t, {later}) OR (st = 'O' AND list_has_any(t, ['2-HIGH', '1-URGENT'])))"
    return good, f"(list_contains(t, '{focal}') AND NOT {good} AND (st = 'F' OR days > 400))"


_OUTCOMES = {"seed": _outcome_sql("5-LOW", "['4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT']"), "a": _outcome_sql("4-NOT SPECIFIED", "['3-MEDIUM', '2-HIGH', '1-URGENT']"), "late": _outcome_sql("3-MEDIUM", "['2-HIGH', '1-URGENT']")}


@query(f"WITH {_FLAGS} SELECT o_custkey, " + ", ".join(f"{g} AS {n}_ok, {b} AS {n}_failed" for n, (g, b) in _OUTCOMES.items()) + " FROM r")
def stage_outcomes(spark, d):
    r, flags = _flagged(spark, d)
    return r.select("o_custkey", *[c.alias(f"{n}_{k}") for n, (good, bad) in flags.items() for k, c in (("ok", good), ("failed", bad))])


@query(f"WITH {_FLAGS}, s AS (SELECT sum((days > 200)::INT)::BIGINT AS n_seed, sum((days <= 200)::INT)::BIGINT AS n_a, " + ", ".join(f"sum({b}::INT) / (sum({b}::INT) + sum({g}::INT)) AS {n}" for n, (g, b) in _OUTCOMES.items()) + " FROM r), e AS (SELECT *, (1 - seed) * n_seed AS x FROM s), f AS (SELECT *, (1 - a) * (n_a + x) AS y FROM e) SELECT n_seed, n_a, n_seed + n_a AS n_total, round(seed, 9)::DOUBLE AS seed_failure_rate, round(a, 9)::DOUBLE AS a_failure_rate, round(late, 9)::DOUBLE AS late_failure_rate, round(x, 6)::DOUBLE AS expected_seed, round(y, 6)::DOUBLE AS expected_a, round((1 - late) * y, 6)::DOUBLE AS expected_late, round((1 - late) * y / (n_seed + n_a), 9)::DOUBLE AS overall FROM f")
def expected_survival(spark, d):
    r, flags = _flagged(spark, d)
    got = funding.expected_survival(r, flags, F.col("days") > 200, F.col("days") <= 200)
    return got.withColumns({c: F.round(c, 6 if c.startswith("expected") else 9) for c in got.columns if not c.startswith("n_")})


@query("WITH m AS (SELECT c_custkey AS e, n_regionkey AS l0, CASE WHEN c_custkey % 2 = 0 THEN n_nationkey END AS l1, c_mktsegment AS g, (c_custkey + 1)::DOUBLE AS a FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT l0, l1, g, sum(a) AS s FROM m WHERE l1 IS NOT NULL GROUP BY ALL), f AS (SELECT l0, l1, g, s / sum(s) OVER (PARTITION BY l0, g) AS f FROM s), x AS (SELECT e, l0, l1, g, a FROM m WHERE l1 IS NOT NULL UNION ALL SELECT e, m.l0, f.l1, m.g, a * f FROM m JOIN f ON m.l0 = f.l0 AND m.g = f.g WHERE m.l1 IS NULL) SELECT e, l0, l1, g, round(sum(a), 9)::DOUBLE AS a FROM x GROUP BY ALL")
def redistribute_by_funding(spark, d):
    n = parquet(spark, d, "nation")
    m = parquet(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("e"), F.col("n_regionkey").alias("l0"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_nationkey")).alias("l1"), F.col("c_mktsegment").alias("g"), (F.col("c_custkey") + 1).cast("double").alias("a"))
    return funding.spread_by_funding(m, "e", "l0", "l1", "a", ["g"]).withColumn("a", F.round("a", 9))


@query("WITH r AS (SELECT DISTINCT c_custkey % 97 AS e, n_regionkey AS l0, CASE WHEN c_custkey % 3 > 0 THEN n_nationkey END AS l1, CASE WHEN c_custkey % 3 > 1 THEN c_custkey END AS l2 FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT *, (l1 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT + 1 AS depth FROM r) SELECT e, l0, l1, l2 FROM x QUALIFY NOT ((depth = 1 AND max(depth) OVER (PARTITION BY e, l0) > 1) OR (depth = 2 AND max(depth) OVER (PARTITION BY e, l0, l1) > 2))")
def leaf_rows(spark, d):
    return funding.leaf_rows(_levels(spark, d), "e", ["l0", "l1", "l2"])


@query("SELECT l_suppkey, round(avg(l_quantity), 9)::DOUBLE AS mean, round(stddev_samp(l_quantity), 9)::DOUBLE AS std, quantile_cont(l_quantity, 0.5)::DOUBLE AS median, quantile_cont(l_quantity, 0.25)::DOUBLE AS p25, quantile_cont(l_quantity, 0.75)::DOUBLE AS p75 FROM lineitem GROUP BY l_suppkey")
def run_statistics(spark, d):
    return funding.run_statistics(parquet(spark, d, "lineitem"), "l_suppkey", "l_quantity").withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query("SELECT c_custkey, sum(c_acctbal::DECIMAL(18,2)) OVER w::DOUBLE AS group_sum, round(avg(c_acctbal) OVER w, 6)::DOUBLE AS group_mean, count(*) OVER w AS group_count FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def group_transform(spark, d):
    c = parquet(spark, d, "customer").withColumn("b", money("c_acctbal"))
    return aggregate.transformed(c, "c_mktsegment", "b").select("c_custkey", F.col("group_sum").cast("double").alias("group_sum"), F.round(F.col("group_sum").cast("double") / F.col("group_count"), 6).alias("group_mean"), "group_count")


@query("WITH w AS (SELECT l_suppkey, l_returnflag || l_linestatus AS tag, sum(l_quantity::BIGINT)::DOUBLE AS q FROM lineitem GROUP BY ALL), m AS (SELECT s_nationkey, tag, sum(q) AS wt, any_value(n) AS n FROM w JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) USING (s_nationkey) GROUP BY ALL) SELECT s_nationkey, tag, round(CASE WHEN n = 1 THEN wt ELSE wt / sum(wt) OVER (PARTITION BY s_nationkey) END, 9)::DOUBLE AS wt FROM m")
def merged_weights(spark, d):
    from .queries import _weighted

    s = _weighted(spark, d).join(parquet(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return aggregate.merged_weights(s, ["s_nationkey"], "t").select("s_nationkey", F.inline("tags")).withColumn("wt", F.round("wt", 9))


# --- taxonomy


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), s AS (SELECT vec_id AS id, label::VARCHAR AS category, round(sum(x * m), 9) AS sim FROM v JOIN m USING (i) GROUP BY ALL), r AS (SELECT *, 100.0::DOUBLE * (rank() OVER (ORDER BY sim) - 1) / count(*) OVER () AS pct, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS rank FROM s), y AS (SELECT *, max(pct) OVER (PARTITION BY id) AS m FROM r) SELECT id, category, round(sim, 5)::DOUBLE AS sim, round(pct, 3)::DOUBLE AS pct, rank::INT AS rank FROM y WHERE rank <= 4 AND (rank = 1 OR (pct > 60 AND pct > m - 20))")
def similarity_percentiles(spark, d):
    got = taxonomy.similarity_percentiles(parquet(spark, d, "embeddings"), "vec_id", "embedding", _centroids(spark, d), "label", "vector", 4, 60.0, 20.0)
    return got.withColumns({"sim": F.round("sim", 5), "pct": F.round("pct", 3)})


@query(f"WITH {_TREE} SELECT node, 'r' || r AS level0, n AS level1, c AS level2 FROM (SELECT 'r' || r_regionkey AS node, r_regionkey AS r, NULL AS n, NULL AS c FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey, 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey, 'n' || c_nationkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def level_paths(spark, d):
    return taxonomy.level_paths(_tree(spark, d), "node", "parent", "root", 3)


@query("SELECT node, 'r' || r AS level0, CASE WHEN c IS NOT NULL THEN n || ' - ' || c ELSE n END AS level1 FROM (SELECT 'r' || r_regionkey AS node, r_regionkey AS r, NULL AS n, NULL AS c FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey, 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey, 'n' || c_nationkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def collapsed_levels(spark, d):
    return taxonomy.level_paths(_tree(spark, d), "node", "parent", "root", 2)


@query("SELECT c_custkey AS e, 'n' || c_nationkey AS category FROM customer UNION SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_custkey, 'root' FROM customer")
def forced_parents(spark, d):
    m = parquet(spark, d, "customer").select(F.col("c_custkey").alias("e"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("category"))
    return taxonomy.forced_parents(m, "e", "category", taxonomy.closure(_tree(spark, d), "node", "parent", 3))


@query("WITH t AS (SELECT DISTINCT c_mktsegment AS term, 'nation' || c_nationkey AS parent FROM customer), m AS (SELECT term FROM t GROUP BY term HAVING count(DISTINCT parent) > 1) SELECT CASE WHEN term IN (SELECT term FROM m) THEN term || ' (' || parent || ')' ELSE term END AS term, parent FROM t")
def unique_children(spark, d):
    t = parquet(spark, d, "customer").select(F.col("c_mktsegment").alias("term"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("parent")).distinct()
    return taxonomy.unique_children(t, "term", "parent")


@query("WITH b AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderstatus, o_orderpriority) = 1), a AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS all_o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS all_o_orderpriority FROM orders GROUP BY 1) SELECT c_custkey, o_orderstatus AS best_o_orderstatus, o_orderpriority AS best_o_orderpriority, all_o_orderstatus, all_o_orderpriority FROM customer LEFT JOIN b ON c_custkey = b.o_custkey LEFT JOIN a ON c_custkey = a.o_custkey")
def mapping_to_entities(spark, d):
    got = taxonomy.mapping_to_entities(parquet(spark, d, "customer").select("c_custkey"), parquet(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice", ["o_orderstatus", "o_orderpriority"])
    return got.withColumns({c: F.array_join(c, "|") for c in got.columns if c.startswith("all_")})


@query("WITH p AS (SELECT n_regionkey AS a, c_nationkey AS b, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), q AS (SELECT a, sum(x) AS x FROM p GROUP BY a), u AS (SELECT 1 AS depth, a::VARCHAR AS path, a, x, x / sum(x) OVER () AS f, 0 AS g, a AS k FROM q UNION ALL SELECT 2, a || '/' || b, a, x, x / sum(x) OVER (PARTITION BY a), a + 1, b FROM p) SELECT depth, path, round(x, 2)::DOUBLE AS amount, round(f, 9)::DOUBLE AS of_parent, round(sum(f) OVER (PARTITION BY g ORDER BY x DESC, k ROWS UNBOUNDED PRECEDING), 9)::DOUBLE AS cumulative, round(x / (SELECT sum(x) FROM q), 9)::DOUBLE AS of_whole FROM u")
def share_table(spark, d):
    rows = parquet(spark, d, "customer").join(F.broadcast(parquet(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    got = taxonomy.share_table(rows, ["n_regionkey", "c_nationkey"], money("c_acctbal").cast("decimal(18,2)"))
    return got.select("depth", "path", *[F.round(F.col(c).cast("double"), 2 if c == "amount" else 9).alias(c) for c in ("amount", "of_parent", "cumulative", "of_whole")])


@query("SELECT p_partkey, p_name AS term FROM part WHERE NOT regexp_matches(' ' || p_name || ' ', ' (ring|red bolt) ')")
def without_places(spark, d):
    places = spark.createDataFrame([("Ring",), ("red bolt",)], "place string")
    return hierarchy.without_places(parquet(spark, d, "part"), "p_partkey", "p_name", places)


@query("WITH f AS (SELECT p_name AS term, count(*) AS n FROM part GROUP BY 1), g AS (SELECT term, n, string_split(term, ' ')[2] AS g FROM f), b AS (SELECT g, min({'n': -n, 'term': term}).term AS representative, sum(n) AS s FROM g GROUP BY g) SELECT term, representative FROM g JOIN b USING (g) WHERE s >= 20")
def synonym_groups(spark, d):
    f = parquet(spark, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("n"))
    g = f.select(F.col("term").alias("u"), F.element_at(F.split("term", " "), 2).alias("g"))
    pairs = g.join(g.withColumnRenamed("u", "v"), "g").where("u < v").select("u", "v", F.lit(0.95).alias("sim"))
    return hierarchy.synonym_groups(pairs, f, 0.9, 20)


_DOC_TAGS = "x AS (SELECT DISTINCT p_partkey AS doc, p_name AS term FROM part), o AS (SELECT doc, string_split(term, ' ')[2] AS tag FROM x), c AS (SELECT tag, tag AS ancestor, 1.0::DOUBLE AS sim FROM (SELECT DISTINCT tag FROM o) UNION ALL SELECT tag, left(tag, 1), 0.5 FROM (SELECT DISTINCT tag FROM o) UNION ALL SELECT tag, 'all', 0.1 FROM (SELECT DISTINCT tag FROM o))"


@query(f"WITH {_DOC_TAGS}, u AS (SELECT doc, ancestor AS tag, sum(sim) AS w FROM o JOIN c USING (tag) WHERE sim >= 0.2 GROUP BY ALL), d AS (SELECT tag, count(*) AS df FROM u GROUP BY tag), s AS (SELECT doc, tag, w * ln((SELECT count(DISTINCT doc) FROM x) / df) AS x FROM u JOIN d USING (tag)), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc)) AS l FROM s) SELECT doc, tag, round(x / l, 9)::DOUBLE AS score FROM n WHERE l > 0 AND x / l > 0.15")
def tag_documents(spark, d):
    docs = parquet(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("term"))
    nodes = docs.select("term").distinct().withColumn("tag", F.element_at(F.split("term", " "), 2))
    own = nodes.select("tag").distinct()
    closure = own.select("tag", F.col("tag").alias("ancestor"), F.lit(1.0).alias("sim")).unionByName(own.select("tag", F.substring("tag", 1, 1).alias("ancestor"), F.lit(0.5).alias("sim"))).unionByName(own.select("tag", F.lit("all").alias("ancestor"), F.lit(0.1).alias("sim")))
    return hierarchy.tag_documents(docs, "doc", "term", nodes, closure).withColumn("score", F.round("score", 9))


@query()
def pruned_tree(spark, d):
    from .queries import QUERIES

    return hierarchy.pruned_tree(QUERIES["tag_tree"](spark, d), "g")


# --- simulation


@query()
def changed_skills(spark, d):
    rows = parquet(spark, d, "lineitem").join(parquet(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name").distinct()
    return simulate.changed_skills(rows, "l_suppkey", "p_name", parquet(spark, d, "part").select(F.col("p_type").alias("skill")), 1, 3)


@query("SELECT 1 AS round, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 6)::DOUBLE AS \"{s}\"" for s in "FOP") + " FROM orders")
def wide_means(spark, d):
    got = simulate.wide_means(parquet(spark, d, "orders").withColumn("round", F.lit(1)), "o_orderstatus", "o_totalprice", list("FOP"))
    return got.select("round", *[F.round(c, 6).alias(c) for c in "FOP"])


# --- filters, matches and rules


@query("SELECT p_partkey FROM part WHERE p_size % 4 > 0 AND p_retailprice > 905 AND p_size >= 10")
def numeric_filter(spark, d):
    p = parquet(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("price"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") < 10, " or so").otherwise("")).alias("year"))
    return entities.coerced(p, {"price": "double", "year": "int"}).where("price > 905 and year >= 10").select("p_partkey")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT')")
def facet_filter(spark, d):
    o = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("facets"))
    return entities.located_in(o, "facets", "1-URGENT").select("o_custkey")


@query("SELECT doc_id, (doc_id % 3 = 0 OR length(text) < 1000) AS missing, (doc_id % 3 > 0 OR lang = 'en') AS some FROM documents")
def missing_descriptions(spark, d):
    x = parquet(spark, d, "documents").withColumns({"a": F.when(F.col("doc_id") % 3 > 0, F.col("text")), "b": F.when(F.col("lang") == "en", "x").otherwise("  ")})
    return x.select("doc_id", entities.missing_text(F.col("a"), 1000).alias("missing"), entities.some_text(F.col("a"), F.col("b")).alias("some"))


@query("WITH g AS (SELECT conv_id, turn, length(text) AS n, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS g FROM conversations), c AS (SELECT conv_id, turn, any_value(n) AS n, g, count(*) AS c FROM g GROUP BY conv_id, turn, g) SELECT conv_id, turn, max(c) * 2 / any_value(n) >= 0.05 AS repeats FROM c GROUP BY conv_id, turn")
def repeats_itself(spark, d):
    c = parquet(spark, d, "conversations").where("length(text) >= 2")
    return c.select("conv_id", "turn", text.repeats_itself(F.col("text"), (2,), 0.05).alias("repeats"))


@query("WITH h AS (SELECT regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)', 1), '^www\\.', '') AS h, min(url) AS matched FROM pages GROUP BY 1) SELECT page_id, matched FROM (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)', 1), '^www\\.', '') AS h FROM pages) JOIN (SELECT h, min(url) AS matched FROM (SELECT *, regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)', 1), '^www\\.', '') AS h FROM pages WHERE page_id < 20) GROUP BY h) USING (h)")
def match_hosts(spark, d):
    p = parquet(spark, d, "pages")
    return entities.match_hosts(p.select("page_id", F.upper("url").alias("site")), "site", p.where("page_id < 20"), "url").select("page_id", "matched")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'known' ELSE 'new' || s_nationkey END AS image FROM supplier")
def with_known(spark, d):
    s = parquet(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    listing = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("known").alias("image"))
    return entities.with_known(s, "s_suppkey", listing, "image", lambda rows: rows.withColumn("image", F.concat(F.lit("new"), F.col("s_nationkey").cast("string")))).select("s_suppkey", "image")


@query("WITH a AS (SELECT p_brand, list(DISTINCT p_type) AS t FROM part WHERE p_size < 15 GROUP BY 1), b AS (SELECT p_brand, list(DISTINCT p_type) AS t FROM part WHERE p_size > 40 GROUP BY 1), j AS (SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.p_brand IS NULL AS na, b.p_brand IS NULL AS nb, coalesce(a.t, []) AS x, coalesce(b.t, []) AS y FROM a FULL JOIN b ON a.p_brand = b.p_brand) SELECT p_brand, CASE WHEN nb THEN 'prior' WHEN na THEN 'new' ELSE 'both' END AS provenance, array_to_string(list_sort(list_distinct(x || y)), '|') AS items, array_to_string(list_sort(list_filter(y, lambda z: NOT list_contains(x, z))), '|') AS added FROM j")
def provenance_lists(spark, d):
    p = parquet(spark, d, "part")
    own = lambda rows: rows.groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    return entities.provenance_lists(own(p.where("p_size < 15")), own(p.where("p_size > 40")), "p_brand", "t").withColumns({c: F.array_join(c, "|") for c in ("items", "added")})


@query("WITH s AS (SELECT p_brand AS cluster, count(*) AS size FROM part GROUP BY 1), p AS (SELECT a.p_brand AS a, b.p_brand AS b, count(DISTINCT a.p_type)::BIGINT AS sim FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_brand <> b.p_brand GROUP BY ALL) SELECT a, b, sim FROM p JOIN s ON b = cluster QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, size, b) <= 3")
def similar_clusters(spark, d):
    p = parquet(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()
    pairs = p.withColumnRenamed("p_brand", "a").join(p.withColumnRenamed("p_brand", "b"), ["p_type", "p_size"]).where("a <> b").groupBy("a", "b").agg(F.countDistinct("p_type").alias("sim"))
    return entities.similar_clusters(pairs, parquet(spark, d, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("size")), 3)


@query("WITH r AS (SELECT o_custkey, list(o_orderpriority) AS t, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice::DECIMAL(18,2) END) AS v FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN list_has_any(t, ['1-URGENT', '2-HIGH']) THEN 'late' WHEN list_contains(t, '3-MEDIUM') THEN '3-MEDIUM' WHEN list_contains(t, '5-LOW') THEN '5-LOW' END AS stage, coalesce(v, 0)::DOUBLE AS raised FROM r")
def equity_stage(spark, d):
    r = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("kind"), money("o_totalprice").alias("amount"))).alias("r"))
    stage = entities.equity_stage(F.transform("r", lambda x: x["kind"]), ["5-LOW", "3-MEDIUM", "late"], {"1-URGENT": "late", "2-HIGH": "late"})
    return r.select("o_custkey", stage.alias("stage"), entities.raised_from(F.col("r"), ["1-URGENT", "2-HIGH"]).cast("double").alias("raised"))


@query("SELECT n_nationkey, 'r' || n_regionkey AS region FROM nation WHERE n_nationkey % 7 <> 3")
def filled_sheet(spark, d):
    from pyspark.sql import Window

    n = parquet(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("o"))
    first = F.row_number().over(Window.partitionBy("r").orderBy("o")) == 1
    sheet = n.select("n_nationkey", "o", F.when(first, F.concat(F.lit("r"), F.col("r").cast("string"))).otherwise("").alias("region"), F.when(F.col("n_nationkey") % 7 == 3, "1").alias("exclude"))
    return taxonomy.filled_sheet(sheet, "o", ["region"], "exclude").select("n_nationkey", "region")


@query("WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderstatus) = 1), b AS (SELECT o_custkey AS k, o_orderpriority AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_orderpriority) = 1) SELECT c_custkey, s AS status_best, p AS priority_best FROM customer LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_custkey = b.k")
def several_mappings(spark, d):
    o = parquet(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    got = taxonomy.several_mappings(parquet(spark, d, "customer").select("c_custkey"), "c_custkey", {"status": (o, "o_totalprice", ["o_orderstatus"]), "priority": (o, "o_orderkey", ["o_orderpriority"])})
    return got.select("c_custkey", F.col("status_best_o_orderstatus").alias("status_best"), F.col("priority_best_o_orderpriority").alias("priority_best"))


@query("SELECT n_nationkey AS node, n_regionkey AS parent, n_name AS label FROM nation")
def tree_round_trip(spark, d):
    t = parquet(spark, d, "nation").select(F.lit("g").alias("g"), F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("label"), F.lit(0.5).alias("sim"))
    return taxonomy.tree_from_document(taxonomy.tree_document(t, "g"), "g").select("node", "parent", "label")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' || c_custkey WHEN c_custkey % 3 = 1 THEN 'b' || c_custkey END AS uid FROM customer")
def first_known(spark, d):
    a = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a"), F.col("c_custkey").cast("string"))).otherwise("")
    b = F.when(F.col("c_custkey") % 3 < 2, F.concat(F.lit("b"), F.col("c_custkey").cast("string")))
    return parquet(spark, d, "customer").select("c_custkey", entities.first_known(a, b).alias("uid"))
