"""Entities, services, model steps, files and pages on literal frames."""

import difflib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from cairnframe.functions import profile, text
from cairnframe.operators import entities, hierarchy, joins, models, pages, services, simulate, viewer
from cairnframe.sources import files

from .conftest import DATA


def test_repeats_and_spaces_by_python(spark):
    rnd = random.Random(5)
    samples = ["".join(rnd.choice(["ab", "ab", "a", "x:", "É", " ", " ", "  ", "\n", "\t\t"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["go go gone", "a.b a.b a.bc", "x   y\n\n\nz"]
    df = spark.createDataFrame(list(enumerate(samples)), "k int, t string").select("k", text.collapse_repeats(F.col("t")).alias("r"), text.clean_scraped(F.col("t")).alias("c"))
    repeated = re.compile(r"(\b[\w!:.@#$%^&*()-]+)(?:\s+\1)+")
    for r in df.collect():
        given = samples[r["k"]]
        assert r["r"] == repeated.sub(r"\1", given), repr(given)
        bare = re.sub(" {3,}", " ", given.encode("ascii", "ignore").decode())
        assert r["c"] == re.sub(r"(\s)\1+", r"\1", repeated.sub(r"\1", bare)), repr(given)


def test_queries_without_sql_by_python(spark):
    import __spark_entry__  # noqa: F401  registers all queries
    from cairnframe.plans.registry import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    repeated = re.compile(r"(\b[\w!:.@#$%^&*()-]+)(?:\s+\1)+")
    assert {r["doc_id"]: r["clean"] for r in QUERIES["text_repeat_collapse"](spark, DATA).collect()} == {k: repeated.sub(r"\1", t) for k, t in docs.items()}
    assert {r["doc_id"]: r["uuid"] for r in QUERIES["uuid5_key"](spark, DATA).collect()} == {k: str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for k, t in docs.items()}
    names = sorted({r["p_name"] for r in spark.read.parquet(f"{DATA}/part.parquet").collect()})
    want = set()
    for a in names:
        for b in {n.replace("e", "") for n in names}:
            s, t = set(a.split()), set(b.split())
            if s & t and (difflib.SequenceMatcher(None, a, b).ratio() >= 0.7 or len(s & t) / len(s | t) >= 0.6):
                want.add((a, b))
    assert {(r["name_a"], r["name_b"]) for r in QUERIES["fuzzy_name_match"](spark, DATA).collect()} == want
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("turn").collect():
        turns.setdefault(r["conv_id"], []).append(r["text"])
    for r in QUERIES["packed_texts"](spark, DATA).collect():
        used, kept = 0, []
        for t in turns[r["conv_id"]]:
            n = len(t.split())
            if n >= 5 and used + n <= 120:
                used, kept = used + n, [*kept, t]
        assert (r["n_words"], r["n_pages"], r["text"]) == (used, len(kept), "\n\n".join(kept) if kept else turns[r["conv_id"]][0][:5000])
    share = {r["o_orderstatus"]: r["n"] for r in QUERIES["down_sample"](spark, DATA).collect()}
    every = {r["o_orderstatus"]: r["count"] for r in spark.read.parquet(f"{DATA}/orders.parquet").groupBy("o_orderstatus").count().collect()}
    assert share["P"] == every["P"] and abs(share["F"] / every["F"] - 0.25) < 0.08 and abs(share["O"] / every["O"] - 0.5) < 0.08


def test_pruned_tree(spark):
    rows = [("g", 0, 4, "a"), ("g", 1, 4, "b"), ("g", 2, 5, "c"), ("g", 3, 6, "d"), ("g", 4, 5, "b"), ("g", 5, 6, "b"), ("g", 6, -1, "b")]
    got = {r["node"]: r["parent"] for r in hierarchy.pruned_tree(spark.createDataFrame(rows, "g string, node int, parent int, label string"), "g").collect()}
    assert got == {0: 6, 1: 6, 2: 6, 3: 6, 6: -1}


def test_changed_skills_stay_in_bounds(spark):
    rows = [(p, f"s{k}") for p in range(30) for k in range(p % 9 + 1)]
    df, pool = spark.createDataFrame(rows, "p int, s string"), spark.createDataFrame([(f"new{k}",) for k in range(50)], "skill string")
    got = {}
    for r in simulate.changed_skills(df, "p", "s", pool, 2, 7).collect():
        got.setdefault(r["person"], set()).add(r["skill"])
    for p in range(30):
        own = {s for q, s in rows if q == p}
        assert len(own - got.get(p, set())) <= min(4, -(-len(own) // 4)) and len(got.get(p, set()) - own) <= 3
    assert any(got.get(p, set()) != {s for q, s in rows if q == p} for p in range(30))


def test_jittered_shares_by_rows(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(5), rnd.randrange(12), rnd.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p int, s int, y int")
    flips = {(r["s"], r["round"]) for r in df.select("s").distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(20)))).where(simulate.uniform(3, "s", "round") < 0.1).collect()}
    assert flips
    for r in simulate.jittered_relevance(df, "p", "s", "y", 20, 3, flip=0.1).collect():
        own = [1 - y if (s, r["round"]) in flips else y for p, s, y in rows if p == r["person"]]
        assert r["share"] == pytest.approx(sum(own) / len(own))


def test_paging_stops_at_the_total(spark):
    rows = [{"i": k, "t": str(k)} for k in range(23)]
    asked = []

    def fetch(at, n):
        asked.append((at, n))
        return rows[at : at + n], len(rows)

    assert sorted(r["i"] for r in services.offset_pages(spark, fetch, "i int, t string", 10).collect()) == list(range(23))
    assert asked == [(0, 10)]  # the driver asks for the first page alone
    assert sorted(r["i"] for r in services.offset_pages(spark, lambda at, n: (rows[at : at + n], 23), "i int, t string", 10, 12).collect()) == list(range(12))
    assert services.offset_pages(spark, lambda at, n: ([], 0), "i int, t string").count() == 0
    pages_ = []

    def after(key, n):
        pages_.append(key)
        return [r for r in rows if key is None or r["i"] > key][:n]

    assert services.keyset_pages(spark, after, "i", "i int, t string", 10).count() == 23 and pages_ == [None, 9, 19, 22]


def test_a_second_call_does_not_ask_the_model(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bad")], "id long, t string")
    empty = spark.createDataFrame([], "id long, text_id string, response string, num_errors int")

    def call(t):
        if t == "bad":
            raise ValueError(t)
        return t.upper()

    def never(t):
        raise AssertionError(t)

    answers, cache = services.cached_results(rows, empty, "id", "t", call)
    assert {(r["id"], r["response"]) for r in answers.collect()} == {(1, "A"), (2, "BB")}
    assert {(r["id"], r["num_errors"]) for r in cache.collect()} == {(1, 0), (2, 0), (3, 1)}
    again, store = services.cached_results(rows, cache, "id", "t", never)
    assert {(r["id"], r["response"]) for r in again.collect()} == {(1, "A"), (2, "BB")}
    assert {(r["id"], r["num_errors"]) for r in store.collect()} == {(1, 0), (2, 0), (3, 1)}  # the error's budget is used up
    changed = rows.withColumn("t", F.when(F.col("id") == 1, "new").otherwise(F.col("t")))
    assert {(r["id"], r["response"]) for r in services.cached_results(changed, cache, "id", "t", call)[0].collect()} == {(1, "NEW"), (2, "BB")}


def test_plain_services():
    body = services.search_body({"name": ["a", "b"], "site": []}, {"id": ["9"]})["query"]["bool"]
    assert len(body["must"]) == 1 and len(body["must"][0]["bool"]["should"]) == 2 and len(body["must_not"]) == 1
    polls = iter([None, ["p1", "p2"]])
    assert services.bulk_job(lambda ids: "j", lambda j: next(polls), lambda p: [{"p": p}], [1], 0, 5) == [{"p": "p1"}, {"p": "p2"}]
    with pytest.raises(TimeoutError):
        services.bulk_job(lambda ids: "j", lambda j: None, lambda p: [], [1], 0, 2)
    calls = []

    def square(x):
        calls.append(x)
        return x * x

    store = {}
    f = services.memoized(square, store)
    assert (f(3), f(3), f(x=3)) == (9, 9, 9) and calls == [3, 3] and len(store) == 2
    near = {"a": ["b", "c"], "b": ["a"], "c": ["d"], "d": []}
    assert models.expand_terms("a", lambda t: near[t]) == ["a", "b", "c", "d"]
    assert services.tree_of(lambda k: [{"n": k + "x"}] if len(k) < 4 else [], "r", "n", 2) == [{"n": "rx", "parent": "r", "depth": 1}, {"n": "rxx", "parent": "rx", "depth": 2}]
    assert [files.column_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert viewer.sponsors(["b", "z", "a"], {"a": ("i", "u"), "b": ("j", "w")}) == [("b", "j", "w"), ("a", "i", "u")]
    page = viewer.with_head("<html><head></head></html>", "G-1", {"title": 'a "b"'})
    assert 'og:title" content="a &quot;b&quot;"' in page and "id=G-1" in page
    assert [services.setting({"a": {"b": 1}}, k, {"a": {"c": 2}}) for k in ("a.b", "a.c", "x.y")] == [1, 2, None]
    assert entities.settings_lists([{"column": "a", "keep": 1, "filter": 1}, {"column": "b", "keep": 0, "filter": 1}], ["filter"]) == {"filter": ["a"]}


def test_markdown_of_texts_only(spark):
    df = spark.createDataFrame([(1, "**a**", "**b**", "x|y", 3), (2, None, "c", "", None)], "id int, t string, raw string, l string, n int")
    got = [r["attr"] for r in viewer.nodes(df, "id", "t", ["t", "raw", "l", "n"], ["l"], ["t", "raw"], ["raw"]).orderBy("id").collect()]
    assert got == ['{"t":"<p><strong>a</strong></p>","raw":"**b**","l":["x","y"],"n":"3"}', '{"t":"","raw":"c","l":[],"n":""}']
    assert viewer.missing_attributes(df, ["t", "z"]) == ["z"]
    with pytest.raises(ValueError, match="unknown"):
        viewer.settings([], {"a": 1}, viewer.attribute_types(df), ["b"])
    assert viewer.settings([], {"b": 1}, viewer.attribute_types(df), ["b"])["attributes"]["n"] == {"type": "integer"}


def test_matches_and_fills(spark):
    rows = spark.createDataFrame([("Acme Solar",), ("Blue Farm Co",)], "n string")
    others = spark.createDataFrame([("acme solar",), ("Acme Solars",), ("Blue Farm",)], "o string")
    assert {(r["name_a"], r["name_b"]) for r in entities.match_names(rows, "n", others, "o").collect()} == {("Acme Solar", "acme solar"), ("Blue Farm Co", "Blue Farm")}
    left = spark.createDataFrame([(1, None, ["a"], "x"), (2, "own", None, "y")], "k int, site string, tags array<string>, z string")
    right = spark.createDataFrame([(1, "s1", ["b", "a"], "S"), (2, "s2", ["c"], "L")], "k int, site string, tags array<string>, size string")
    got = {r["k"]: (r["site"], r["tags"], r["size"], r["z"]) for r in entities.merge_profiles(left, right, "k", ["site"], ["tags"], {"size": {"S": "small"}}).collect()}
    assert got == {1: ("s1", ["a", "b"], "small", "x"), 2: ("own", ["c"], "L", "y")}
    assert joins.outer_provenance(left, right.where("k = 1"), "k").count() == 2


def test_page_texts(spark):
    short = "<html><head><title>T</title></head><body><b>x</b> y<script>no</script><p>para</p></body></html>"
    df = spark.createDataFrame([(short,), ("",), ("<div>" + "w " * 400 + "</div>",)], "h string").select(pages.page_text(F.col("h")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["x y para", "empty", ("w " * 400).strip()]


def test_newest_first(spark):
    items = [("2020", "a", 1), ("2021", "b", 2), ("2022", "a", 3)]
    df = spark.createDataFrame([(items,)], "l array<struct<created:string,k:string,v:int>>")
    assert [x["v"] for x in df.select(profile.newest_per(F.col("l"), ["k"]).alias("x")).first()["x"]] == [1, 2]
