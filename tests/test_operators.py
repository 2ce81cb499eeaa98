"""Operators on literal frames: nulls, ties, empty input, invariants."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.functions import arrays, dates, text, url
from cairnframe.operators import aggregate, funding, joins, network, taxonomy, viewer, windows
from cairnframe.sources import tables


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


def test_text(spark):
    assert one(spark, "  ", text.blank_to_null) is None
    assert one(spark, None, text.fill_nodata) == "no data"
    assert one(spark, "a a b b b c", text.collapse_repeats) == "a b c"
    assert one(spark, "hELLO there. sECOND one", text.sentence_case) == "Hello there. Second one"
    assert one(spark, "A01 Health care; B2 Arts", text.drop_codes) == "Health care; Arts"
    assert one(spark, "A01 Unknown", text.drop_codes) is None
    assert one(spark, "a", lambda c: text.map_values(c, {"a": "b", "b": "c"})) == "c"
    assert one(spark, "x;y,z", lambda c: text.split_any(c, [";", ","])) == ["x", "y", "z"]
    assert one(spark, "solar energy", lambda c: text.drop_last_word(c, ["energy"])) == "solar"
    assert one(spark, "One. Two", text.first_sentence) == "One."
    assert one(spark, "ababab", lambda c: text.repeated_share(c, 2)) == pytest.approx(1.0)
    assert one(spark, "", lambda c: text.repeated_share(c, 2)) == 0.0
    assert one(spark, "http://x.org/é", text.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://x.org/é"))
    got = spark.createDataFrame([("a b", "b c")], "a string, b string").select(text.word_jaccard(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert got == pytest.approx(1 / 3)


def test_url(spark):
    assert one(spark, "HTTPS://www.Site.org:80/a/b/?q=1#f", url.host) == "site.org"
    assert one(spark, "HTTPS://www.Site.org/a/b/?q=1#f", url.normalise) == "https://site.org/a/b"
    for given, want in (("https://google.com", "google.com"), ("https://google.com/", "google.com"), ("https://some.com:80", "some.com_80"), ("https://cool.com/inner/page/1", "cool.com_inner_page_1"), ("https://another.com?query=my", "another.com"), ("www.bare.org/x", "www.bare.org_x")):
        assert one(spark, given, url.site_key) == want
    assert one(spark, "https://www.a.org/x/y", url.host_key) == "a.org"
    assert one(spark, "http://www.a.org/x?y=1/", url.cache_key) == "a.org_x_y_1"
    assert one(spark, "http://A.org/File.PDF", url.clean_url) == "https://A.org/File.PDF"
    assert one(spark, "facebook.com/x", lambda c: url.clean_url(c, drop_social=True)) is None
    assert one(spark, "http://a.org/x/y/", url.last_segment) == "y"
    got = spark.createDataFrame([("http://a.org/", "/p")], "a string, b string").select(url.full_url(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert got == "http://a.org/p"


def test_arrays(spark):
    assert one(spark, "['a', 'b']", arrays.literal_list) == ["a", "b"]
    assert one(spark, None, arrays.literal_list) == [] and one(spark, "", arrays.literal_list) == []
    assert one(spark, " b|a||a ", arrays.clean_tags) == ["a", "b"]
    assert one(spark, ["a"], lambda c: arrays.add_related(c, {"a": ["b"], "b": ["a", "c"]}), "array<string>") == ["a", "b", "c"]
    weighted = one(spark, [("x", 1.0), ("y", 3.0), ("z", 0.0)], lambda c: arrays.remove_weighted(c, ["z"]), "array<struct<tag:string,wt:double>>")
    assert [(r["tag"], r["wt"]) for r in weighted] == [("x", 0.25), ("y", 0.75)]
    kept = one(spark, [("x", 1.0), ("y", 30.0)], lambda c: arrays.threshold_weighted(c, 0.1, 1), "array<struct<tag:string,wt:double>>")
    assert [r["tag"] for r in kept] == ["y"]
    assert [r["wt"] for r in one(spark, [("x", 1.0), ("x", 2.0)], lambda c: arrays.dedupe_by(c, "tag"), "array<struct<tag:string,wt:double>>")] == [1.0]


def test_dates(spark):
    assert one(spark, "2020-05", dates.year_of) is None and one(spark, "2020-05-06T01", dates.year_of) == 2020 and one(spark, "xxxxxxxxxx", dates.year_of) is None
    assert one(spark, [], lambda c: dates.days_since(c, F.lit("2020-01-01").cast("date")), "array<date>") is None


def test_aggregate_null_rules(spark):
    df = spark.createDataFrame([(None, "a", None, 1), ("k", "b", None, 2), ("k", None, 5, 3)], "k string, t string, n int, o int")
    r = aggregate.aggregate_tags_text(df, ["k"], {"tags": "t"}, {"total": "n"}, {"first": "t"}, "o").collect()
    assert [(x["k"], x["tags"], x["total"], x["first"], x["n_rows"]) for x in r] == [("k", "b", 5, "b", 2)]


def test_rank_percentile_and_pack(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (5,)], "v int")
    got = sorted(r["pct"] for r in windows.max_rank_percentile(df, "v").collect())
    assert got == pytest.approx([100 / 3, 100 / 3, 200 / 3, 100])
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4)], "k string, o int, s int")
    assert windows.pack_budget(rows, "k", "o", "s", 10).first()["kept"] == [1, 3]
    assert windows.pack_budget(rows, "k", "o", "s", 10, stop=True).first()["kept"] == [1]


def test_cached_map_runs_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    cache = spark.createDataFrame([(1, "a", "A", 0), (2, "old", "B", 0), (3, "c", None, 1)], "id long, t string, response string, num_errors int")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(response=pdf["t"].str.upper() + "!")

    found, fresh = joins.cached_map(rows, cache, "id", "t", run, "id long, t string, response string")
    assert [(r["id"], r["response"]) for r in found.collect()] == [(1, "A")]
    assert [(r["id"], r["response"]) for r in fresh.collect()] == [(2, "B!")]


def test_fold_flags(spark):
    s = spark.createDataFrame([(1, ["grant", "a", "loan"]), (2, [])], "k int, kinds array<string>")
    got = {r["k"]: (r["venture"], r["grant_before"], r["grant_after"], r["loan_before"], r["loan_after"]) for r in funding.path_flags(s, "k", "kinds", ["grant"], ["loan"], ["a"]).collect()}
    assert got == {1: (True, True, False, False, True), 2: (False,) * 5}


def test_threshold_keeps_every_node(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "c", 0.4), ("c", "d", 0.6)], "u string, v string, sim double")
    got = network.threshold_edges(edges, 1.0).collect()
    assert {r["u"] for r in got} == {"a", "b", "c", "d"}
    assert min(r["sim"] for r in got) >= 0.6


def test_louvain_finds_two_cliques():
    names = list("abcdefgh")
    pairs = [(x, y) for g in ("abcd", "efgh") for i, x in enumerate(g) for y in g[i + 1 :]] + [("d", "e")]
    label = network.louvain(names, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.ones(len(pairs)))
    assert len({label[x] for x in "abcd"}) == 1 and len({label[x] for x in "efgh"}) == 1 and label["a"] != label["h"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long")
    assert {r["node"]: r["component"] for r in network.min_label_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_topn_in_pieces_equals_whole(spark, monkeypatch):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    c = spark.createDataFrame([(k, [float(k), -1.0]) for k in range(7)], "name long, v array<double>")
    whole = sorted(map(tuple, taxonomy.top_categories(e, "id", "v", c, "name", "v", 2).collect()))
    monkeypatch.setattr(taxonomy, "MAX_CATEGORIES", 3)
    assert sorted(map(tuple, taxonomy.top_categories(e, "id", "v", c, "name", "v", 2).collect())) == whole


def test_viewer_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1990, "a|b"), (2, "x", 2000, "c")], "id int, label string, y int, l string")
    assert [r["title"] for r in viewer.nodes(df, "id", "label", ["y"]).orderBy("id").collect()] == ["1", "x"]
    kinds = {r["attribute"]: r["type"] for r in viewer.attribute_types(df).collect()}
    assert kinds["y"] == "year" and kinds["l"] == "liststring"
    (tmp_path / "t.txt").write_text("a|n\nx|1\ny|oops\n")
    good, bad = tables.delimited(spark, str(tmp_path / "t.txt"), "a string, n int")
    assert [r["a"] for r in good.collect()] == ["x"]
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, p string, t int")
    assert tables.last_predictions(log, "id", "t").first()["p"] == "b"


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_predicates(spark):
    from cairnframe.functions.predicates import AllOf, AnyOf, Predicate, condition, without_nulls

    df = spark.createDataFrame([(1, "Solar"), (2, None), (3, " ")], "i int, t string")
    keep = lambda p: [r["i"] for r in df.where(condition(p)).orderBy("i").collect()]
    assert keep(Predicate("t", "blank")) == [2, 3] and keep(AllOf()) == [1, 2, 3] and keep(AnyOf()) == []
    assert keep(AnyOf((Predicate("t", "contains", ("SOL",)), Predicate("i", "gte", (3,))))) == [1, 3]
    assert without_nulls({"a": None, "b": {"c": [1, None, {"d": None}]}}) == {"b": {"c": [1, {}]}}


def test_sections_and_linkage(spark):
    from cairnframe.operators import hierarchy, pages

    rows = [("Title", 0, "A"), ("Text", 1, "x"), ("Title", 0, "B"), ("ListItem", 1, "l"), ("Text", 1, "y")]
    got = one(spark, rows, pages.sections, "array<struct<kind:string,depth:int,text:string>>")
    assert [[e["text"] for e in s] for s in got] == [["A", "x"], ["B", "l"], ["y"]]
    assert one(spark, "This is **bold**.", pages.markdown_inline) == "<p>This is <strong>bold</strong>.</p>"
    merges = hierarchy.average_linkage(np.array([[1, 0], [0.9, 0.1], [0, 1.0]]))
    assert set(merges[0][:2]) == {0, 1} and set(merges[1][:2]) == {3, 2}
    vectors = np.random.default_rng(4).normal(size=(40, 5))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    groups = {k: [k] for k in range(40)}
    for k, (x, y, s) in enumerate(hierarchy.average_linkage(vectors)):
        mean = lambda a, b: (unit[groups[a]] @ unit[groups[b]].T).mean()
        every = [mean(a, b) for a in groups for b in groups if a < b]
        assert s == pytest.approx(mean(x, y)) == pytest.approx(max(every))
        groups[40 + k] = groups.pop(x) + groups.pop(y)


def test_sentence_case_long(spark):
    assert one(spark, "a" + "B" * 1_000_005, text.sentence_case) == "A" + "b" * 1_000_005


def test_tag_tree_has_every_term(spark):
    from cairnframe.plans.queries import QUERIES

    from .conftest import DATA

    every = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("t"))
    assert every.join(QUERIES["tag_tree"](spark, DATA), F.col("t") == F.col("label"), "left_anti").count() == 0


def test_simulations_have_the_reference_rounds(spark):
    from cairnframe.operators import simulate
    from cairnframe.plans.queries import QUERIES

    from .conftest import DATA

    assert QUERIES["permutation_test"](spark, DATA).first()["rounds"] == 1000
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    runs = simulate.jittered_relevance(rows, "l_suppkey", "l_partkey", "y", 1000, 5, threshold=0.33)
    want = {r["person"]: r["mean"] for r in simulate.stability(runs, "person", "share").collect()}
    assert {r["person"]: r["mean"] for r in QUERIES["sensitivity_rounds"](spark, DATA).collect()} == pytest.approx(want)


def test_tag_tree_of_a_large_group(spark):
    """More terms than one table of pairs should hold, equal vectors among them."""
    from cairnframe.operators import hierarchy

    rnd = np.random.default_rng(5)
    vectors = np.repeat(rnd.normal(size=(1040, 8)), 4, axis=0)
    rows = [("g", f"t{k:04}", [float(x) for x in v], k % 7 + 1) for k, v in enumerate(vectors)]
    tree = hierarchy.tag_tree(spark.createDataFrame(rows, "g string, term string, v array<double>, freq int"), "g", "term", "v", "freq").toPandas()
    assert len(tree) == 2 * len(rows) - 1 and set(tree["label"][tree["node"] < len(rows)]) == {r[1] for r in rows}
    assert (tree["parent"] == -1).sum() == 1 and (tree["sim"][tree["node"] >= len(rows)] > 1 - 1e-9).sum() == 3 * 1040


def test_average_linkage_against_all_pairs():
    from cairnframe.operators import hierarchy

    rnd = np.random.default_rng(2)
    vectors = np.r_[rnd.normal(size=(40, 5)), rnd.normal(size=(3, 5)).repeat(3, axis=0)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    own, sims = {k: [k] for k in range(len(vectors))}, []
    while len(own) > 1:
        s, a, b = max(((unit[own[a]] @ unit[own[b]].T).mean(), a, b) for a in own for b in own if a < b)
        own[a] += own.pop(b)
        sims.append(s)
    assert [m[2] for m in hierarchy.average_linkage(vectors)] == pytest.approx(sims)
