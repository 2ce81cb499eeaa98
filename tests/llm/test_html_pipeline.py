"""HTML extraction on made pages; the pipeline's stages on the small tables."""

import os

import pytest

from cairnframe.llm import html_text

from ..conftest import DATA

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies and this notice is rather long, longer than some.</div>
<div id="content"><div class="post post-12"><h2>Title &amp; more</h2><p>First para with <b>bold</b> and <a href=y>link</a>&nbsp;text, enough.<p>Second  para<br>line two.
<ul><li>one<li>two</ul><div class="ad">BUY</div><form><input name=a><label>Name</label></form></div>
<div class="comments"><div class="comment"><p>Nice article, I think this is a long comment from a reader.</p></div></div></div>
<aside>Side</aside><script>if (a<b) "</p>"</script><footer>(c)</footer></body></html>"""
TEXT = "Title & more First para with bold and link text, enough. Second para line two. one two"


def test_extract_one():
    assert html_text.best_path(PAGE)[0].endswith("div.post.post-")
    assert html_text.extract(PAGE, None) == TEXT
    assert html_text.extract("", None) == "" and html_text.extract("plain &lt;x&gt;", None) == "plain <x>"
    assert html_text.extract("<div><p>a<p>b", None) == "a b"
    assert html_text.extract("<div>" * 3000 + "deep", None) == "deep"


def page(inner, article="post"):
    return f"<html><body><nav><a href=x>Home</a></nav><article class='{article}'><h1>Head</h1><p>{'Real text of the page, quite long. ' * 4}</p>{inner}<p>Last words.</p></article><footer>(c)</footer></body></html>"


BODY = " ".join(["Head", *["Real text of the page, quite long."] * 4])


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<p>Mass is <math><mi>m</mi><mo>=</mo><mn>2</mn></math> here.</p>", "Mass is m=2 here."),
        ('<section class="legal">Article two of the law.</section>', "Article two of the law."),
        ('<div class="form">Forms of life are many.</div>', "Forms of life are many."),
        ('<div class="search-history">Search has a history.</div>', "Search has a history."),
        ('<div class="commentary">Learned commentary stays.</div>', "Learned commentary stays."),
        ("<noscript>Without script too.</noscript>", "Without script too."),
        ("<svg><title>t</title><text>drawn</text></svg>", "drawn"),
        ('<div class="tags"><a href=a>one</a> <a href=b>two</a></div>', ""),
        ('<div class="ad">BUY</div><div id="ad-slot-3" class="ad-banner">BUY</div>', ""),
        ('<div class="cookie-notice">We use cookies.</div><div role="alert">Now!</div><p hidden>unseen</p>', ""),
        ('<div class="share-buttons">Tell all your friends</div><div class="related-posts">Other stories</div>', ""),
        ('<form><textarea>write</textarea><select><option>a</select></form><aside>by the way</aside>', ""),
        ('<ol class="comment-list"><li class="comment"><article class="comment-body"><p>' + "Nice one, says a reader at length. " * 30 + "</p></article></li></ol>", ""),
        ('<section id="comments" class="comments-area"><p>First!</p></section><div id="disqus_thread">Second!</div>', ""),
    ],
)
def test_what_stays_and_goes(inner, want):
    assert html_text.extract(page(inner), None) == " ".join(filter(None, [BODY, want, "Last words."]))


def test_classes_never_take_the_article():
    for name in ("post comments-open", "widget", "ad-free sponsored", "related"):
        assert html_text.extract(page("", name), None) == BODY + " Last words."
    for name in ("widget", "modal", "social-page"):
        assert html_text.extract(f"<body><div class='{name}'><div><p>{'All the text there is. ' * 9}</p></div></div></body>", None) == " ".join(["All the text there is."] * 9)
    assert html_text.extract("<body><div class=sidebar><article><p>Inside.</p></article></div></body>", None) == "Inside."


def test_odd_pages(spark):
    """Repeated rows, ties between paths, a long page, clashing names; many hosts joined instead of broadcast."""
    long = page("<p>" + "word " * 200_000 + "</p>")
    two = "<body><div class='a'><p>Same length here.</p></div><div class='b'><p>Same length there</p></div></body>"
    rows = [(1, "http://h.org/1", long, 1), (1, "http://h.org/1", long, 1), (2, "http://t.org/1", two, 1), (3, "http://t.org/2", two, 1), (None, None, two, 1), (5, "not a url", "<p>x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    want = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()), key=repr)
    assert len(want) == 6 and want[0][2] > 1_000_000 or want[1][2] > 0
    held, html_text.BROADCAST_HOSTS = html_text.BROADCAST_HOSTS, 1
    try:
        assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()), key=repr) == want
    finally:
        html_text.BROADCAST_HOSTS = held


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_of_the_table(spark):
    """The pages of the test tables have one article each: its text, by a plain reading of the markup, is what comes out."""
    import html
    import re

    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br|ul|li)\b[^>]*>", " ", inner[1]))).split())


def test_consensus(spark):
    """A page whose best container is another one follows its host."""
    body = "<html><body><div class='main'><p>{}</p></div><div class='other'><p>{}</p></div></body></html>"
    rows = [(k, "http://h.org/p", body.format("Real text of the page, quite long. " * 5, "short"), 1) for k in range(4)]
    rows += [(9, "http://h.org/q", body.format("Brief.", "An offer that is much longer than the text itself, really."), 1), (10, None, None, 1), (11, "http://other.org", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()}
    assert got[9] == ("Brief.", 6) and got[10] == ("", 0) and got[11] == ("x", 1) and len(got) == 7
    assert html_text.extract_pages(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for _, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, before, DATA))
        assert after.columns == docs.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        before = after
    packed = p.STAGES[-1][1](spark, before, DATA)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on rows with nulls, empty texts, repeated rows, ties, a long text and extra columns that clash, against
    a plain version of it; and every stage on an empty table."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    import public_tokenizers as P
    from cairnframe.llm import classifier

    from .test_dedup import brute_hits, brute_removed, corpus, shingles

    rnd = random.Random(21)
    rows = corpus(5, 50)
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, None), (None, ""), (None, "no id, some words here of its own"), (None, "no id, some words here of its own"), (None, "another text without an id at all")]
    rows += [(300 + k, " ".join(f"{rnd.choice('abcdef')}{rnd.randrange(400)}###" for _ in range(60))) for k in range(8)] + [(400, " ".join(f"long{k}" for k in range(30_000)))]
    items = [(1, rows[10][1] or "x y z"), (2, "w1 w2"), (2, "w3 w4 w5"), (None, "w7 w7"), (3, " ".join(f"long{k}" for k in range(100, 130)))]
    schema = "doc_id long, text string, lang string, n_chars long, bucket string, sid long, spans string, hash int, _h int"
    frame = lambda rs: spark.createDataFrame([(k, t, "en", len(t or ""), "b", 7, "s", 1, 2) for k, t in rs], schema)
    folder = str(tmp_path)
    labels = spark.createDataFrame([(300 + k, 0, 0) for k in range(6)] + [(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    for _, stage in p.STAGES:
        assert stage(spark, frame(rows).limit(0), folder).count() == 0

    docs = frame(rows)
    kept = classifier.classify(docs, labels).collect()
    first = p.quality(spark, docs, folder)
    assert first.columns == docs.columns
    left = pairs(first)
    assert len(left) == sum(r["kept"] for r in kept) and not [k for k, t in left if "###" in (t or "")]
    assert {(k, t) for k, t in rows if "###" not in (t or "")} <= set(left)

    sets = [(k, t, shingles(t)) for k, t in left]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][2], sets[j][2]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (k, t, s) in enumerate(sets):
        groups.setdefault(find(i) if s else (k, t), []).append((k, t))
    second = p.near_duplicates(spark, p.stored(first), folder)
    assert second.columns == docs.columns
    got = pairs(second)
    assert len(got) == len(groups)
    for members in groups.values():
        least = min((k for k, _ in members if k is not None), default=None)
        assert sum((k, t) in members and k == least for k, t in got) == 1 or least is None

    third = p.passages(spark, p.stored(second), folder)
    assert third.columns == docs.columns
    numbered = list(enumerate(got))
    want = []
    for n, words, gone, _, text in brute_removed([(n, t) for n, (_, t) in numbered]):
        if not (gone and gone == words):
            want.append((got[n][0], text if gone else got[n][1]))
    assert pairs(third) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect() if r["text"] is not None)

    fourth = p.contamination(spark, p.stored(third), folder)
    assert fourth.columns == docs.columns
    bad = brute_hits(list(enumerate(t for _, t in sorted(want, key=repr))), items)
    clean = [sorted(want, key=repr)[r[0]] for r in bad if not r[5]]
    assert pairs(fourth) == sorted(clean, key=repr) and len(clean) < len(want)

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in clean)
    packed = p.sequences(spark, p.stored(fourth), folder).collect()
    assert sum(r["length"] for r in packed) == total
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and np.mean(list(fill.values())) > 512
