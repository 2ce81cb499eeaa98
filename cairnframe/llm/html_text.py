"""Main text of web pages by consensus host paths (operator 6).

Every page's containers are scored by the prose that stands directly in them.  The generalised path of the best one
(tags and classes from the root, digits struck out) is the page's vote for its host.  Spark sums the votes; each host's
winning path is then used to extract all its pages.  A page without the winning path uses its own best container.

Elements that can hold no article text (navigation, forms, scripts) go by their tag.  Others go by their class, id or
role only where a whole name says so: the head of the name counts (`cookie-notice` is a notice, `search-history` a
history), after words for mere boxes.  A class never takes away an article, a main element or what holds one, save
reader comments, and class rules are dropped where they would leave less than a tenth of the page's prose.  Names that
often stand for article text too (`legal`, `form`, `tags`) count only where the element is mostly links.

Defined results: null and empty html give an empty text of 0 characters; a page without tags is its own text; a null url
belongs to the host named by the empty string; equal rows give equal results; ties between paths go to the higher
score, then to the path last in order; a very long page is parsed whole and without recursion; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import keep, spread_join

#: Winning paths of so many hosts are broadcast; of more, they are joined, the pages of a large host in several tasks.
BROADCAST_HOSTS = 50_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|iframe|select)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
NAME = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
#: Elements whose inner elements are parts of one drawing or formula.
FOREIGN = frozenset("math svg".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table article section div main body".split())
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure".split())
NEVER = frozenset("nav footer aside form button menu dialog fieldset".split())
WHOLE = frozenset("html body".split())
CORE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Heads of names of what is no article text.
OTHER = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsbygoogle sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice alert popup modal overlay menu nav navbar"
    " navigation breadcrumb breadcrumbs sidebar widget footer header masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager copyright".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond responses disqus".split())
#: Heads of names that also stand for article text.
PERHAPS = frozenset("legal form search side skip tag tags hidden meta actions buttons links".split())
#: Words for mere boxes: the head of a name is the word before them.
BOXES = frozenset("area bar block body box button buttons col column container content div group holder inner item items label link links list outer panel posts row section slot stories text thread title unit wrap wrapper".split())


def kind_of(names: str) -> str:
    """What the classes and ids of an element say of it: `comment`, `other`, `perhaps` or nothing."""
    found = ""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_:\d]+", name) if w]
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        head = words[-1] if words else ""
        if head in COMMENTS:
            return "comment"
        if head in OTHER:
            found = "other"
        elif head in PERHAPS and not found:
            found = "perhaps"
    return found


class Node:
    __slots__ = ("tag", "path", "parent", "gone", "inline", "foreign", "article", "kind", "parts", "prose", "linked", "score")

    def __init__(self, tag: str, path: str, parent: Node | None, gone: bool, article: bool, kind: str = ""):
        self.tag, self.path, self.parent, self.gone, self.article, self.kind = tag, path, parent, gone, article, kind
        self.foreign = parent is not None and (parent.foreign or parent.tag in FOREIGN)
        self.inline = tag in INLINE or self.foreign
        self.parts: list = []
        self.prose = self.linked = 0
        self.score = 0.0


def parse(source: str) -> Node:
    root = now = Node("", "", None, False, False)
    for m in TOKEN.finditer(source):
        tag = m[3]
        if tag is None:
            text = m[0]
            if m[1] is None and text[:2] not in ("<!", "<?"):
                if not now.gone:
                    now.parts.append(text)
            elif m[1] is not None:
                now.parts.append(" ")
            continue
        tag = tag.lower()
        if m[2]:
            at = now
            while at.parent is not None and at.tag != tag:
                at = at.parent
            if at.parent is not None:
                now = at.parent
            continue
        if tag in BLOCKS:
            now = _ended(now, {"p"})
        elif tag in SAME:
            now = _ended(now, SAME[tag])
        if tag in EMPTY:
            if tag not in INLINE:
                now.parts.append(" ")
            continue
        names = role = ""
        unseen = False
        if m[4]:
            for kind, a, b, c in NAME.findall(m[4]):
                kind = kind.lower()
                if kind == "role":
                    role = (a or b or c).lower()
                elif kind == "hidden":
                    unseen = True
                else:
                    names += " " + (a or b or c)
        article = now.article or tag in CORE
        gone = now.gone or tag in NEVER or (tag == "header" and not now.article) or (tag not in WHOLE | CORE and (role in ROLES or unseen))
        label = tag + "".join("." + x for x in sorted(re.sub(r"\d+", "", names).split()))
        child = Node(tag, now.path if tag in INLINE or now.foreign or now.tag in FOREIGN else now.path + "/" + label, now, gone, article, kind_of(names) if names and not gone and tag not in WHOLE else "")
        now.parts.append(child)
        if not m[4].endswith("/") or tag in BLOCKS:
            now = child
    _sift(root)
    return root


def _sift(root: Node) -> None:
    """Marks what goes by its names."""
    every = list(nodes(root))
    if not any(n.kind for n in every):
        return
    holds: set[int] = set()
    for n in every:  # an article is safe with all that holds it; one that is a comment is not
        if n.tag in CORE and n.kind != "comment" and not n.gone:
            while n is not None and id(n) not in holds:
                holds.add(id(n))
                n = n.parent  # noqa: PLW2901
    _measure(every)
    total = root.prose - root.linked
    out = []
    for n in every:
        if not n.kind or n.gone or id(n) in holds:
            continue
        if n.kind == "comment" or (n.kind == "other" and not (n.article and n.tag == "header")) or (n.kind == "perhaps" and 2 * n.linked > n.prose):
            out.append(n)
    for kinds in (("comment", "other", "perhaps"), ("comment",), ()):
        chosen = {id(n) for n in out if n.kind in kinds}
        left = total - sum(n.prose - n.linked for n in out if id(n) in chosen and not _within_ids(n, chosen))
        if 10 * left >= total:
            break
    for n in every:
        if id(n) in chosen or (n.parent is not None and n.parent.gone):
            n.gone = True


def _within_ids(node: Node, ids: set[int]) -> bool:
    at = node.parent
    while at is not None:
        if id(at) in ids:
            return True
        at = at.parent
    return False


def _measure(every: list[Node]) -> None:
    """Characters of each node's text, and of links in it; what is gone does not count."""
    for node in reversed(every):
        if node.gone:
            continue
        inner = [x for x in node.parts if isinstance(x, Node) and not x.gone]
        node.prose = sum(len(x.strip()) for x in node.parts if isinstance(x, str)) + sum(x.prose for x in inner)
        node.linked = node.prose if node.tag == "a" else sum(x.linked for x in inner)


def _ended(now: Node, tags: set[str]) -> Node:
    at = now
    while at.parent is not None and at.tag not in SCOPE:
        if at.tag in tags:
            return at.parent
        at = at.parent
    return now


def nodes(root: Node) -> Iterator[Node]:
    """All nodes, parents first, without recursion: pages may be nested deeply."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]


def score(root: Node) -> Node:
    """Scores every container and gives the best: prose directly in it counts fully, prose one level below by half,
    and links count against it."""
    every = list(nodes(root))
    _measure(every)
    for node in reversed(every):
        if node.gone:
            continue
        if not node.inline and node.tag not in PROSE:
            own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
            inner = [x for x in node.parts if isinstance(x, Node) and not x.gone]
            near = own + sum(x.prose - x.linked for x in inner if x.inline or x.tag in PROSE)
            node.score = near + 0.5 * sum(x.score for x in inner if not x.inline and x.tag not in PROSE) - node.linked
            if node.article and node.tag in ("article", "main"):
                node.score *= 1.5
    return max((n for n in every if not n.gone and not n.inline and n.tag not in PROSE), key=lambda n: n.score)


def text_of(node: Node) -> str:
    """The node's text without what is gone: blocks apart by one space, character references decoded."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.gone:
            if not x.inline:
                out.append(" ")
                stack.append(" ")
            stack += reversed(x.parts)
    return " ".join(entities.unescape("".join(out)).split())


def best_path(source: str) -> tuple[str, float]:
    best = score(parse(source))
    return best.path, float(best.score)


def extract(source: str, path: str | None) -> str:
    root = parse(source)
    found = [n for n in nodes(root) if n.path == path and not n.inline and not n.gone] if path else []
    if not found:
        return text_of(score(root))
    return " ".join(filter(None, (text_of(n) for n in found if not _within(n, found))))


def _within(node: Node, found: list[Node]) -> bool:
    above = set(map(id, found)) if len(found) > 1 else ()
    at = node.parent
    while at is not None and above:
        if id(at) in above:
            return True
        at = at.parent
    return False


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def winners(pages: DataFrame) -> DataFrame:
    """host, path, n: the path most pages of the host vote for, and how many pages it has."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [best_path(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, score double")
    sums = votes.groupBy("host", F.when(F.col("score") > 0, F.col("path")).alias("path")).agg(F.count("*").alias("n"), F.sum(F.round("score")).alias("s"))
    return sums.groupBy("host").agg(F.max_by("path", F.when(F.col("path").isNotNull(), F.struct("n", "s", "path"))).alias("path"), F.sum("n").alias("n"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    best = keep(winners(pages))
    hosts, total = best.agg(F.count("*"), F.sum("n")).first()
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if hosts <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(best.drop("n")), "host", "left")
    else:
        rows = spread_join(rows, best.drop("n"), "host", best.select("host", "n"), ["page_id", "url"], total)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", p) for x, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
