"""Main-text extraction with site style trees.

Pages of one host are merged into one tree: a node is the chain of block elements (tag and classes) that leads to it. Over the
distinct pages that have it, a node keeps

* how often each presentation occurs: the sequence of its children and the lines (``LINE`` words each) of its own text,
* on how many pages each feature of its own text occurs: the words of a short piece, the runs of ``PHRASE`` words of a long one.

Presentation importance is the entropy of the presentations, divided by the largest that it could be for so many pages: a menu
of six entries is laid out alike everywhere, articles differ. Content importance is 1 less the mean entropy of the features: a
text that stands on every page has none. A node's own importance is their product (``FLOOR`` keeps sites alive on which every page
is laid out alike), and its composite importance is the mean of its own and all its descendants', weighted by their words.

Markup declares roles; a role counts as much as ``PRIOR_PAGES`` pages would, so it decides on small sites and the tree on large
ones: 0 for menus, asides, page headers and footers and for classes that name such things, 1 for article elements and all in
them, 1/2 for the rest. The yardstick of a site is its deepest branch that holds more than half of all importance. A branch below
``RATIO`` of the yardstick goes, whatever its role; inside articles, and among plain parts of a branch that consists of running
text, only what repeats goes (content importance below ``REPEAT``, ``REPEAT_PAGES`` pages without repeats being assumed), and paragraphs and headings of an article never do. A branch
on fewer than ``SUPPORT`` of its site's pages is no part of the site's style: there the role alone decides.

What no statistics can see goes by its role alone: scripts, styles, forms and their controls, hidden elements, reader comments. A form
stays if it holds the page's article, a heading of the first level or more than half of the page's text, and a part named after
comments if it holds such a heading; classes that name a state ("no-comments") name no part. ``head`` ends where the standard
ends it: at its end tag, or at the first tag or text that is none of its own.

Tree statistics are aggregations with partial sums, keyed by node and value; pages are never gathered by host. Copies of a page
count once. What comes back to the pages is the list of exceptions per host, plain branches that go and noise-like ones that
stay; by ``SUPPORT`` a host has at most as many as 1 / SUPPORT pages have nodes. It is broadcast up to ``BROADCAST_ENTRIES``
entries and joined by host and salt beyond.

Defined cases: null and empty pages give an empty text; a null url is a site of its own; repeated rows are extracted alike;
broken markup is read as far as it goes (a ``<`` that opens no tag is text, missing end tags end with their parent); elements
nested deeper than ``DEPTH`` count as parts of their ancestor at that depth; other columns are kept, clashing names are refused.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import small_batches
from scoreloom.session import reliable_checkpoints

RATIO, REPEAT, FLOOR = 0.5, 0.3, 0.1
PRIOR_PAGES, REPEAT_PAGES = 8, 2
SUPPORT = 0.001
LINE, PHRASE = 8, 16
DEPTH = 64
BROADCAST_ENTRIES = 200_000
#: Parts that a host's pages are dealt into where its exceptions are not broadcast.
SALTS = 64

# Roles of HTML elements.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics", "tspan",
}
DROP_TAGS = {"button", "select", "option", "dialog", "head", "canvas", "audio", "video", "map", "datalist"}
FORM_TAGS = {"form", "fieldset"}
HEAD_TAGS = {"base", "link", "meta", "title", "script", "style", "noscript", "template"}
DROP_ROLES = {"search", "form", "alertdialog", "dialog"}
DROP_WORDS = {"comment", "comments", "commentlist", "disqus"}
# Words beside one of these in a class that make it a state of the page ("no-comments", "comments-enabled").
STATE_WORDS = {"no", "non", "has", "have", "with", "without", "enabled", "disabled", "open", "opened", "closed", "on", "off", "allow", "allowed", "hide", "show"}
NOISE_TAGS = {"nav", "aside", "footer", "menu"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "menu", "menubar", "alert", "toolbar", "tablist"}
ARTICLE_TAGS = {"article", "main"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "figure", "figcaption"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "select"}
# Words in classes and ids that name something other than the article.
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond",
    "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar",
    "topbar", "widget", "widgets",
}

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*")


NOISE, PLAIN, TEXT = 0, 1, 2


class Node:
    """A block element; ``parts`` holds its pieces of text and its child elements in page order."""

    __slots__ = ("tag", "label", "drop", "noise", "soft", "parts", "up", "role", "path", "form", "talk")

    def __init__(self, tag: str, label: str, drop: bool, noise: bool, soft: bool, up: Node | None):
        self.tag, self.label, self.drop, self.noise, self.soft, self.up = tag, label, drop, noise, soft, up
        self.parts: list[str | Node] = []
        self.role, self.path = PLAIN, 0
        self.form, self.talk = tag in FORM_TAGS, False  # what goes unless it holds the article


def _names_comments(value: str) -> bool:
    """Whether a class or id has a name of a part for reader comments."""
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & DROP_WORDS and not words & STATE_WORDS:
            return True
    return False


def _open(tag: str, attributes: str, up: Node) -> Node:
    talk = False
    drop, noise, soft = tag in DROP_TAGS, tag in NOISE_TAGS, tag == "header"
    label = tag
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                named = {w.lower() for w in _WORDS.findall(value)}
                if name == "class" or named & NOISE_WORDS:
                    label += ("." if name == "class" else "#") + ".".join(sorted(value.split()))
                soft = soft or bool(named & NOISE_WORDS)
                talk = talk or bool(named & DROP_WORDS) and tag not in ("html", "body") and _names_comments(value)
            elif name == "role":
                noise = noise or value.lower() in NOISE_ROLES
                drop = drop or value.lower() in DROP_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                drop = True
    node = Node(tag, label, drop, noise, soft, up)
    node.talk = talk
    return node


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ARTICLE_TAGS:
        node = node.up
    return node is not None


def parse(html: str) -> Node:
    """The tree of block elements of a page."""
    root = Node("", "", False, False, False, None)
    here, at, n = root, 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            if here.tag == "head" and not html[at:].isspace():
                here = here.up
            here.parts.append(html[at:])
            break
        found = _TOKEN.match(html, lt) or _LOOSE.match(html, lt)
        if found is None:
            here.parts.append(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            if here.tag == "head" and not html[at:lt].isspace():
                here = here.up
            here.parts.append(html[at:lt])
        at = found.end()
        if not found.group(2):
            continue
        end, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if end:
            if tag in INLINE or tag in VOID:
                continue
            node = here
            while node.up is not None and node.tag != tag:
                node = node.up
            if node.up is not None:
                here = node.up
            continue
        if here.tag == "head" and tag not in HEAD_TAGS:
            here = here.up
        if tag in RAW and not (tag == "noscript" and _in_article(here)):
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            stop = html.find(">", close.end()) if close else -1
            at = stop + 1 if stop >= 0 else n
            continue
        if tag in ENDS_P or tag in ENDS_SAME:
            ends, node = ({"p"} if tag in ENDS_P else ENDS_SAME[tag]), here
            last = None
            while node.up is not None and node.tag not in (LISTS if tag in ENDS_SAME else {"article", "main", "body"} - ends):
                if node.tag in ends:
                    last = node
                    if tag in ENDS_P:
                        break
                node = node.up
            if last is not None:
                here = last.up
        if tag == "br":
            here.parts.append("\n")
        elif tag in INLINE:
            continue
        elif tag in VOID:
            here.parts.append(Node(tag, tag, False, False, False, here))
        else:
            child = _open(tag, attributes, here)
            here.parts.append(child)
            if not attributes.endswith("/") or tag in ENDS_P or tag in TEXT_TAGS:
                here = child
    return root


def _walk(root: Node):
    """Every node below the root, parents first, without recursion (pages nest to any depth)."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.parts) if type(x) is Node]


@lru_cache(maxsize=1 << 16)
def _step(path: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}>{label}".encode(), digest_size=8).digest(), "little", signed=True)


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def read(html: str) -> list[Node]:
    """Every element of a page that is not dropped, parents first, with its role and its node of the site style tree."""
    root = parse(html)
    every = list(_walk(root))
    # A named part that holds the page's article or its heading is no noise, whatever it is called.
    holds: set[int] = set()
    for node in every:
        if node.tag in ARTICLE_TAGS or node.tag in ("h1", "body", "html"):
            up = node.up if node.tag == "h1" else node
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.up
    titled: set[int] = set()
    length: dict[int, int] = {}
    if any(n.form or n.talk for n in every):
        for node in every:
            up = node if node.tag == "h1" else None
            while up is not None and id(up) not in titled:
                titled.add(id(up))
                up = up.up
        for node in reversed(every):  # children first
            own = length.get(id(node), 0) + (0 if node.drop else sum(len(x) for x in node.parts if type(x) is str and not x.isspace()))
            length[id(node)] = own
            if node.up is not None:
                length[id(node.up)] = length.get(id(node.up), 0) + own
        for node in every:
            most = 2 * length[id(node)] > length[id(root)]
            node.drop = node.drop or node.form and id(node) not in holds and not most or node.talk and id(node) not in titled
    kept: list[Node] = []
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        up = node.up
        if up is not None:
            node.path = _step(up.path, node.label) if depth <= DEPTH else up.path
            inside = up.role == TEXT
            if up.role == NOISE or node.noise or (node.soft and not inside and id(node) not in holds):
                node.role = NOISE
            elif inside or node.tag in ARTICLE_TAGS:
                node.role = TEXT
        kept.append(node)
        todo += [(x, depth + 1) for x in reversed(node.parts) if type(x) is Node and not x.drop]
    return kept


def branches(html: str) -> list[tuple[int, list[int], int, bool, bool, int, int, list[int]]]:
    """(node, it and its ancestors, role, outermost of its role, paragraph or the like, words of its own, presentation, features)
    for each node of a page."""
    found: dict[int, list] = {}
    lineage: dict[int, list[int]] = {}
    for n in read(html):
        if n.path not in found:
            lineage[n.path] = [n.path] if n.up is None else [*lineage[n.up.path], n.path]
            found[n.path] = [n.role, n.tag in TEXT_TAGS, 0, [], set(), n.up is not None and n.up.role != n.role]
        own = unescape(" ".join(x for x in n.parts if type(x) is str)).split()
        entry = found[n.path]
        entry[0], entry[1], entry[2] = max(entry[0], n.role), entry[1] and n.tag in TEXT_TAGS, entry[2] + len(own)
        entry[3].append(" ".join(x.label for x in n.parts if type(x) is Node and not x.drop) + f"|{-(-len(own) // LINE)}")
        entry[4].update(own if len(own) <= PHRASE else (" ".join(own[k : k + PHRASE]) for k in range(0, len(own), PHRASE)))
    return [(p, lineage[p], role, outer, prose, words, _number(*style), [_number(x) for x in features]) for p, (role, prose, words, style, features, outer) in found.items()]


def main_text(html: str | None, exceptions: set[int]) -> str:
    """The main text of a page: without noise-like branches, but for the exceptions, which are turned round."""
    if not html:
        return ""
    nodes = read(html)
    go = {id(n) for n in nodes if n.up is not None and ((n.role == NOISE and n.up.role != NOISE) ^ (n.path in exceptions))}
    kept = {id(n) for n in nodes} - go
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            words = unescape("".join(line)).split()
            if words:
                blocks.append(" ".join(words))
            line.clear()

    todo: list[Node | str | None] = [nodes[0]]
    while todo:
        item = todo.pop()
        if type(item) is str:
            line.append(item)
            continue
        flush()
        if item is not None and id(item) in kept:
            todo.append(None)
            todo += reversed(item.parts)
    flush()
    return " ".join(blocks)


def site_of(url: Column) -> Column:
    """Host of a url in lower case; an unreadable or null url is the site with the empty name."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _rows(column: pa.Array) -> pa.Array:
    """The nodes of every page as rows (node, what, value, words, role, up): what 0 is a presentation, 1 a feature, 2 the node itself."""
    counts, node, what, value, words, role, up, upto = [0], [], [], [], [], [], [], [0]
    for html in column:
        for p, line, r, outer, prose, own, style, features in branches(html.as_py() or ""):
            k = 2 + len(features)
            node += [p] * k
            what += [2, 0] + [1] * len(features)
            value += [0, style, *features]
            words += [own] + [0] * (k - 1)
            role += [4 * r + 2 * outer + (not prose)] + [0] * (k - 1)
            up += line
            upto += [len(up)] * k
        counts.append(len(node))
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(up, pa.int64()))
    flat = pa.StructArray.from_arrays(
        [pa.array(node, pa.int64()), pa.array(what, pa.int8()), pa.array(value, pa.int64()), pa.array(words, pa.int64()), pa.array(role, pa.int8()), lists], names=["node", "what", "value", "words", "role", "up"]
    )
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)


def site_style_trees(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", prior_pages: float = PRIOR_PAGES, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """One row per node of the merged trees of all sites (site is a hash of the host): n pages, role, outer (its ancestors have
    another role), prose (a paragraph or the like), up (its ancestors and itself), presentation, content and composite importance, mass (importance times words)."""
    kind = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("what", T.ByteType()), T.StructField("value", T.LongType()), T.StructField("words", T.LongType()), T.StructField("role", T.ByteType()), T.StructField("up", T.ArrayType(T.LongType()))]))
    reliable_checkpoints(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.xxhash64(site_of(F.col(url_col))).alias("site"), F.xxhash64(html).alias("k"), html.alias("html"))
    copies = keyed.groupBy("site", "k").agg(F.count("*").alias("copies")).where("copies > 1").checkpoint()
    few = copies.limit(broadcast_entries + 1).count() <= broadcast_entries
    seen = keyed.select("site", "k", F.arrow_udf(_rows, kind)("html").alias("x")).join(F.broadcast(copies) if few else copies, ["site", "k"], "left")
    rows = seen.select("site", (1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode("x").alias("x")).select("site", "share", "x.*")
    summed = rows.groupBy("site", "node", "what", "value", "up").agg(F.sum("share").alias("c"), F.sum(F.col("share") * F.col("words")).alias("words"), F.max("role").alias("role"))
    only = lambda what, x: F.when(F.col("what") == what, x)
    c = F.greatest("c", F.lit(1.0))
    nodes = summed.groupBy("site", "node").agg(
        F.max(only(2, c)).alias("n"), F.max("words").alias("words"), F.max(only(2, F.col("role"))).alias("mark"), F.max("up").alias("up"),
        F.sum(only(0, c * F.log(c))).alias("clogc"), F.count(only(1, c)).alias("features"), F.sum(only(1, F.log(c))).alias("spread"),
    )
    n, many = F.col("n"), F.col("n") > 1.5
    nodes = nodes.withColumns({
        "role": F.shiftright("mark", 2).cast("int"), "outer": F.col("mark") % 4 >= 2, "prose": F.col("mark") % 2 == 0,
        "presentation": F.when(many, F.greatest(F.lit(0.0), F.log("n") - F.col("clogc") / n) / F.log("n")).otherwise(1.0),
        "content": F.when(many & (F.col("features") > 0), F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("features") / F.log("n"))).otherwise(1.0),
    })
    own = (F.col("presentation") + FLOOR) / (1 + FLOOR) * F.col("content")
    nodes = nodes.withColumn("own", (n * own + prior_pages * F.col("role") / 2) / (n + prior_pages)).select("site", "node", "n", "role", "outer", "prose", "up", "words", "presentation", "content", "own").checkpoint()
    below = nodes.select("site", F.explode("up").alias("node"), "words", (F.col("words") * F.col("own")).alias("mass"))
    sums = below.groupBy("site", "node").agg(F.sum("words").alias("all_words"), F.sum("mass").alias("mass"))
    direct = nodes.where(F.col("prose") & (F.size("up") > 1)).groupBy("site", F.element_at("up", -2).alias("node")).agg(F.sum(F.col("words") * F.col("own")).alias("running"))
    whole = nodes.join(sums, ["site", "node"]).join(direct, ["site", "node"], "left")
    composite = F.when(F.col("all_words") > 0, F.col("mass") / F.col("all_words")).otherwise(F.col("own"))
    return whole.select("site", "node", "n", "role", "outer", "prose", "up", "presentation", "content", composite.alias("importance"), "mass", (F.coalesce("running", F.lit(0.0)) * 2 > F.col("mass")).alias("running"))


def exceptions(trees: DataFrame, *, ratio: float = RATIO, repeat: float = REPEAT, support: float = SUPPORT, repeat_pages: float = REPEAT_PAGES) -> DataFrame:
    """(site, node): plain branches that go, and noise-like ones that stay."""
    root = trees.where(F.size("up") == 1).select("site", F.col("n").alias("pages"), F.col("mass").alias("whole"))
    t = trees.join(root, "site")
    core = t.where(~F.col("prose") & (F.col("mass") * 2 > F.col("whole")))
    yard = core.groupBy("site").agg(F.max_by("importance", F.size("up")).alias("yard"))
    parts = t.where("running").select("site", F.col("node").alias("part"), F.lit(True).alias("in_running"))
    above = t.select("site", "node", F.explode(F.slice("up", 1, F.size("up") - 1)).alias("part")).join(parts, ["site", "part"]).select("site", "node", "in_running").distinct()
    judged = t.join(yard, "site", "left").join(above, ["site", "node"], "left").where((F.size("up") > 1) & (F.col("n") >= support * F.col("pages")))
    low = F.col("importance") < ratio * F.col("yard")
    repeats = (F.col("n") * F.col("content") + repeat_pages) / (F.col("n") + repeat_pages) < repeat
    text, plain = F.col("role") == TEXT, F.col("role") == PLAIN
    kept = F.coalesce(F.col("in_running"), F.lit(False)) | F.col("prose")
    turned = F.when(text, repeats & ~F.col("prose")).when(plain, F.when(kept, repeats).otherwise(low | repeats)).otherwise(F.col("outer") & ~low & ~repeats)
    return judged.where(turned).select("site", "node")


def extract_main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "text", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Every row of ``pages`` with its main text in ``text_col``."""
    if text_col in pages.columns or {"_site", "_salt", "_turned"} & set(pages.columns):
        raise ValueError("a column name clashes")
    reliable_checkpoints(pages.sparkSession)
    small_batches(pages.sparkSession)
    turned = exceptions(site_style_trees(pages, url_col=url_col, html_col=html_col, broadcast_entries=broadcast_entries)).checkpoint()
    few = turned.limit(broadcast_entries + 1).count() <= broadcast_entries
    lists = turned.groupBy(F.col("site").alias("_site")).agg(F.collect_list("node").alias("_turned"))
    keyed = pages.withColumn("_site", F.xxhash64(site_of(F.col(url_col))))
    if few:
        joined = keyed.join(F.broadcast(lists), "_site", "left")
    else:
        salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int")).join(salted, ["_site", "_salt"], "left")

    @F.arrow_udf(T.StringType())
    def text(html: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py(), set(x.as_py() or ())) for h, x in zip(html, lists, strict=True)], pa.string())

    return joined.select(*pages.columns, text(F.col(html_col), F.col("_turned")).alias(text_col))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
