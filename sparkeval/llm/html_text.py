"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of element paths (tag and class names from the
root; pages with an ``article`` or ``main`` and pages without are told apart).  Every page
names the branches that are to be judged, and for each one Spark aggregates

* the entropy of its contents over the pages that have it, and that of its presentation (the
  kinds of its children): what every page repeats is template, what differs is content.  The
  larger of the two is taken relative to the entropy of the main container (or of the whole
  page, where there is none), so that copies of an article are no template;
* the share of its characters that are link text;
* a prior: what its place, its tag and its class names say of it before any other page is seen.

The importance adds these up as log odds, so none of them decides alone: the prior (0.6 for containers in the
main container and for blocks of pages without one, -1.2 beside the main container; less 2.5 for a tag such as
``nav`` or ``footer`` or for names that are all words of menus, adverts, notices, comments and the like, less 1.3 for
weaker words such as ``widget`` or ``related``, and in proportion if only some of the words are such), 0.3, the entropy term
``1.5 * (2 * v - 1) * n / (n + 2)`` of a relative entropy ``v`` over ``n`` pages (few pages are little evidence, and one
page, which can't vary, speaks for content by 0.5), and -2.5 for all text being links.  So a second part of a story beside its
article stays where it differs from page to page, a box inside an article that repeats goes, and a section called
"promotion-history" stays.  On a page without a main container a name counts less the more of the page's text the branch holds
(1 less the fourth power of its share), for a form or "sidebar layout" may hold the whole page.  Hidden elements
are not shown and always go.

A branch below ``threshold`` is removed from every page of its host;
the text of the rest is returned.  Paragraphs, headings and lists of the main container are judged with the
container they are in, inline elements with their block, and what is inside a branch with a negative prior with that branch.

The statistics are distributed aggregates over (host, node, value); copies of a page count
once.  The removed nodes of a host reach its pages by a join, which Spark may broadcast if
the measured size is below its threshold, and whose skew it handles otherwise.

Cases: null, empty and very long pages, deep nesting, unclosed tags and stray ends are all
read to the end, in time that grows with the length; a null or odd url gives its own host;
repeated rows give repeated rows and count once in the tree; a tie with the threshold stays;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import gc
import html
import re
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# The elements by their role.
RAW = "script|style|noscript|template|textarea|iframe|svg|select|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: The open elements that a start tag closes: a block ends the paragraph around it.
CLOSED_BY = {t: (("p",) if t in BLOCKS and t != "br" else ()) + CLOSES.get(t, ()) for t in BLOCKS | CLOSES.keys()}
SCOPE = frozenset("html body article main section div table ul ol dl nav aside header footer form td th blockquote figure button".split())
NOISE_TAGS = frozenset("head nav menu aside footer form button dialog input label fieldset".split())
OUTER_NOISE = frozenset(("header",))  # noise only outside the main container
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments disqus respond replies"
    " share sharing social related recommended recommendations widget login search toolbar skip form".split()
)
#: Words that name parts of articles as well, and weigh less.
WEAK_WORDS = frozenset("promotion promo widget related recommended recommendations social share sharing search rail toolbar skip replies respond banner alert overlay".split())
OUTER_WORDS = frozenset("header masthead topbar hero".split())
MAIN = frozenset(("article", "main"))
WRAPPERS = frozenset(("form", "fieldset"))  # may hold a main container
BOXES = frozenset("div section center details dialog address hgroup".split())
LOW = 0.0  # branches of a lower importance are removed
#: The terms of the importance, in log odds.
INSIDE, BESIDE, NOISE, WEAK, HIDDEN, BIAS, ENTROPY, LINKS = 0.6, -1.2, -2.5, -1.3, -9.0, 0.3, 1.5, -2.5

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<own>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW.split("|")}
TO_THE_END = frozenset(("script", "style"))  # hide the rest of the page if they are not closed
EMPTY = re.compile(r"(?:^|[\s\"']|(?<![^\s\"'])[^=\s\"']+)/\Z")  # a last slash that is no unquoted value's
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _label(tag: str, attrs: str) -> tuple[str, frozenset, bool]:
    """Tag with class names, the words of class, id and role, and whether it is hidden."""
    if not attrs or attrs.isspace():
        return tag, frozenset(), False
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    classes = found.get("class", "")
    words = frozenset(w.lower() for w in WORDS.findall(f"{classes} {found.get('id', '')} {found.get('role', '')}"))
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", VALUE.sub("= ", attrs))) or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true"
    return ".".join([tag, *sorted(classes.split())]), words, hidden


class _Node:
    """An open or closed element of a page."""

    __slots__ = ("tag", "label", "parent", "noise", "hidden", "shade", "main", "holds", "linked", "parts", "kids", "frame", "chars", "links", "print", "key", "weight", "gone", "named", "judged")

    def __init__(self, tag: str, label: str, parent: _Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.noise = self.hidden = self.shade = self.main = self.holds = self.linked = False
        # texts and children in their order, kinds of children, tags that are open in this scope
        self.parts, self.kids, self.frame = [], {}, {}
        self.chars = self.links = self.print = self.key = 0
        self.weight, self.gone, self.named, self.judged = None, False, 0.0, False


def _child(parent: _Node, tag: str, attrs: str) -> _Node:
    label, words, hidden = _label(tag, attrs)
    page = tag in ("html", "body")
    bad = NOISE_WORDS if parent.main else NOISE_WORDS | OUTER_WORDS
    # what the tag and the names say: all of it, or the share of the words that are such
    said = NOISE if tag in NOISE_TAGS or not parent.main and tag in OUTER_NOISE else 0.0
    if words and not page and (hits := words & bad):
        said = min(said, sum(WEAK if w in WEAK_WORDS else NOISE for w in hits) / len(words))
    named = hidden or said < 0
    # what is noise by an attribute has a path of its own
    node = _Node(tag, label + ("!" if hidden else "~" if named else ""), parent)
    node.noise, node.hidden, node.linked, node.named = named, hidden, parent.linked or tag == "a", said
    # nothing is main inside noise, but for the wrappers of whole pages
    node.shade = parent.shade or named and (hidden or tag not in WRAPPERS)
    node.main = not named and (parent.main or not node.shade and (tag in MAIN or "role" in attrs and "main" in words))
    if node.main and not parent.main:
        up = parent
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
    parent.parts.append(node)
    parent.kids[tag] = True
    return node


@contextmanager
def _uncollected():
    """Without looking for garbage: all that reading makes is kept, and to look through it again and again takes time."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


class Page:
    """The elements of a page in the order of their starts, and its events (element, text); text None ends a block."""

    def __init__(self, page: str | None):
        root = _Node("", "", None)
        self.nodes, self.events = [root], []
        with _uncollected():
            self._read(page or "", root)
            self._judge(root)

    def _judge(self, root: _Node) -> None:
        self.has_main = root.holds
        for n in reversed(self.nodes):
            for c in n.parts:
                if isinstance(c, _Node):
                    n.chars += c.chars
                    n.links += c.links
            n.print = xxhash.xxh64_intdigest(repr([c.print if isinstance(c, _Node) else c for c in n.parts])) >> 1 if n.parts else 0
        root.key = 1 + self.has_main
        for n in self.nodes[1:]:
            n.key = xxhash.xxh64_intdigest(n.label, n.parent.key)
            n.weight, n.judged = self._weight(n)

    def _weight(self, n: _Node) -> tuple[float | None, bool]:
        """The prior of a branch, and whether it is judged by itself."""
        above = n.parent.weight
        if n.holds:
            return None, False
        if above is not None and above < 0:
            return above, False  # goes with the branch around it
        prior = self._prior(n)
        return prior, prior is not None

    def _prior(self, n: _Node) -> float | None:
        if n.hidden:
            return HIDDEN
        inside = n.parent.main or not self.has_main
        if n.noise:
            whole = 1.0 if self.has_main else 1 - ((n.chars - n.links) / max(1, self.nodes[0].chars - self.nodes[0].links)) ** 4
            return (INSIDE if inside else BESIDE) + n.named * whole
        if n.main:
            return INSIDE if n.tag in BOXES and n.parent.main else None
        if self.has_main:
            return BESIDE
        return INSIDE if n.tag in BLOCKS and n.tag not in ("html", "body") else None

    def _read(self, page: str, root: _Node) -> None:
        stack, events, opened, frame = [root], self.events, {}, root.frame
        at, unclosed = 0, set()

        def pop() -> str:
            n = stack.pop()
            opened[n.tag] -= 1
            scope = stack[-1].frame
            if scope.get(n.tag):
                scope[n.tag] -= 1
            return n.tag

        while m := TOKEN.match(page, at):
            at, raw = m.end(), m["raw"]
            if raw:
                raw = raw.lower()
                if raw == "svg" and EMPTY.search(m["own"]):
                    continue
                stop = None if raw in unclosed else RAW_END[raw].search(page, at)
                if stop:
                    at = stop.end()
                    continue
                if raw in TO_THE_END:
                    break
                unclosed.add(raw)  # no end follows: an ordinary element, whose text is the page's
            text = m["text"]
            if text is not None:
                text, top = html.unescape(text), stack[-1]
                events.append((top, text))
                if not text.isspace():
                    words = " ".join(text.split())
                    top.parts.append(xxhash.xxh64_intdigest(words))
                    top.chars += len(words)
                    top.links += len(words) if top.linked else 0
                continue
            tag = raw or m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in BLOCKS
            if block:
                events.append((stack[-1], None))
            if m["end"]:
                if opened.get(tag):
                    # an inline end does not close the block around it
                    while len(stack) > 1:
                        if stack[-1].tag != tag and not block and stack[-1].tag in BLOCKS:
                            break
                        if pop() == tag:
                            break
                continue
            attrs = m["own"] if raw else m["attrs"]
            closes, frame = CLOSED_BY.get(tag, ()), stack[-1].frame
            for c in closes:
                if frame.get(c):
                    while pop() not in closes:
                        pass
                    break
            node = _child(stack[-1], tag, attrs)
            self.nodes.append(node)
            if tag not in VOID and not attrs.rstrip().endswith("/") or tag in MAIN:
                opened[tag] = opened.get(tag, 0) + 1
                if tag not in SCOPE or tag in ("td", "th"):
                    node.frame = stack[-1].frame  # within one scope the counts are shared
                    node.frame[tag] = node.frame.get(tag, 0) + 1
                stack.append(node)

    def branches(self) -> list[tuple]:
        """For each path that is to be judged: (key, weight, content, layout, reference, chars, link chars)."""
        with _uncollected():
            return list(self._branches())

    def _branches(self):
        root, inner = self.nodes[0], [n for n in self.nodes if n.main and not n.parent.main]
        main = xxhash.xxh64_intdigest(repr([n.print for n in inner])) >> 1
        found: dict = {}
        for n in self.nodes[1:]:
            if n.judged:
                found.setdefault(n.key, []).append(n)
            elif n.holds or n is root:
                texts = [c for c in n.parts if not isinstance(c, _Node)]
                if texts:  # words beside the main container
                    own = _Node("", "#text", n)
                    own.key, own.weight, own.print = _beside(n), BESIDE, xxhash.xxh64_intdigest(repr(texts)) >> 1
                    found.setdefault(own.key, []).append(own)
        reference = main if inner else root.print
        for key, ns in found.items():
            if len(ns) == 1:
                n = ns[0]
                yield _signed(key), n.weight, n.print, xxhash.xxh64_intdigest(",".join(n.kids)) >> 1, reference, n.chars, n.links
                continue
            content = xxhash.xxh64_intdigest(repr([n.print for n in ns])) >> 1
            layout = xxhash.xxh64_intdigest(",".join(dict.fromkeys(k for n in ns for k in n.kids))) >> 1
            yield _signed(key), max(n.weight for n in ns), content, layout, reference, sum(n.chars for n in ns), sum(n.links for n in ns)

    def text(self, removed) -> str:
        """The text of the branches that stay, blocks joined by one space."""
        blocks, now = [], []
        self.nodes[0].gone = _signed(_beside(self.nodes[0])) in removed
        for n in self.nodes[1:]:
            n.gone = n.parent.gone and not n.parent.holds or _signed(n.key) in removed or n.holds and _signed(_beside(n)) in removed
        for n, t in self.events:
            if t is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif not n.gone:
                now.append(t)
        if now:
            blocks.append("".join(now))
        return " ".join(w for b in blocks for w in b.split())


def _beside(n: _Node) -> int:
    """The name of the words that stand directly in an element around the main container."""
    return xxhash.xxh64_intdigest("#text", n.key)


def _signed(key: int) -> int:
    return key - (1 << 63)


def importance(weight, varied, chars, links, n):
    """The importance of a branch on ``n`` pages, of numbers or of columns; see the module's text."""
    return weight + BIAS + ENTROPY * (2 * varied - 1) * n / (n + 2) + LINKS * links / chars


def main_text(page: str | None, removed: frozenset, threshold: float = LOW) -> str:
    """The main text of a page that is a site of its own, without the branches ``removed`` as well."""
    doc = Page(page)
    low = {b[0] for b in doc.branches() if importance(b[1], 1.0, max(1, b[5]), b[6], 1) < threshold}
    return doc.text(low | removed)


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, node, n, varied, importance``: the merged trees of ``pages(host, html)``."""
    schema = "host string, page long, node long, weight double, content long, layout long, reference long, chars long, links long"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for k, (host, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), 1):
                print_ = xxhash.xxh64_intdigest(page or "") >> 1
                rows += [(host, print_, *n) for n in Page(page).branches()]
                if rows and (len(rows) > 50_000 or k == b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []

    nodes = pages.select("host", "html").mapInArrow(run, schema)
    once = nodes.groupBy("host", "node", "content", "layout", "reference", "page").agg(*[F.max(c).alias(c) for c in ("weight", "chars", "links")])
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("content", "layout", "reference"))]))
    sums = [F.sum(c).alias(c) for c in ("weight", "chars", "links")]
    counted = once.select("host", "node", "weight", "chars", "links", value.alias("v")).groupBy("host", "node", "v.kind", "v.value").agg(F.count("*").alias("c"), *sums)
    entropy = counted.groupBy("host", "node", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"), *[F.sum(c).alias(c) for c in ("weight", "chars", "links")])
    part = F.when(F.col("n") < 2, 1.0).otherwise(1 - F.col("s") / (F.col("n") * F.log2(F.greatest("n", F.lit(2)).cast("double"))))
    kind = lambda k: F.max(F.when(F.col("kind") == k, part))
    merged = entropy.groupBy("host", "node").agg(
        F.max("n").alias("n"), F.greatest(kind(0), kind(1)).alias("own"), kind(2).alias("whole"), (F.max("weight") / F.max("n")).alias("weight"), F.max("chars").alias("chars"), F.max("links").alias("links")
    )
    varied = F.when(F.col("whole") > 1e-9, F.least(F.lit(1.0), F.col("own") / F.col("whole"))).otherwise(1.0)
    judged = merged.withColumn("varied", varied).withColumn("chars", F.greatest("chars", F.lit(1)))
    return judged.select("host", "node", "n", "varied", importance(F.col("weight"), F.col("varied"), F.col("chars"), F.col("links"), F.col("n")).alias("importance"))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def with_removed(rows: DataFrame, removed: DataFrame, most_nodes: int, salts: int) -> DataFrame:
    """``rows(id, host, ...)`` with the ``removed`` nodes of their host.

    Up to ``most_nodes`` nodes, as counted, are broadcast, and the pages stay where they are.
    Beyond that the two sides are shuffled, the pages of a host over ``salts`` parts.
    """
    size = removed.agg(F.coalesce(F.sum(F.size("removed") + 8), F.lit(0))).first()[0]
    if size <= most_nodes:
        return rows.join(F.broadcast(removed), "host", "left")
    spread = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["host", "salt"], "left").drop("salt")


def extract(
    pages: DataFrame, threshold: float = LOW, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_nodes: int = 2_000_000, salts: int = 32
) -> DataFrame:
    """``id, url, text`` for every row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    low = style_tree(rows).where(F.col("importance") < threshold)
    removed = low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("removed"))
    removed = cut(pages.sparkSession, removed)  # read twice: to be measured, and to be joined
    joined = with_removed(rows, removed, most_nodes, salts).select("id", "url", "html", "removed")

    def run(batches):
        cache: dict = {}
        for b in batches:
            texts = []
            for page, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                key = tuple(gone or ())
                if key not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[key] = frozenset(key)
                texts.append(Page(page).text(cache[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
