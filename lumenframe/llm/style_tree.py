"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged: a style node is a path of
element names and classes. Pages with the same article count once. For every
node the articles in which each of its text blocks (content) and each sequence
of child elements (presentation) occurs are counted. A block that is spread
evenly over the m articles of its node has entropy log m, one that occurs once
has none; a node's importance is 1 less the mean entropy of the blocks below it
(in units of log m), with a tenth of weight on the variety of its presentation.
Branches of low importance repeat from page to page and are removed, paragraphs
of a marked article like any other branch, and so is a single block that more
than half of the host's distinct articles repeat.

Roles are the prior. Elements and names that can only be menus, adverts, forms
or comments are removed without evidence, as page-specific comments look like
text to the tree; so is all beside a marked article. Names that may also name a
subject (share, related, search) only lower what the tree is asked for: such a
branch stays if 32 distinct articles of the host have shown it to be page-specific
text. A name counts
only as a whole (share-price and with-sidebar are no role).

Defined cases: a null page is empty; a null or unreadable url has the host "";
nodes seen in fewer than 8 distinct articles of a host are left to their roles;
an article of which nothing else would be left stays whole (copies of an
article); elements nested deeper than 64 share the style node of their 64th
ancestor; unclosed elements are closed as browsers do, and the end tag of an
inline element reaches no further than its block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.staging import BROADCAST_ROWS, Stages

LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.2
#: Importance from which a branch stays although its name is often that of a widget.
TEXT_IMPORTANCE = 0.9
#: Distinct articles in which it has to be seen for that.
TEXT_PAGES = 32
#: Levels of nesting that the style tree tells apart.
LEVELS = 64
PRESENTATION_WEIGHT = 0.1
#: Share of a host's distinct articles above which a block that they repeat is removed.
MOST_SHARE = 0.5
SALTS = 32
#: Pages that are parsed at a time.
PARSED_ROWS = 64

# Element names of HTML, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style".split())
NO_CONTENT = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg canvas object video audio dialog menu".split())
ARTICLE = frozenset("article main".split())
CLOSED_BY_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Elements that end each other.
KIN = (("dt", "dd"), ("td", "th"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role attributes that mark what is no article.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comments comment respond reply replies disqus pagination pager complementary contentinfo".split())
PAGE_NOISE = NOISE | {"header"}
# Words that name widgets as well as subjects.
WEAK = frozenset("share sharing social related recommended recommendations trending search overlay widget widgets toolbar topbar".split())
# Words that may stand beside them in a name (site-footer, related-posts) without changing what it is.
PLACE = frozenset("site page main global top bottom left right upper lower primary secondary container wrapper wrap area list box block section inner outer bar links link item items form panel posts post articles stories slot unit".split())
ARTICLE_NOISE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class Node:
    """An open element. gone: it or an ancestor can be no article by its element, off: or by its name; weak: a name puts it in doubt; low: the style tree rejects it."""

    __slots__ = ("article", "block_at", "children", "depth", "gone", "key", "label", "low", "off", "tag", "up", "weak")

    def __init__(self, tag: str, label: str, up: Node | None):
        self.tag, self.label, self.up, self.children = tag, label, up, []
        self.article, self.gone, self.off, self.low, self.weak = (up.article, up.gone, up.off, up.low, up.weak) if up else (False,) * 5
        self.depth, self.key, self.block_at = (up.depth, up.key, up.block_at) if up else (0, 0, 0)

    def chain(self) -> list[int]:
        """Keys of the style nodes on the way down to this one."""
        out, node = [], self
        while node.up is not None:
            if not out or out[-1] != node.key:
                out.append(node.key)
            node = node.up
        return out[::-1]


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("node", "text")

    def __init__(self, text: str, node: Node):
        self.text, self.node = text, node


def key64(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)}


def _marked(tag: str, attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a whole class, role or id says one of the words, with nothing but words of WEAK and PLACE beside it; ids of headings name what they head."""
    for name in ("class", "role", "id"):
        if name == "id" and tag in HEADINGS:
            continue
        for token in attrs.get(name, "").lower().split():
            found = set(_WORD.findall(token))
            if found & words and found <= words | WEAK | PLACE:
                return True
    return False


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def parse(page: str, low: frozenset[int] = frozenset(), text_like: frozenset[int] = frozenset()) -> tuple[list[Block], list[Node]]:
    """The text blocks in page order, and all block-level nodes. low, text_like: keys of style nodes of low importance, and of those that are text in spite of their names.

    Linear in the page: nodes know their block and inherit what their ancestors
    say, and open elements are found by their name.
    """
    root = Node("", "", None)
    stack, nodes, blocks, parts = [root], [], [], []
    place = root
    named: dict[str, list[int]] = {}  # places on the stack by element name

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(Block(text, place))

    def close_to(i: int) -> None:
        while len(stack) > i:
            named[stack.pop().tag].pop()

    def last(*tags: str) -> int:
        return max((named[t][-1] for t in tags if named.get(t)), default=0)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            top = stack[-1]
            holder = stack[top.block_at]
            if holder is not place and parts:
                flush()
            if not top.off or holder.off:  # else an inline element that is no article within text that is
                place = holder
                parts.append(m["text"] if m["text"] is not None else m["cdata"])
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            i = last(tag)
            if tag not in INLINE:
                flush()
                if i:
                    close_to(i)
            elif i > stack[-1].block_at:
                close_to(i)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            i = stack[-1].block_at
            if stack[i].tag == "p":
                close_to(i)
            if tag in CLOSED_BY_SAME:
                i = last(*next((kin for kin in KIN if tag in kin), (tag,)))
                if i > last(*CLOSED_BY_SAME[tag]):
                    close_to(i)
        if tag in VOID:
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        up = stack[-1]
        node = Node(tag, tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").lower().split())), up)
        node.article = up.article or tag in ARTICLE
        if tag not in INLINE:
            node.block_at, node.depth = len(stack), up.depth + 1
            if node.depth <= LEVELS:
                node.key = key64(f"{up.key}/{node.label}")
        node.gone = up.gone or tag in NO_CONTENT or (tag == "header" and not node.article) or _hidden(attrs)
        if tag in ARTICLE:  # names of a wrapper around the first article do not reach into it
            node.off = node.gone or _marked(tag, attrs, ARTICLE_NOISE) or (up.off and up.article)
            node.weak = up.weak and up.article
        else:
            node.off = up.off or node.gone or (tag not in ("html", "body") and _marked(tag, attrs, NOISE if node.article else PAGE_NOISE))
            if tag not in INLINE and not node.off and _marked(tag, attrs, WEAK):
                node.weak = up.weak or node.key not in text_like
                node.label += "?"
        node.low = up.low or node.key in low
        if tag not in INLINE:
            above = stack[up.block_at]
            if not above.children or above.children[-1] != node.label:
                above.children.append(node.label)
            nodes.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            at = found.end() if found else end
            continue
        if not m["attrs"].endswith("/") or tag not in ("svg",):
            named.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    return blocks, nodes


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


_EVIDENCE = "page_id long, host string, article long, found array<struct<path:long,kind:int,feature:long,chain:array<long>>>"


def candidates(blocks: list[Block]) -> list[Block]:
    """The blocks that roles leave: those of the marked article, or else of the page."""
    live = [b for b in blocks if not b.node.off]
    return [b for b in live if b.node.article] if any(b.node.article for b in live) else live


def features(page: str | None) -> tuple[int, list[tuple[int, int, int, list[int] | None]]]:
    """The key of a page's article and its features (path, kind, feature, chain): kind 0 of a node itself (feature 1: its name is in doubt), 1 of a text block in it, 2 of its sequence of child elements, 3 of a text block of the article, 4 of an article (paths 0)."""
    blocks, nodes = parse(page or "")
    out, chains = set(), {}
    for b in blocks:
        if not b.node.off:
            chains.setdefault(b.node.key, b.node)
            out.add((b.node.key, 1, key64(b.text)))
    doubtful = set()
    for n in nodes:
        if not n.off and (n.children or n.label.endswith("?")):
            chains.setdefault(n.key, n)
            out.add((n.key, 2, key64(" ".join(n.children))))
            if n.label.endswith("?"):
                doubtful.add(n.key)
    live = candidates(blocks)
    out.update((0, 3, key64(b.text)) for b in live)
    if live:
        out.add((0, 4, 0))
    rows = [(k, 0, int(k in doubtful), n.chain()) for k, n in chains.items()]
    return key64("\n".join(b.text for b in live if not b.node.weak)), rows + [(*x, None) for x in sorted(out)]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found_type = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("chain", pa.list_(pa.int64()))]))
    names = ("path", "kind", "feature", "chain")
    for batch in batches:
        for at in range(0, batch.num_rows, PARSED_ROWS):
            part = batch.slice(at, PARSED_ROWS)
            got = [features(html) for html in part.column(2).to_pylist()]
            hosts = [host_of(url) for url in part.column(1).to_pylist()]
            found = [[dict(zip(names, x, strict=True)) for x in rows] for _, rows in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hosts, pa.string()), pa.array([a for a, _ in got], pa.int64()), pa.array(found, found_type)], ["page_id", "host", "article", "found"])


def evidence(pages: DataFrame) -> DataFrame:
    """host, path, kind, feature, chain, k (distinct articles) of all features; kept in a table, as it is read for nodes and for blocks.

    Of the pages with one article the first counts. They are dealt by host and
    article, so a host with a third of all pages is spread over all tasks.
    """
    shown = pages.select("page_id", "url", "html").mapInArrow(_evidence, _EVIDENCE)
    once = shown.groupBy("host", "article").agg(F.min_by("found", F.struct("page_id", "found")).alias("found"))
    spread = once.select("host", F.explode("found").alias("f")).groupBy("host", "f.path", "f.kind", "f.feature").agg(F.count(F.lit(1)).alias("k"), F.max("f.chain").alias("chain"))
    return Stages(pages.sparkSession, "evidence").write(spread)


def repeated_blocks(spread: DataFrame, least_articles: int = LEAST_PAGES, most_share: float = MOST_SHARE) -> DataFrame:
    """host, block of every text block that more than most_share of the host's distinct articles have."""
    articles = spread.filter("kind = 4").select("host", F.col("k").alias("articles"))
    times = spread.filter("kind = 3").select("host", F.col("feature").alias("block"), F.col("k").alias("times")).filter(F.col("times") > most_share * least_articles)
    return times.join(articles, "host").filter((F.col("articles") >= least_articles) & (F.col("times") > most_share * F.col("articles"))).select("host", "block")


def style_tree(spread: DataFrame) -> DataFrame:
    """host, path, articles, importance, doubtful of every style node in the evidence."""
    nodes = spread.filter("kind < 3").groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("m"),
        F.max(F.when(F.col("kind") == 0, F.col("feature"))).alias("doubtful"),
        F.max("chain").alias("chain"),
        F.sum(F.when(F.col("kind") == 1, F.log("k"))).alias("spread"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("blocks"),
        F.sum(F.when(F.col("kind") == 2, F.col("k") * F.log("k"))).alias("same"),
        F.sum(F.when(F.col("kind") == 2, F.col("k"))).alias("shown"),
    )
    nodes = Stages(spread.sparkSession, "nodes").write(nodes)  # read twice below
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)))
    nodes = nodes.withColumn("entropy", F.coalesce("spread", F.lit(0.0)) / log_m).withColumn("variety", F.when(F.col("shown") > 1, (F.log("shown") - F.col("same") / F.col("shown")) / log_m))
    below = nodes.select("host", F.explode("chain").alias("path"), "entropy", "blocks").groupBy("host", "path").agg(F.sum("entropy").alias("entropy"), F.sum("blocks").alias("blocks"))
    content = F.when(F.col("blocks") > 0, 1 - F.col("entropy") / F.col("blocks")).otherwise(F.lit(1.0))
    w = F.when(F.col("variety").isNotNull(), F.lit(PRESENTATION_WEIGHT)).otherwise(F.lit(0.0))
    own = nodes.select("host", "path", F.col("m").alias("articles"), "variety", "doubtful")
    return own.join(below, ["host", "path"]).select("host", "path", "articles", ((1 - w) * content + w * F.coalesce("variety", F.lit(0.0))).alias("importance"), (F.col("doubtful") > 0).alias("doubtful"))


def main_text(page: str | None, low: frozenset[int] = frozenset(), repeated: frozenset[int] = frozenset(), text_like: frozenset[int] = frozenset()) -> str:
    """The page's article. Of its host, low: keys of style nodes of low importance, repeated: of text blocks that its articles repeat, text_like: of nodes that are text in spite of their names."""
    blocks, _ = parse(page or "", low, text_like)
    live = [b for b in candidates(blocks) if not b.node.weak]
    live = [b for b in live if not b.node.low] or [b for b in live if b.node.article]
    live = [b for b in live if key64(b.text) not in repeated] or live
    return "\n".join(b.text for b in live)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: dict[tuple, frozenset[int]] = {}
        for at in range(0, batch.num_rows, PARSED_ROWS):
            part = batch.slice(at, PARSED_ROWS)
            texts = []
            for html, *keys in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True):
                texts.append(main_text(html, *(sets.setdefault(key, frozenset(key)) for key in (tuple(k or ()) for k in keys))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    spread = evidence(base)
    known = style_tree(spread).filter(F.col("articles") >= least_pages)
    none = F.lit(None).cast("long")
    low = known.filter(F.col("importance") < least_importance).select("host", F.col("path").alias("low"), none.alias("block"), none.alias("text"))
    text_like = known.filter(F.col("doubtful") & (F.col("articles") >= TEXT_PAGES) & (F.col("importance") >= TEXT_IMPORTANCE)).select("host", none.alias("low"), none.alias("block"), F.col("path").alias("text"))
    found = low.unionByName(text_like).unionByName(repeated_blocks(spread, least_pages).select("host", none.alias("low"), "block", none.alias("text")))
    sets = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (("low", "low"), ("block", "repeated"), ("text", "text_like"))]
    found = Stages(pages.sparkSession, "styles").write(found.groupBy("host").agg(*sets))
    named = base.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)))
    n, keys = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("low") + F.size("repeated") + F.size("text_like")), F.lit(0))).first()
    if n + keys <= BROADCAST_ROWS:
        named = named.join(F.broadcast(found), "host", "left")
    else:  # a host with many pages is dealt over SALTS tasks
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = named.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    return named.select("page_id", "url", "html", "low", "repeated", "text_like").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
