"""Main text of HTML pages by site style trees.

The pages of a host are merged into one tree: a node is the path of block elements from the root, by tag and class. Per
node are counted the pages that have it, its presentations (the sequence of its child elements) and its contents (the
texts of its blocks). Two importances follow, from 0 to 1: that of presentation is the entropy of the presentations over the
logarithm of the number of pages; that of content is one less the mean entropy of a text over the pages that
have it, so texts that stand on all pages of a host count nothing. Both are drawn towards the same node over all hosts while
a host has few pages.

A branch ends in a block of text. Its score is the mean of the importance of its content and of the highest importance of
presentation on its path. Inside an article or main element all pages share the presentation, so the block's own text at its
node is weighed instead: one less the logarithm of the pages that have it over that of the pages that have the node, drawn
likewise, and raised by less than what a block must reach. If that would take more than half of the characters of an
article, the article is a copy and stays whole. Blocks of low score are removed, and whatever
stands in an element whose tag, role or class says that it is no content (menus, footers, forms and the like).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pick, slices
from millrace.session import materialize

#: Pages of all hosts that count as much as the pages of one.
PRIOR_PAGES = 5.0
THRESHOLD = 0.55
#: Raises blocks in an article; below ``THRESHOLD``, so that text on all pages is not kept by it.
ARTICLE = 0.5

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the second kind closes an open one of the first kind, up to the elements that hold them.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
HOLDS = frozenset("ul ol menu dl table article aside div section main body".split())

#: Words of tags, roles, classes and ids that say what is no content.
OTHER_TAGS = frozenset("nav footer aside form button dialog menu search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OTHER_NAMES = frozenset(
    "ad ads adbox advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that may stand behind a listed one in a name: they say how a part is laid out, not what it is about.
LAYOUT = frozenset(
    "area bar block body box btn button buttons card col column container content cta frame group grid holder icons inner "
    "item items label layer left link links list main message outer panel right row section slot strip tab text title top "
    "unit wrap wrapper zone".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements that hold the page; their names speak of the layout.
PAGE_TAGS = ARTICLE_TAGS | {"html", "body"}
#: First words of names that say what a page has, not what an element is.
STATES = frozenset("has have with without no not is js show hide hidden".split())

#: What may begin a token, and what matters inside a tag: its end, or a quoted value.
OPEN = re.compile(r"<(?=[a-zA-Z!?/])")
INSIDE = re.compile(r">|=\s*([\"'])")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[^\W\d_]+")


@dataclass
class Element:
    """An open block element: its tag and node, whether tag or role say that it is no content, and whether it is in an article.

    ``named``: its own names say that it is no content; ``mark`` is the nearest element for which that was so.
    """

    tag: str
    node: int
    other: bool
    article: bool
    parent: Element | None = None
    named: bool = False
    mark: Element | None = None
    outer: Element | None = None
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """Text that stands together: its pieces and the element that holds it."""

    pieces: list[str]
    element: Element

    @property
    def named(self) -> bool:
        """Whether an element around it has a name that says that it is no content; known when the page has been read."""
        mark = self.element.mark
        while mark and not mark.named and mark.outer:
            # marks that were cleared are passed over once: the next block starts behind them
            if not mark.outer.named and mark.outer.outer:
                mark.outer = mark.outer.outer
            else:
                mark = mark.outer
        return mark is not None and mark.named


def _attributes(rest: str) -> tuple[str, bool, str]:
    """Class of the element for its node, whether it is hidden, and all names that it bears."""
    kind, names, hidden = "", [], False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), unescape(next((v for v in values if v), "")).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "role":
            names.append("role=" + value.strip())
        else:
            names.append(value)
            if key == "class":
                kind = " ".join(sorted(re.sub(r"[0-9]+", "", value).split()))
    return kind, hidden, " ".join(names)


def _is_other(tag: str, names: str, in_article: bool) -> bool:
    if tag in OTHER_TAGS or (tag == "header" and not in_article):
        return True
    return "role=" in names and not OTHER_ROLES.isdisjoint(x[5:] for x in names.split() if x.startswith("role="))


def _is_named(names: str, in_article: bool) -> bool:
    """Whether a class or id ends with a listed name, or has only words of the layout behind one: ``cookie-notice``, ``ad-slot``.

    ``share-price`` or ``notice-of-appeal`` name what a text is about; the tree alone decides on these.
    """
    listed = OTHER_NAMES if in_article else OTHER_NAMES | {"header"}
    for name in names.split():
        words = NAME.findall(name)
        if not words or words[0] in STATES or name.startswith("role="):
            continue
        if words[-1] in listed or (words[0] in listed and all(w in LAYOUT or w in listed for w in words[1:])):
            return True
    return False


def _hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Reader:
    """Tokens of a page. Every character is looked at a bounded number of times, whatever is not closed: a search that
    finds nothing is not made again."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.absent: set[str] = set()

    def find(self, text: str, at: int) -> int:
        """The next place of ``text`` from ``at``, or -1; ``at`` never goes back for the same text."""
        if text in self.absent:
            return -1
        found = self.html.find(text, at)
        if found < 0:
            self.absent.add(text)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag whose inside is at ``at`` ends, behind quoted values; -1 if the page ends in it."""
        while True:
            token = INSIDE.search(self.html, at)
            if token is None:
                return -1
            if token[1] is None:
                return token.start()
            close = self.find(token[1], token.end())
            at = token.end() if close < 0 else close + 1  # a quote that nothing closes is a character

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup, or -1."""
        if f"</{tag}" in self.absent:
            return -1
        end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(self.html, at)
        stop = self.find(">", end.end()) if end else -1
        if stop < 0:
            self.absent.add(f"</{tag}")
        return stop + 1 if stop >= 0 else -1


def parse(html: str) -> tuple[list[Block], list[tuple[int, tuple[str, ...]]]]:
    """The blocks of a page in order, and the presentation of each element as (node, tags of its children).

    A tag, comment or declaration that the page ends in is markup, not text.
    """
    reader = Reader(html)
    stack = [Element("", 0, False, False)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    holders = [0]
    blocks: list[Block] = []
    styles: list[tuple[int, tuple[str, ...]]] = []
    pieces: list[str] = []
    found = False

    def flush() -> None:
        if pieces:
            if any(not x.isspace() for x in pieces):
                blocks.append(Block(pieces.copy(), stack[-1]))
            pieces.clear()

    def close(count: int) -> None:
        for _ in range(count):
            done = stack.pop()
            places[done.tag].pop()
            if done.tag in HOLDS:
                holders.pop()
            styles.append((done.node, tuple(done.children)))

    at, n = 0, len(html)
    while at < n:
        token = OPEN.search(html, at)
        if not token:
            pieces.append(html[at:])
            break
        if token.start() > at:
            pieces.append(html[at : token.start()])
        at = token.end()
        first = html[at]
        if first in "!?/" and not (first == "/" and html[at + 1 : at + 2].isalpha()):
            if html.startswith("![CDATA[", at):
                stop = reader.find("]]>", at)
                pieces.append(html[at + 8 : stop if stop >= 0 else n])
                at = stop + 3 if stop >= 0 else n
            else:
                ending = "-->" if html.startswith("!--", at) else ">"
                stop = reader.find(ending, at)
                at = stop + len(ending) if stop >= 0 else n
            continue
        name = TAG_NAME.match(html, at + (first == "/"))
        if name is None:  # a letter beyond ASCII behind the slash
            stop = reader.find(">", at)
            at = stop + 1 if stop >= 0 else n
            continue
        tag = name[0].lower()
        stop = reader.tag_end(name.end())
        if stop < 0:
            break
        rest, at = html[name.end() : stop], stop + 1
        if first == "/":
            if tag in BLOCK:
                flush()
                if places[tag]:
                    close(len(stack) - places[tag][-1])
            continue
        if tag in RAW:
            if not (tag in ("svg", "math") and rest.endswith("/")):
                end = reader.raw_end(tag, at)
                # without an end, code goes on to the end of the page, other elements are passed over
                at = end if end >= 0 else n if tag in ("script", "style") else at
            continue
        if tag == "br":
            pieces.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if tag == "hr":
            continue
        if stack[-1].tag == "p":  # any block closes an open paragraph
            close(1)
        ends = max((places[t][-1] for t in CLOSES.get(tag, ()) if places[t]), default=0)
        if ends > holders[-1]:
            close(len(stack) - ends)
        parent = stack[-1]
        kind, hidden, names = _attributes(rest) if rest else ("", False, "")
        own = tag in ARTICLE_TAGS or "role=main" in names or "role=article" in names
        article = parent.article or own
        other = parent.other or hidden or _is_other(tag, names, parent.article)
        if own and not other and (not found or tag == "main" or "role=main" in names):  # later articles may be comments or teasers
            found, mark = True, parent.mark
            while mark and mark.named:  # what holds a marked element that is cleared has been cleared with it
                mark.named, mark = False, mark.outer
        node = _hash(f"{parent.node}>{tag}.{kind}")
        parent.children.append(tag)
        places[tag].append(len(stack))
        if tag in HOLDS:
            holders.append(len(stack))
        stack.append(Element(tag, node, other, article, parent, mark=parent.mark))
        if names and not own and tag not in PAGE_TAGS and _is_named(names, parent.article):
            top = stack[-1]
            top.named, top.mark, top.outer = True, top, parent.mark
    flush()
    close(len(stack) - 1)
    return blocks, styles


def block_text(block: Block) -> str:
    """The characters of a block with references decoded and single spaces, trimmed."""
    return " ".join(unescape("".join(block.pieces)).split())


def host(url: str = "url") -> Column:
    """Host of a URL in lower case without port; empty if there is none."""
    pattern = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@\s]*@)?([^/?#:\s]*)"
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1))


#: Kinds of observation: a page that has the node, a presentation, a content.
PAGE, STYLE, CONTENT = 0, 1, 2


def page_key() -> Column:
    """Digest of the html: pages of a host that share it have the same text."""
    return F.md5(F.coalesce("html", F.lit("")).cast("binary"))


def observations(pages: DataFrame) -> DataFrame:
    """``host, page, node, kind, value, look``: once for every page, what its tree shows; ``look`` where its text depends on it.

    That is the path of a block outside an article, and the text and node of one inside.
    """
    names = ["host", "page", "node", "kind", "value", "look"]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            rows: list[tuple] = []
            for name, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                blocks, styles = parse(html or "")
                look: set[int] = set()
                texts = {(b.element.node, _hash(block_text(b)), b.element.article and not b.element.other) for b in blocks}
                for b in blocks:
                    e = None if b.element.other or (b.element.article and not b.named) else b.element
                    while e and e.node not in look:
                        look.add(e.node)
                        e = e.parent
                seen = {(node, PAGE, 0, node in look) for node, _ in styles}
                seen |= {(node, STYLE, _hash(">".join(children)), False) for node, children in styles}
                inside = {x[:2] for x in texts if x[2]}
                seen |= {(node, CONTENT, value, (node, value) in inside) for node, value, _ in texts}
                rows += [(name, page, *x) for x in seen]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = pages.select(host().alias("host"), page_key().alias("page"), "html")
    return found.mapInArrow(run, "host string, page string, node bigint, kind int, value bigint, look boolean")


def _importance(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys, pages, style, content`` from ``keys, kind, value, n``: sums that tasks combine before they are shuffled."""
    n = F.col("n").cast("double")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    sums = counts.groupBy(*keys).agg(
        of(PAGE, n).alias("pages"),
        of(STYLE, n).alias("s"),
        of(STYLE, n * F.log(n)).alias("s_log"),
        of(CONTENT, n).alias("c"),
        of(CONTENT, n * F.log(n)).alias("c_log"),
    )
    many = F.when(F.col("pages") > 1, F.log("pages"))
    entropy = F.when(F.col("s") > 0, F.log("s") - F.col("s_log") / F.col("s"))
    style = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), entropy / many)), F.lit(1.0))
    content = F.coalesce(F.lit(1.0) - F.when(F.col("c") > 0, F.col("c_log") / F.col("c")) / many, F.lit(1.0))
    return sums.select(*keys, "pages", style.alias("style"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), content)).alias("content"))


def site_trees(observed: DataFrame) -> DataFrame:
    """``host, node, kind, value, style, content, sure``: the importances of each node of a host, a row each.

    ``sure``: the host has as many pages with the node as count for the others. Rows of kind ``CONTENT`` have the
    importance of one text at a node, where it is so low that an article does not make up for it.
    """
    per_host = materialize(observed.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n")), "nodes")
    everywhere = materialize(per_host.groupBy("node", "kind", "value").agg(F.sum("n").alias("n")), "everywhere")
    nodes = _importance(everywhere, "node").select(
        "node", F.col("pages").alias("all_pages"), F.col("style").alias("all_style"), F.col("content").alias("all_content")
    )
    joined = materialize(_importance(per_host, "host", "node").join(nodes, "node"), "importances")
    drawn = lambda own, all_: (F.col("pages") * own + PRIOR_PAGES * all_) / (F.col("pages") + PRIOR_PAGES)
    sure = (F.col("pages") >= PRIOR_PAGES).alias("sure")
    branches = joined.select(
        "host",
        "node",
        F.lit(PAGE).alias("kind"),
        F.lit(0).cast("bigint").alias("value"),
        drawn(F.col("style"), F.col("all_style")).cast("float").alias("style"),
        drawn(F.col("content"), F.col("all_content")).cast("float").alias("content"),
        sure,
    )
    # a text is only looked up if its host alone could draw it low enough
    low = 2 * (THRESHOLD - ARTICLE)
    rare = lambda n, pages: F.lit(1.0) - F.log(F.col(n)) / F.log(F.col(pages))
    texts = per_host.where(f"kind = {CONTENT} and n > 1").join(joined.select("host", "node", "pages", "all_pages"), ["host", "node"])
    texts = texts.where(drawn(rare("n", "pages"), F.lit(0.0)) < low)
    totals = everywhere.where(f"kind = {CONTENT} and n > 1").withColumnRenamed("n", "all_n")
    texts = texts.join(totals, ["node", "kind", "value"])
    content = drawn(rare("n", "pages"), rare("all_n", "all_pages"))
    texts = texts.select("host", "node", "kind", "value", F.lit(1.0).cast("float").alias("style"), content.cast("float").alias("content"), sure)
    return branches.unionByName(texts.where(F.col("content") < low))


def page_trees(pages: DataFrame) -> DataFrame:
    """``host, page, nodes``: for each page the importances that its own text depends on, found by (host, node)."""
    observed = materialize(observations(pages), "observed")
    trees = materialize(site_trees(observed), "trees")
    looked = observed.where("look").select("host", "page", "node", "kind", "value")
    nodes = F.collect_set(F.struct("node", "kind", "value", "style", "content", "sure")).alias("nodes")
    return looked.join(trees, ["host", "node", "kind", "value"]).groupBy("host", "page").agg(nodes)


def _best(element: Element, style: dict[int, float], known: dict[int, float]) -> float:
    """The highest importance of presentation on the path of an element; ``known`` has those found before."""
    path = []
    at: Element | None = element
    while at and at.node not in known:
        path.append(at.node)
        at = at.parent
    best = known[at.node] if at else 0.0
    for node in reversed(path):
        known[node] = best = max(best, style.get(node, 1.0))
    return best


def main_text(
    html: str,
    style: dict[int, float],
    content: dict[int, float],
    sure: frozenset[int] = frozenset(),
    texts: dict[tuple[int, int], float] | None = None,
) -> str:
    """The text of the blocks whose branch is important, joined by spaces.

    In articles ``texts`` has the importance of a text at its node, if it is low. Where a page has no article and most of
    its important text stands in branches that only their names speak against, the importances overrule the names;
    ``sure`` are the nodes that enough pages of the host have.
    """
    blocks = [(b, text) for b in parse(html)[0] if not b.element.other and (text := block_text(b))]
    kept, repeated, overruled, in_article, known = [], [], [], 0, {}
    for at, (block, text) in enumerate(blocks):
        node, named = block.element.node, block.named
        if block.element.article and not named:
            score = 0.5 * (texts.get((node, _hash(text)), 1.0) if texts else 1.0) + ARTICLE
            in_article += len(text)
            (kept if score >= THRESHOLD else repeated).append((at, text))
            continue
        score = 0.5 * content.get(node, 1.0) + 0.5 * _best(block.element, style, known)
        if score >= THRESHOLD and not named:
            kept.append((at, text))
        elif score >= THRESHOLD and node in sure:
            overruled.append((at, text))
    if 2 * sum(len(x) for _, x in repeated) > in_article:  # a copied article
        kept = sorted(kept + repeated)
    if not in_article and sum(len(x) for _, x in overruled) > sum(len(x) for _, x in kept):
        kept = sorted(kept + overruled)
    return " ".join(x for _, x in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Whole pages are parsed; nothing is cut. Null and empty html give an empty text; a page without host belongs to the host
    named by the empty text. Null ids stay null. Repeated rows are pages of their host each and come back repeated. An
    empty table gives an empty one. A page is joined with the importances of its own nodes alone, by Spark's choice from
    their written size, so pages are shuffled only if these are large, and then copies of a page that fill a task are split.
    """
    rows = pick(pages, "page_id", "url", "html")
    trees = materialize(page_trees(rows), "pages").withColumnsRenamed({"host": "__host", "page": "__page"})
    known = rows.join(trees, (host() == F.col("__host")) & (page_key() == F.col("__page")), "left").select("page_id", "url", "html", "nodes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = []
            nodes = part.column("nodes")
            for i, html in enumerate(part.column("html").to_pylist()):
                found = nodes[i].as_py() or []
                low = {(x["node"], x["value"]): x["content"] for x in found if x["kind"] == CONTENT}
                found = [x for x in found if x["kind"] == PAGE]
                style = {x["node"]: x["style"] for x in found}
                content = {x["node"]: x["content"] for x in found}
                sure = frozenset(x["node"] for x in found if x["sure"])
                texts.append(main_text(html or "", style, content, sure, low))
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    out = known.mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
