"""Main text of web pages: site templates are found as element subtrees that recur on a host, and removed.

Each page becomes a small tree of elements. The hashes of its block subtrees are counted per host in Spark, once for each
different text of a page; those that recur on many different pages of their host are template and are deleted: menus, notices,
adverts, footers and whatever else a site puts around what it publishes, with or without telling tags and classes. A second,
smaller step deletes subtrees that their tag, role, class or id marks as such, since a site may be known by few pages or fill
them in differently each time. What is left of the article (else of the main element, else of the body) is the text, block by
block.

Inside an article or main element only containers are taken for template, not paragraphs, headings or list items: sites
repeat sentences in what they publish, and those belong to the text.

Of several articles side by side all are text. Inside one, only blocks whose class says as a whole that they are something else go.

Cases: bytes that are no valid UTF-8 become replacement characters; a null or empty page and one without text give the empty string; a page whose url has no host counts with the other
pages of no host; repeated pages keep rows of their own but count once, so copies don't turn their text into template; unclosed,
misnested and cut-off markup is read as far as it goes, with the effort of one pass at any depth; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import parts, saved, table, utf8

#: A subtree is template if it is on so many different pages of its host, however many the host has.
MIN_PAGES = 5
#: Template hashes that are broadcast at most; beyond, they are joined to the pages' own.
BROADCAST_KEYS = 1_000_000

#: Elements whose content is no markup, and what ends them; names and attribute ends of all others.
RAW = re.compile(r"<(script|style|noscript|template|textarea|title|svg|iframe)\b", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe")}
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
#: A tag that the page's end cuts off; one with an unclosed quote ends by its first >.
UNFINISHED = re.compile(r"<(?:/?[a-zA-Z]|[!?]|/$)[^>]*(?:>|$)")
#: Attributes of a tag, and cheap signs that one of those that are looked at is there.
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LOOKED_AT = re.compile(r"class|id\s*=|role|hidden|style", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of the article.
DROPPED = frozenset("head nav footer aside form button select dialog menu object audio video canvas map".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an element ends by beginning, up to the nearest of the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th caption figcaption".split())
LABELS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|header|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|comments?|commentlist|replies|reply|respond|disqus"
    r"|related|recommend(?:ed|ations?)?|widget|pagination|pager|skip|complementary|contentinfo|dialog)(?:$|[\s_-])",
    re.I,
)
#: Labels of an article's own head, whose title and first lines are text.
OWN_HEAD = re.compile(r"(?:^|\s)(?:(?:post|entry|article|content|story|page|blog|news|text)[_-]+)(?:header|banner|masthead)(?=$|\s)", re.I)
#: Inside an article a label has to be a class of its own, or be followed by what such a thing is made of: `side-note` and `share-price` are text.
INSIDE = re.compile(
    r"(?:^|\s)(?:[a-z0-9]+[_-]+)*(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|comments?|commentlist|replies|reply|respond|disqus"
    r"|related|recommend(?:ed|ations?)?|widget|pagination|pager|skip|complementary|contentinfo|dialog)"
    r"(?:[_-]+(?:ads?|area|articles?|bar|block|box|btn|buttons?|container|content|form|icons?|inner|items?|links?|list|menu|nav|panel|posts?|section|slot|stories|thread|title|tools|unit|widget|wrap|wrapper|[0-9]+))*(?=$|\s)",
    re.I,
)
NOT_MAIN = re.compile(r"(?:^|[\s_-])(?:comment|reply|related|ad|ads|promo)s?(?:$|[\s_-])", re.I)


class Node:
    """An element. inside: an article or main element is above it; live: neither it nor anything above it is dropped."""

    __slots__ = ("tag", "parent", "parts", "dropped", "label", "hash", "size", "inside", "live")

    def __init__(self, tag: str, parent: Node | None, label: str = "", dropped: bool = False):
        self.tag, self.parent, self.parts, self.label, self.dropped = tag, parent, [], label, dropped
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.live = not dropped and (parent is None or parent.live)
        self.hash, self.size = 0, 0


def marks(attributes: str) -> tuple[str, bool]:
    """(class, id and role, whether the element is hidden)."""
    if not attributes or not LOOKED_AT.search(attributes):
        return "", False
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next(filter(None, values), ""))
    hidden = "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").lower() == "true" or bool(NO_DISPLAY.search(found.get("style", "")))
    return " ".join(x for x in (found.get(k) for k in ("class", "id", "role")) if x), hidden


def is_marked(tag: str, label: str, hidden: bool, inside: bool) -> bool:
    """Whether tag, label or a hidden state tell that the element is no text of the article."""
    if tag in DROPPED or (tag == "header" and not inside) or (hidden and tag != "body"):
        return True
    if not label or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return bool(NOT_MAIN.search(label))
    if inside:
        return tag not in INLINE and tag not in PARAGRAPHS and bool(INSIDE.search(OWN_HEAD.sub(" ", label)))
    return bool(LABELS.search(OWN_HEAD.sub(" ", label)))


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, tag, attributes) of what is no text, in page order; the tag is empty for comments, declarations and raw elements.

    A tag ends by the first > outside quotes; where a quote stays open to the page's end, by the first > of all. An open quote met
    once is remembered, so that no later tag reads on from it, and every character is looked at a bounded number of times.
    """
    doomed: set[int] = set()
    more, at = page.find(">"), page.find("<")

    def tag_end(i: int) -> int:
        """Where the > is that ends a tag outside quotes, else -1."""
        seen = []
        while stop := STOP.search(page, i):
            j = stop.start()
            if page[j] == ">":
                return j
            seen.append(j)
            close = -1 if j in doomed else page.find(page[j], j + 1)
            if close < 0:
                break
            i = close + 1
        doomed.update(seen)
        return -1

    while at >= 0:
        if 0 <= more < at:
            more = page.find(">", at)
        if more < 0:  # nothing but a comment can begin any more
            at = page.find("<!--", at)
            if at >= 0:
                yield at, len(page), False, "", ""
            return
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = more + 1
            yield at, end, False, "", ""
        elif name := NAME.match(page, at):
            raw = RAW.match(page, at)
            stop = tag_end(raw.end() if raw else name.end())
            if raw and stop >= 0:
                close = RAW_END[raw[1].lower()].search(page, stop + 1)
                end = close.end() if close else len(page)
                yield at, end, False, "", ""
            else:
                stop = stop if stop >= 0 else more
                end = stop + 1
                yield at, end, bool(name[1]), name[2].lower(), page[name.end() : stop]
        at = page.find("<", max(end, at + 1))


def parse(page: bytes | str | None) -> Node:
    root = top = Node("html", None)
    page = page.decode("utf-8", "replace") if isinstance(page, bytes) else page or ""
    at, opened = 0, Counter()  # opened: how many elements of each tag stand open

    def leave(node):
        nonlocal top
        while top is not node:
            opened[top.tag] -= 1
            top = top.parent

    for start, end, closes, tag, attributes in tokens(page):
        if start > at:
            top.parts.append(html.unescape(page[at:start]))
        at = end
        if not tag or tag == "html":
            continue
        if closes:
            if opened[tag]:
                node = top
                while node.tag != tag:
                    node = node.parent
                leave(node.parent)
            elif tag == "p":
                top.parts.append(Node("p", top))
            continue
        if tag in CLOSES_P and opened["p"]:
            node = top
            while node is not root and (node.tag in INLINE or node.tag == "p"):
                if node.tag == "p":
                    leave(node.parent)
                    break
                node = node.parent
        elif tag in SIBLINGS:
            ends, until = SIBLINGS[tag]
            node = top
            while any(opened[x] for x in ends) and node is not root and node.tag not in until:
                node, own = node.parent, node
                if own.tag in ends:
                    leave(node)
                    if tag != "tr":
                        break
        label, hidden = marks(attributes)
        node = Node(tag, top, label, is_marked(tag, label, hidden, top.inside or top.tag in ("article", "main")))
        top.parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            top = node
            opened[tag] += 1
    if at < len(page):
        top.parts.append(html.unescape(UNFINISHED.sub("", page[at:])))
    return root


def below(root: Node) -> list[Node]:
    """All elements, parents first."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [x for x in node.parts if isinstance(x, Node)]
    return found


def hash_subtrees(root: Node) -> list[Node]:
    """Sets every element's hash (tag, label, text and children) and its size (characters of text); parents first."""
    nodes = below(root)
    for node in reversed(nodes):
        parts, size = [node.tag, node.label], 0
        for x in node.parts:
            if isinstance(x, Node):
                parts.append(f"\x01{x.hash}")
                size += x.size
            else:
                text = " ".join(x.split())
                parts.append(text)
                size += len(text)
        node.hash, node.size = xxhash.xxh3_64_intdigest("\x00".join(parts)), size
    return nodes


def articles_of(nodes: list[Node]) -> list[Node]:
    """The outermost articles in page order, else the longest main element, else the whole page."""
    within = set()
    for x in nodes:
        if x.parent is not None and (x.parent.tag == "article" or id(x.parent) in within):
            within.add(id(x))
    # parents come first and siblings from the last on
    if found := [x for x in reversed(nodes) if x.tag == "article" and x.size and x.live and id(x) not in within]:
        return found
    if found := [x for x in nodes if x.size and x.live and (x.tag == "main" or re.search(r"(?:^|\s)main(?:$|\s)", x.label))]:
        return [max(found, key=lambda x: x.size)]
    return [nodes[0]]


def main_text(nodes: list[Node]) -> str:
    return "\n".join(filter(None, map(text_below, articles_of(nodes))))


def may_be_template(node: Node) -> bool:
    """Whether the element can be deleted as template: a block with text, and inside an article no paragraph."""
    if node.tag in INLINE or node.tag in ("html", "body", "head", "article", "main") or not node.size:
        return False
    return not node.inside or node.tag not in PARAGRAPHS


def template_keys(page: bytes | str | None, host: bytes) -> tuple[set[int], int]:
    """The keys that may be template, and a key of the page: that of its whole text, equal for copies whose rest differs."""
    nodes = hash_subtrees(parse(page))
    keys = {key_of(host, x.hash) for x in nodes if may_be_template(x)}
    return keys, xxhash.xxh3_64_intdigest(host + b"\n" + main_text(nodes).encode()) - (1 << 63) if keys else 0


def key_of(host: bytes, subtree: int) -> int:
    return xxhash.xxh3_64_intdigest(host + subtree.to_bytes(8, "little")) - (1 << 63)


def text_of(page: bytes | str | None, host: bytes, is_template) -> tuple[str, int]:
    """The page's main text and how many template subtrees it had; is_template tells of a key whether it recurs on its host."""
    root = parse(page)
    nodes, gone = hash_subtrees(root), []
    stack = [root]
    while stack:  # the outermost ones
        node = stack.pop()
        if may_be_template(node) and is_template(key_of(host, node.hash)):
            gone.append(node)
        else:
            stack += [x for x in node.parts if isinstance(x, Node)]
    for node in gone:
        node.dropped = True
        for x in below(node):
            x.live = False
    return main_text(nodes), len(gone)


def text_below(article: Node) -> str:
    """The article's text, block by block, without dropped elements."""
    blocks, now = [], []

    def end():
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    stack = [iter([article])]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            end_of = names.pop() if stack and names else None
            if end_of and end_of not in INLINE:
                end()
            continue
        if isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.dropped:
            if x.tag not in INLINE:
                end()
        else:
            if x.tag not in INLINE:
                end()
            if len(stack) == 1:
                names = []
            names.append(x.tag)
            stack.append(iter(x.parts))
    end()
    return "\n".join(blocks)


def host_of(url: str | Column = "url") -> Column:
    """The url's host in lower case, without user or port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key): the subtrees that recur on different pages of their host."""

    def count(batches):
        # min_pages different pages of a key tell enough, so no task sends more at once; the sets are emptied before they grow large
        seen = defaultdict(set)
        for batch in parts(batches):
            hosts = batch.column(0).to_pylist()
            for host, page in zip(hosts, batch.column(1).to_pylist(), strict=True):
                keys, own = template_keys(page, host.encode())
                for key in keys:
                    if len(found := seen[host, key]) < min_pages:
                        found.add(own)
            if len(seen) > 300_000:
                yield rows(seen)
                seen = defaultdict(set)
        yield rows(seen)

    def rows(seen):
        flat = [(*key, page) for key, found in seen.items() for page in found]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "key", "page"])

    seen = pages.select(host_of().alias("host"), utf8("html").alias("html")).mapInArrow(count, "host string, key long, page long")
    return saved(seen.distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "key"))


def own_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, page, keys): the template subtrees of each different html of a host, named by its md5."""

    def each(batches):
        for batch in parts(batches):
            found = [(host, page, key) for host, html_of, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for key in template_keys(html_of, host.encode())[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "page", "key"])

    own = pages.select("host", utf8("html").alias("html"), "page").mapInArrow(each, "host string, page string, key long")
    return own.join(templates, ["host", "key"]).groupBy("host", "page").agg(F.collect_set("key").alias("keys"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for every row of pages; n_template: the template subtrees that were deleted."""
    templates = site_templates(pages, min_pages)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_template int"

    def rows(batch, found):
        texts = [x for x, _ in found]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([n for _, n in found], pa.int32())], ["page_id", "url", "text", "n_chars", "n_template"])

    named = pages.select("page_id", "url", host_of().alias("host"), utf8("html").alias("html"))
    if templates.count() <= broadcast_keys:
        keys = np.sort(np.array([r[0] for r in templates.select("key").collect()], np.int64))
        held = pages.sparkSession.sparkContext.broadcast(keys)

        def with_all(batches):
            keys = held.value

            def known(key):
                i = np.searchsorted(keys, key)
                return i < len(keys) and keys[i] == key

            for batch in parts(batches):
                yield rows(batch, [text_of(page, host.encode(), known) for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

        return named.mapInArrow(with_all, schema)

    def with_own(batches):
        for batch in parts(batches):
            own = (batch.column(i).to_pylist() for i in (2, 3, 4))
            yield rows(batch, [text_of(page, host.encode(), set(keys or ()).__contains__) for host, page, keys in zip(*own, strict=True)])

    named = named.withColumn("page", F.md5("html"))
    return named.join(own_templates(named, templates), ["host", "page"], "left").select("page_id", "url", "host", "html", "keys").mapInArrow(with_own, schema)


def op6_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
