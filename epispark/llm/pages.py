"""Main text of web pages by site template removal.

Every page is parsed once into text blocks and the element subtrees around them, hashed. Spark counts on how many
different pages of a host each subtree recurs, and deletes subtrees that recur on many of them, at places of the page
where most subtrees do so. Menus, adverts and footers often vary from page to page; so subtrees are hashed a second time
with their texts masked, and a place outside articles where nearly all pages of a host hold one small structure, of links
or of texts that come again, is deleted on all pages. What is left is read from the articles where a page has any. Hosts
with few pages have no recurring subtrees; there elements that are no article text by their meaning (nav, footer, forms,
advert and comment classes, ...) go, and on other hosts as well. template_report() tells the two apart.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import columns_but, written
from epispark.llm.urls import parts_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: text inside a component: deleted with it, not by itself, as articles of one host may share a heading or a paragraph
INNER = set("p h1 h2 h3 h4 h5 h6 hgroup li dt dd tr td th tbody thead tfoot caption blockquote pre figure figcaption legend summary address".split())
#: elements that say nothing of their purpose
PLAIN = INNER | {"div", "section", "table", "center", "ul", "ol", "dl", "details"}
#: elements whose start ends an open paragraph
SINGLE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
NOT_TEXT = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "search", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
STRONG = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar advert adverts advertisement advertising ads ad sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond discussion pagination pager toolbar widget widgets masthead topbar bottombar footer notice notices alert paywall skip".split())
#: names of page furniture; inside an article they may name parts of it
WHOLE = set("header site-header page-header banner search tags meta byline tools links site-banner top bottom".split())
#: words that make a name say how an element is laid out, not what it is (has-social, with-sidebar, no-comments)
STATES = set("has have with no not without is category tag hide show".split())
MAIN = set("content main post entry article post-content entry-content article-body article-content main-content story story-body post-body".split())


DIGITS = re.compile(r"[0-9]+")


def signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    __slots__ = ("tag", "label", "noise", "named", "main", "parts", "inner", "within", "place", "kids", "number", "shapes", "core")

    def __init__(self, tag: str, attributes: str, within: Node | None):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = [n for n in (found.get("class", "") + " " + found.get("id", "")).lower().split() if n]
        # numbers in names (post-12) tell pages apart, not elements
        self.tag, self.label, self.parts, self.within = tag, DIGITS.sub("0", " ".join(names)), [], within
        self.inner = within is not None and (within.inner or within.main)
        self.main = tag in ("article", "main") or found.get("role") == "main" or (tag in ("div", "section", "td") and bool(MAIN.intersection(names)))
        noise = tag in NOT_TEXT or (tag == "header" and not self.inner) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        noise = noise or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.noise = (noise and tag not in ("html", "body", "main")) or (within is not None and within.noise)
        # names: one is enough for an element, an article or post is named so by all of them ("post no-comments" is not)
        named = [(n in WHOLE and not self.inner) or any(b in STRONG and a not in STATES for a, b in zip(["", *parts], parts)) for n in names for parts in [re.split(r"[_-]+", n)]]
        self.named = tag not in ("html", "body", "main") and bool(named) and (all(named) if self.main else any(named))
        # place in the page: the way from the top by names, or by number among nameless elements of a kind
        self.kids, self.number = {}, None
        # structure below, last child first; whether an article or the page's title is part of it
        self.shapes, self.core = [], self.main or tag == "h1"
        step = f"{tag}.{self.label}"
        if not names and within is not None:
            within.kids[tag] = within.kids.get(tag, 0) + 1
            step = f"{tag}[{within.kids[tag]}]"
        self.place = signed(f"{within.place if within else 0}/{step}")

    def deletable(self) -> bool:
        return not self.main and self.within is not None and self.tag != "head" and (self.tag not in INNER or bool(self.label))


def spare(nodes: list[Node], blocks: list[tuple]) -> None:
    """Noise by name, below which nothing is text either, unless it would take all articles of a page: then the largest
    and what it lies in are spared. Pages without articles go by their main classes, or by most of their text."""
    size = lambda n: sum(len(blocks[k][0]) for k in n.parts)
    out: dict[int, bool] = {}
    for n in nodes:
        out[id(n)] = n.named or (n.within is not None and out[id(n.within)])
    text = [n for n in nodes if n.parts and not n.noise]
    sets = [[n for n in text if n.tag in ("article", "main")], [n for n in text if n.main]]
    mains = next((x for x in sets if x), None)
    top = None
    if mains is not None:
        if all(out[id(n)] for n in mains):
            top = max(mains, key=size)
    else:
        all_text = sum(len(b[0]) for b in blocks if not b[1][-1].noise)
        top = next((n for n in reversed(text) if n.named and 2 * size(n) > all_text), None)
    while top is not None:
        top.named, top = False, top.within
    for n in nodes:
        n.noise = n.noise or n.named or (n.within is not None and n.within.noise)


def picked(blocks: list[dict]) -> list[dict]:
    """The blocks of articles, else of main parts, where these hold at least a fifth of the text; else all."""
    size = lambda some: sum(len(b["text"]) for b in some)
    for kind in ("article", "main"):
        held = [b for b in blocks if b[kind]]
        if held and 5 * size(held) >= size(blocks):
            return held
    return blocks


def masked(nodes: list[Node]) -> dict[int, int | None]:
    """By node, the hash of its structure without texts, where a run of equal children counts as one; none for what lies
    in an article or holds one or the page's title. Nodes come parents first."""
    out: dict[int, int | None] = {}
    for n in reversed(nodes):
        if not n.parts or n.inner:
            continue
        shape = signed(f"{n.tag}|{n.label}|{n.shapes}")
        out[id(n)] = None if n.core else shape
        if n.within is not None:
            n.within.core |= n.core
            if n.within.shapes[-1:] != [shape]:
                n.within.shapes.append(shape)
    return out


def parsed(page: str | None, names: bool = True) -> tuple[int, list[dict], list[dict]]:
    """Signature of the page's text, its text blocks (text, article, main, parts: the subtrees around it, named: noise by
    a name; without these if names) and the deletable subtrees (tree: hash of all it holds, place, own: it is named or of
    a telling kind, open: it holds a block, shape: hash of its structure or null, links: mostly link text, share: its
    part of the page's text).

    Null and empty pages have no block. Broken markup is read as browsers do, more or less: unknown end tags are
    ignored, open elements end with the page, a new paragraph ends the one before.
    """
    text = page or ""
    root = Node("html", "", None)
    stack, blocks, buffer = [root], [], []
    nodes = [root]
    link, linked = False, 0  # inside a link; characters of links in the buffer

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            mostly, linked = 2 * linked >= len(raw), 0
            buffer.clear()
            clean = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if clean:
                for n in stack:
                    n.parts.append(len(blocks))
                blocks.append((clean, tuple(stack), mostly))

    at, size = 0, len(text)
    while at < size:
        m = TOKEN.match(text, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                buffer.append(m[0])
                linked += len(m[0]) if link else 0
            continue
        tag, close, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not close and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(text, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in BLOCKS:
            link = not close if tag == "a" else link
            continue  # inline: neither a block's border nor a subtree
        flush()
        if close:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if stack[-1].tag == "p":
            stack.pop()
        elif tag in SINGLE and stack[-1].tag in SINGLE[tag].split():
            stack.pop()
        if tag in ("html", "body") or (tag == "article" and stack[-1].tag == "head"):
            continue
        if tag != "head" and stack[-1].tag == "head":
            stack.pop()
        node = Node(tag, attributes, stack[-1])
        if not attributes.endswith("/"):
            stack.append(node)
            nodes.append(node)
    flush()
    spare(nodes, blocks)
    shapes, all_text = masked(nodes), sum(len(b[0]) for b in blocks)
    parts = []
    for n in nodes:
        if n.parts and n.deletable():
            n.number = len(parts)
            size, links = sum(len(blocks[k][0]) for k in n.parts), sum(len(blocks[k][0]) for k in n.parts if blocks[k][2])
            tree = signed("\n".join([n.tag, n.label, *(blocks[k][0] for k in n.parts)]))
            parts.append({"tree": tree, "place": n.place, "own": bool(n.label) or n.tag not in PLAIN, "open": False, "shape": shapes.get(id(n)), "links": 2 * links >= size, "share": size / all_text})
    out = []
    for clean, path, _ in blocks:
        named = any(n.noise for n in path)
        if named and names:
            continue
        around = [n.number for n in path if n.number is not None]
        for k in around:
            parts[k]["open"] = True
        out.append({"text": clean, "parts": around, "named": named, "article": any(n.tag == "article" for n in path), "main": any(n.main for n in path)})
    return signed(" ".join(b["text"] for b in picked(out))), out, parts


PARSED = (
    "sig long, blocks array<struct<text:string,parts:array<int>,named:boolean,article:boolean,main:boolean>>, "
    "parts array<struct<tree:long,place:long,own:boolean,open:boolean,shape:long,links:boolean,share:double>>"
)


def text_of(blocks: Column) -> Column:
    """picked() as a column, joined."""
    size = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["text"]))
    articles, mains = F.filter(blocks, lambda b: b["article"]), F.filter(blocks, lambda b: b["main"])
    enough = lambda b: (F.size(b) > 0) & (5 * size(b) >= size(blocks))
    kept = F.when(enough(articles), articles).when(enough(mains), mains).otherwise(blocks)
    return F.array_join(F.transform(kept, lambda b: b["text"]), " ")


def templates(parts: DataFrame, least: int, most: float, sure: float, many: int, seen: float, small: float) -> DataFrame:
    """(host, place, tree) of the subtrees to delete, from (host, sig, place, tree, own, shape, links, share) of all
    subtrees of all pages."""
    once = parts.groupBy("host", "sig", "place", "tree").agg(F.max("own").alias("own"), F.max("shape").alias("shape"), F.max(F.col("links").cast("int")).alias("links"), F.max("share").alias("share"))
    n = once.groupBy("host", "place", "tree").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"), F.max("shape").alias("shape"), F.sum("links").alias("links"), F.sum("share").alias("share"))
    held = lambda times: F.sum(F.when(F.col("n") >= times, F.col("n")).otherwise(0))
    # totals of a structure at a place, then of the place
    shapes = n.groupBy("host", "place", "shape").agg(F.sum("n").alias("all"), held(least).alias("again"), held(2).alias("twice"), F.sum("links").alias("links"), F.sum("share").alias("share"))
    one = F.struct("all", "shape", "links", "share", "twice")
    places = shapes.groupBy("host", "place").agg(F.sum("all").alias("all"), F.sum("again").alias("again"), F.max(F.when(F.col("shape").isNotNull(), one)).alias("one"))
    enough = F.col("all") >= many
    fixed = enough & (F.col("one.all") >= sure * F.col("all")) & (F.col("one.share") <= small * F.col("one.all"))
    fixed = fixed & ((2 * F.col("one.links") >= F.col("one.all")) | (F.col("one.twice") >= seen * F.col("one.all")))
    recurs = F.col("again") >= most * F.col("all")
    slots = places.select("host", "place", recurs.alias("recurs"), (enough & (F.col("again") >= sure * F.col("all"))).alias("sure"), F.when(fixed, F.col("one.shape")).alias("fixed"), (2 * F.col("one.links") >= F.col("one.all")).alias("menu"))
    slots = slots.where("recurs or fixed is not null")
    by_text = F.col("recurs") & ((F.col("n") >= least) | (F.col("sure") & F.col("own")))
    by_shape = F.coalesce(F.col("shape") == F.col("fixed"), F.lit(False)) & (F.col("own") | F.col("menu"))
    return n.join(slots, ["host", "place"]).where(by_text | by_shape).select("host", "place", "tree")


COUNTING = {"least": 5, "most": 0.5, "sure": 0.8, "many": 20, "seen": 0.2, "small": 0.25}


def counted(pages: DataFrame, names: bool, page_html: str, url: str, counting: dict, replaced: tuple = ("text",)) -> tuple[DataFrame, DataFrame]:
    """All pages as (page, host, sig, blocks, parts, row), written; and (row, gone: numbers of the subtrees that the
    counts delete) of the pages where these hold text."""
    parse = F.pandas_udf(lambda htmls: pd.DataFrame([parsed(h, names) for h in htmls], columns=["sig", "blocks", "parts"]), PARSED)
    rows = pages.select(columns_but(pages, page_html, *replaced).alias("page"), parts_of(F.col(url))[0].alias("host"), parse(F.col(page_html)).alias("p"))
    made = written(rows.select("page", "host", "p.*", F.monotonically_increasing_id().alias("row")))
    all_parts = made.select("host", "sig", F.inline("parts")).drop("open")
    template = written(templates(all_parts, **{**COUNTING, **counting}))
    opened = made.select("row", "host", F.posexplode("parts").alias("k", "p")).where("p.open").select("row", "k", "host", "p.place", "p.tree")
    return made, opened.join(template, ["host", "place", "tree"], "left_semi").groupBy("row").agg(F.collect_set("k").alias("gone"))


def main_text(pages: DataFrame, page_html: str = "html", url: str = "url", names: bool = True, **counting: float) -> DataFrame:
    """pages with text (empty if none) in place of the html.

    A subtree is template when at least `least` (5) pages of its host with different main texts hold it at the same place,
    and at least the share `most` (0.5) of the subtrees there recur like this; copies of one page count once. At places of
    a name of their own where at least the share `sure` (0.8) of `many` (20) or more subtrees recurs, the others go too. So
    do subtrees of one structure, whatever their texts, that make up the share `sure` of `many` or more at a place outside
    articles, hold at most the share `small` (0.25) of their pages' text on average, and are mostly links or, of a name of
    their own, have texts that another page has in the share `seen` (0.2) of cases. Articles and the paragraphs and
    headings in them are never counted as template by themselves. Without `names` nothing is deleted by its name or kind.
    Where a page's articles, else its main parts, hold at least a fifth of the text that is left, the text outside and
    between them goes as well.

    Null html has no text; null urls share the empty host. Repeated rows and ids are pages of their own. Other columns
    pass through, whatever their names; a column named text is replaced. An empty table stays empty.
    """
    made, gone = counted(pages, names, page_html, url, counting)
    # pages where no subtree that holds text could go are settled without a shuffle of their text
    unsettled = F.exists("parts", lambda p: p["open"])
    settled = made.where(~unsettled).select("page", text_of(F.col("blocks")).alias("text"))
    left = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["parts"], F.col("gone")))
    others = made.where(unsettled).join(gone, "row", "left").select("page", text_of(left).alias("text"))
    return settled.unionByName(others).select("page.*", "text")


def template_report(pages: DataFrame, page_html: str = "html", url: str = "url", **counting: float) -> DataFrame:
    """What of each page goes by which step: pages with host, chars (of all text blocks), by_counts (in subtrees that the
    counts delete, found without names), by_names (in elements deleted by name or kind) and by_both, in place of the html.
    Nulls, repeated rows and empty tables are as in main_text; columns of these names are replaced."""
    new = ("host", "chars", "by_counts", "by_names", "by_both")
    made, gone = counted(pages, False, page_html, url, counting, new)
    by_counts = lambda b: F.col("gone").isNotNull() & F.arrays_overlap(b["parts"], F.coalesce("gone", F.array().cast("array<int>")))
    chars = lambda kept: F.aggregate(F.filter("blocks", kept), F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    sums = [chars(lambda b: F.lit(True)), chars(by_counts), chars(lambda b: b["named"]), chars(lambda b: by_counts(b) & b["named"])]
    return made.join(gone, "row", "left").select("page.*", "host", *[c.alias(name) for c, name in zip(sums, new[1:], strict=True)])
