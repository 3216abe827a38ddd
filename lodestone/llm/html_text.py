"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded hierarchically.

Every block element gets a probability of being content (holding or being part of the main text). The decoding takes the
labelling of the tree that is likeliest among those in which no element is content below an element that isn't. The
trees are fitted on pages that this module composes itself from templates, where every element's label is known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, table
from lodestone.llm.gbdt import Boosted

#: Pages composed for the fit.
FIT_PAGES = 500

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents aren't text of the page; script and style run to the end of the page if nothing ends them.
SILENT = frozenset("title noscript template svg iframe object canvas select textarea button audio video annotation annotation-xml".split())
#: Silent elements that can't hold one of their kind: a second start tag shows that the first was left open.
_FLAT = frozenset("title iframe select textarea button".split())
#: A start tag of the key ends an open element of the values, up to the nearest of the last set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>])(?:.*?</(?P=raw)\s*>|.*\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_SILENT_TAG = re.compile(rf"<(/?)({'|'.join(sorted(SILENT))})(?=[\s/>])[^>]*?(/?)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
GOOD = frozenset("article articlebody body content entry main post prose page story text reader news blog paragraph copy".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement aside author banner bar bottom breadcrumb breadcrumbs button byline captcha "
    "comment comments consent contact cookie cookies copyright disclaimer discussion disqus feedback foot footer form gdpr "
    "head header hidden legal links login logo masthead menu meta modal more nav navbar navigation newsletter notice "
    "overlay pager pagination popup privacy promo promoted rail recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags teaser tool toolbar top warning widget".split()
)
TAGS = ("p", "div", "li", "ul", "section", "article", "main", "nav", "header", "footer", "aside", "form", "h1", "h2", "table", "td", "blockquote", "figure", "body")
_AVOID = frozenset("nav header footer aside form menu dialog search".split())
_WANT = frozenset("article main".split())


class Node:
    __slots__ = ("tag", "words", "parent", "children", "runs", "links", "inline", "label")

    def __init__(self, tag: str, words: tuple[str, ...], parent: int) -> None:
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list[int] = []
        self.runs: list[int] = []  # numbers of the text blocks directly inside
        self.links = self.inline = 0  # characters inside anchors; inline tags
        self.label = None


def silent_ends(source: str) -> dict[int, int]:
    """Where silent elements end, by the place of their start tag; ones closed by themselves or never aren't in it."""
    ends: dict[int, int] = {}
    left: dict[str, list[int]] = {}
    for m in _SILENT_TAG.finditer(source):
        tag = m[2].lower()
        starts = left.setdefault(tag, [])
        if m[1]:
            if starts:
                ends[starts.pop()] = m.end()
        elif not m[3]:
            if tag in _FLAT:
                starts.clear()
            starts.append(m.start())
    return ends


def head_end(source: str, at: int, silent: dict[int, int]) -> int:
    """Where the head whose start tag ends at at is over: behind its end tag; before the body, the first block or the first
    text, whichever comes first, if it has none before them."""
    text = -1  # of the first text
    while m := _TOKEN.search(source, at):
        if text < 0 and source[at : m.start()].strip():
            text = at
        tag = (m["tag"] or m["tag2"] or "").lower()
        if tag == "head" and (m["close"] or m["close2"]):
            return m.end()
        if tag in BLOCKS:
            return m.start() if text < 0 else text
        at = silent.get(m.start(), m.end()) if tag in SILENT else m.end()
    return at if text < 0 else text


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (the root first) and text blocks as (element, text), in one pass.

    Inline elements don't make nodes: unclosed or crossed ones can't upset the tree. A silent element that closes itself
    or is never closed is empty.
    """
    nodes, texts = [Node("html", (), -1)], []
    stack, buffer, anchors, at = [0], [], 0, 0
    silent = silent_ends(source)
    headed = False

    def flush() -> None:
        if buffer:
            if text := " ".join(html.unescape("".join(buffer)).split()):
                nodes[stack[-1]].runs.append(len(texts))
                texts.append((stack[-1], text))
            buffer.clear()

    def pop_to(k: int) -> None:
        del stack[k:]

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            piece = source[at : m.start()]
            buffer.append(piece)
            if anchors:
                nodes[stack[-1]].links += len(piece.strip())
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                buffer.append(" ")
            continue
        tag, closing = tag.lower(), bool(m["close"] or m["close2"])
        if tag == "head":
            if not closing and not headed:
                headed, at = True, head_end(source, at, silent)
            continue
        if tag in SILENT:
            if not closing:
                buffer.append(" ")
                at = silent.get(m.start(), at)
            continue
        if tag not in BLOCKS:
            if tag == "a":
                anchors = 0 if closing else 1
            elif tag in ("br", "img", "option", "label"):
                buffer.append(" ")
            if not closing:
                nodes[stack[-1]].inline += 1
            continue
        flush()
        anchors = 0
        if tag == "html" or tag == "hr":
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    pop_to(k)
                    break
            continue
        if nodes[stack[-1]].tag == "p":
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in stops:
                    break
                if nodes[stack[k]].tag in ends:
                    pop_to(k)
                    break
        if tag == "body" and any(nodes[k].tag == "body" for k in stack):
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        names = tuple(x.lower() for a in _ATTRIBUTE.findall(attrs) for x in _PART.findall("".join(a))) if "=" in attrs else ()
        node = Node(tag, names, stack[-1])
        nodes[stack[-1]].children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(node)
    buffer.append(source[at:])
    flush()
    return nodes, texts


def features(nodes: list[Node], texts: list[tuple[int, str]]) -> list[list[float]]:
    """A row per element, from its subtree, attributes, ancestors and siblings."""
    n = len(nodes)
    own = [0] * n
    commas, ends = [0] * n, [0] * n
    for at, text in texts:
        own[at] += len(text)
        commas[at] += text.count(",")
        ends[at] += text.count(". ") + text.endswith((".", "!", "?", "…", "”", "»"))
    chars, links, tags, paragraphs, blocks = own[:], [x.links for x in nodes], [1 + x.inline for x in nodes], [0] * n, [len(x.runs) for x in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for total in (chars, links, tags, commas, ends, blocks, paragraphs):
            total[p] += total[i]
        paragraphs[p] += nodes[i].tag == "p" and own[i] > 60
    depth, good, bad, avoid, want, order = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    whole = max(1, chars[0])
    out = []
    import math

    for i, x in enumerate(nodes):
        self_good, self_bad = sum(w in GOOD for w in x.words), sum(w in BAD for w in x.words)
        if i:
            p = x.parent
            depth[i] = depth[p] + 1
            good[i], bad[i] = good[p] + self_good, bad[p] + self_bad
            avoid[i], want[i] = avoid[p] + (x.tag in _AVOID), want[p] + (x.tag in _WANT)
        for k, c in enumerate(x.children):
            order[c] = k
        siblings = nodes[x.parent].children if i else [0]
        k = order[i]
        before = chars[siblings[k - 1]] if i and k else 0
        after = chars[siblings[k + 1]] if i and k + 1 < len(siblings) else 0
        parent = max(1, chars[x.parent]) if i else whole
        text = chars[i]
        out.append(
            [
                math.log1p(text), math.log1p(own[i]), min(1.0, links[i] / max(1, text)), text / (tags[i] + len(x.children) + 1), commas[i] / max(1, text) * 100,
                ends[i] / max(1, blocks[i]), math.log1p(paragraphs[i]), text / whole, text / parent, depth[i], k / max(1, len(siblings)), len(siblings),
                math.log1p(before), math.log1p(after), len(x.children), self_good, self_bad, good[i] - self_good, bad[i] - self_bad, avoid[i], want[i],
                blocks[i], text / max(1, blocks[i]), *(x.tag == t for t in TAGS),
            ]
        )
    return out


def decode(nodes: list[Node], logits) -> list[bool]:
    """The likeliest labelling without a content element below one that isn't; the root is always content."""
    import numpy as np

    yes = -np.logaddexp(0, -np.asarray(logits, float))  # log p
    no = -np.logaddexp(0, np.asarray(logits, float))
    off, on = no.copy(), yes.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        off[p] += off[i]
        on[p] += max(on[i], off[i])
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and bool(on[i] > off[i])
    return keep


def compose(rng) -> str:
    """A page of a random template; elements carry data-y="1" where they are content."""
    r = rng.random
    vowels, stems = "aeiouy", "bcdfghklmnprstvwz"

    def word() -> str:
        return "".join(rng.choice(stems) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def sentence(lo: int = 4, hi: int = 22) -> str:
        body = " ".join(word() + ("," if r() < 0.08 else "") for _ in range(rng.randint(lo, hi)))
        return body.capitalize() + rng.choice(("." * 9) + "!?")

    def prose(lo: int = 1, hi: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def tag(name: str, inner: str, names: str = "", y: int = 0) -> str:
        attr = f' {rng.choice(("class", "class", "id"))}="{names}"' if names and r() < 0.9 else ""
        return f'<{name}{attr} data-y="{y}">{inner}</{name}>'

    def links(k: int) -> str:
        return "".join(tag("li", f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a>') for _ in range(k))

    def boiler() -> str:
        kind = rng.randint(0, 11)
        if kind == 0:
            return tag(rng.choice(("nav", "div")), tag("ul", links(rng.randint(3, 12))), rng.choice(("menu", "nav main-nav", "navbar", "site-navigation")))
        if kind == 1:
            return tag(rng.choice(("aside", "div", "section")), tag("h3", sentence(1, 4)) + tag("ul", links(rng.randint(2, 8))) + (tag("p", prose(1, 3)) if r() < 0.5 else ""), rng.choice(("sidebar", "widget", "right-rail", "related-posts")))
        if kind == 2:
            return tag("div", rng.choice((sentence(), prose(1, 3), tag("p", prose(1, 2)))), rng.choice(("ad", "ads", "advert", "ad-banner", "sponsored", "promo-box")))
        if kind == 3:
            return tag(rng.choice(("div", "section")), tag("p", prose(1, 3)) + "<button>ok</button>", rng.choice(("cookie-notice", "notice", "consent-banner", "gdpr", "warning")))
        if kind == 4:
            return tag("form", f"<label>{word()}</label><input name=q>" + (tag("p", prose(1, 2)) if r() < 0.5 else ""), rng.choice(("search", "newsletter", "subscribe-form", "login", "")))
        if kind in (5, 6):
            items = "".join(tag(rng.choice(("div", "li", "article")) if r() < 0.5 else "div", tag("p", prose(1, 4)), rng.choice(("comment", "comment-body", "reply", ""))) for _ in range(rng.randint(1, 6)))
            return tag(rng.choice(("div", "section", "ul")), tag("h3", sentence(1, 3)) + items, rng.choice(("comments", "comment-list", "discussion", "responses comments-area")))
        if kind == 7:
            return tag("div", "".join(f'<a href="#">{word()}</a> ' for _ in range(rng.randint(2, 6))), rng.choice(("share", "social", "tags", "breadcrumbs", "pagination")))
        if kind == 8:
            return tag(rng.choice(("header", "div")), tag("div", word(), "logo") + tag("p", sentence(2, 8)) + tag("ul", links(rng.randint(0, 6))), rng.choice(("header", "masthead", "site-header", "top-bar", "")) if r() < 0.9 else "header")
        if kind == 9:
            return tag("div", "".join(tag("div", tag("h4", f'<a href="#">{sentence(2, 6)}</a>') + tag("p", sentence()), "teaser") for _ in range(rng.randint(2, 5))), rng.choice(("related", "recommended", "more-stories", "teaser-list")))
        return tag(rng.choice(("footer", "footer", "div")), f"&copy; {word()} &middot; {prose(1, 2)}", rng.choice(("footer", "site-footer", "legal", "copyright"))) if r() < 0.7 else tag("footer", f"{word()} {prose(1, 3)}")

    def block() -> str:
        kind = r()
        if kind < 0.7:
            text = prose(1, 9) if r() < 0.85 else sentence(1, 4)
            if r() < 0.2:
                text = "<b>" + text + ("</b>" if r() < 0.5 else "<br>")
            if r() < 0.15:
                text += f' <a href="/{word()}">{sentence(1, 5)}</a> '
            return f'<p data-y="1">{text}' + ("</p>" if r() < 0.85 else "")
        if kind < 0.78:
            return tag(rng.choice(("h2", "h3")), sentence(1, 6), "", 1)
        if kind < 0.84:
            return tag("ul", "".join(tag("li", sentence(), "", 1) for _ in range(rng.randint(2, 6))), "", 1)
        if kind < 0.88:
            return tag("blockquote", tag("p", prose(), "", 1), "", 1)
        if kind < 0.91:
            rows = "".join(tag("tr", "".join(tag("td", word(), "", 1) for _ in range(3)), "", 1) for _ in range(rng.randint(2, 5)))
            return tag("table", rows, "", 1)
        if kind < 0.94:
            return tag("pre", sentence(), "", 1)
        return tag("div", prose(), rng.choice(("", "text", "paragraph")), 1)

    blocks = [block() for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 30)))]
    if r() < 0.4:
        blocks.insert(rng.randint(0, len(blocks)), boiler())
    title = tag("h1", sentence(2, 9), rng.choice(("", "title", "entry-title")), 1)
    if r() < 0.2:
        title = tag("header", title, "entry-header", 1)
    name, names = rng.choice((("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-body entry"), ("div", "article-text"), ("section", "story"), ("div", "")))
    inner = "".join(blocks)
    if r() < 0.3:
        inner = tag("div", inner, rng.choice(("entry-content", "body", "prose", "")), 1)
    body = tag(name, title + inner if r() < 0.85 else inner, names, 1)
    if r() < 0.03:
        body = tag(name, "", names, 1)
    for _ in range(rng.choice((0, 0, 1, 2))):
        extra = boiler()
        body = tag("div", body + extra if r() < 0.5 else extra + body, rng.choice(("wrapper", "container", "page", "main", "row", "")), 1)
    ahead = "".join(boiler() for _ in range(rng.randint(0, 3)))
    behind = "".join(boiler() for _ in range(rng.randint(0, 3)))
    return f'<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title></head><body data-y="1">{ahead}{body}{behind}</body></html>'


_LABEL = re.compile(r'data-y="([01])"')


def labelled(source: str) -> tuple[list[Node], list[tuple[int, str]], list[int]]:
    """A composed page with the label of every node."""
    nodes, texts = parse(source)
    marks = [1]
    for m in _TOKEN.finditer(source):
        tag = (m["tag"] or m["tag2"] or "").lower()
        if tag in BLOCKS and tag not in ("html", "hr") and not (m["close"] or m["close2"]):
            marks.append(int(_LABEL.search(m["attrs"] or m["attrs2"])[1]))
    return nodes, texts, marks


@lru_cache(maxsize=2)
def model(pages: int = FIT_PAGES) -> Boosted:
    import random

    import numpy as np

    rng, rows, labels, weights = random.Random(7), [], [], []
    for _ in range(pages):
        nodes, texts, marks = labelled(compose(rng))
        rows += features(nodes, texts)
        labels += marks
        weights += [1.0] * len(marks)
    return Boosted(np.array(rows, float), np.array(labels, float), np.array(weights))


def extract_many(found: list[str], trees: Boosted) -> list[str]:
    """The main text of each page: its content elements' text blocks in page order, one to a line."""
    import numpy as np

    parsed = [parse(x) for x in found]
    rows = [f for nodes, texts in parsed for f in features(nodes, texts)]
    logits, at, out = trees.logits(np.array(rows, float)) if rows else [], 0, []
    for nodes, texts in parsed:
        keep = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        body = next((i for i, x in enumerate(nodes) if x.tag == "body"), 0)
        out.append("\n".join(text for i, text in texts if keep[i or body]))
    return out


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; one row per page.

    Null html counts as empty and gives the empty text. Character references are decoded, white space inside a block is
    one space (a line break too), blocks are joined by one newline; text outside every element counts as
    the body's own, and is content if there is no body.
    Repeated rows come out repeated, other columns are ignored.
    """
    spark = pages.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast(model(fit_pages))  # some tens of small trees

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = batch.column("html").to_pylist()
            texts = [x for i in range(0, len(found), 100) for x in extract_many(found[i : i + 100], held.value)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
