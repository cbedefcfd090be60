"""Main text of web pages by a tree-structured graphical model (operator 4).

Every element of a page is content or not. A potential ties an element's state to its parent's, given the element's kind of tag; others tie
it to what the element looks like: tag, words of class, id and role, share of linked text, length of text. Messages go up the tree and
down again (sum-product), which gives each element's exact marginal. Potentials are relative counts over labelled pages.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import prepare

KINDS = {
    "html": "root", "body": "body", "head": "head", "title": "head", "nav": "nav", "menu": "nav", "aside": "aside", "header": "header", "footer": "footer",
    "form": "form", "button": "form", "select": "form", "option": "form", "label": "form", "fieldset": "form", "dialog": "form", "article": "article", "main": "article",
    "section": "box", "div": "box", "p": "text", "pre": "text", "blockquote": "text", "figure": "text", "figcaption": "text", "address": "text", "details": "text", "summary": "text",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list",
    "li": "item", "dt": "item", "dd": "item", "table": "list", "thead": "list", "tbody": "list", "tfoot": "list", "tr": "list", "td": "item", "th": "item", "caption": "item", "a": "link",
}
BLOCKS = set(KINDS) - {"a", "button", "label", "select", "option"} | {"hr"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea iframe".split())
# Embedded elements, and all within a drawing or a formula: a slash closes them at once, and without text they say nothing about their page.
EMBEDDED = set("template noscript svg math object canvas audio video".split())
FOREIGN = {"svg", "math"}
# An opening tag ends an open element of these, up to one of those.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH_STOP = {"button", "table", "td", "th", "caption", "article", "section", "div", "body", "html", "li", "blockquote"}
# Whole words of class, id and role; the first group that has one of an element's words counts.
HINTS = {
    "comment": "comment comments commentlist reply replies discuss discussion discussions disqus respond",
    "advert": "ad ads adv advert adverts advertisement advertisements advertising promo promos promotion sponsor sponsored sponsors banner banners teaser teasers outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription signup paywall",
    "menu": "nav navbar navigation navigations menu menus menubar submenu breadcrumb breadcrumbs pagination pager toc tabs skip skiplink",
    "side": "sidebar widget widgets related recommend recommended recommendations recommendation popular trending tag tags tagcloud bio",
    "frame": "foot footer footers head header headers subheader masthead copyright logo brand branding",
    "tool": "share sharing social login search searchbox searchform form print toolbar rating follow",
    "content": "content contents article articles post posts entry story main body text prose",
}
HINT_OF = {word: name for name, words in HINTS.items() for word in words.split()}
HINT_ORDER = {name: i for i, name in enumerate(HINTS)}
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Quotes count after an equals sign only, so that an apostrophe elsewhere in a tag ends nothing. Every repetition is possessive: a byte is read once.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str
    chars: int = 0
    own: int = 0
    linked: int = 0
    label: bool | None = None
    embedded: bool = False
    foreign: bool = False
    above: str = ""

    @property
    def silent(self) -> bool:
        return self.embedded and not self.chars


@dataclass
class Page:
    """Elements in page order, and what they hold: (element, text), or None where a block begins or ends."""

    nodes: list[Node] = field(default_factory=list)
    parts: list[tuple[int, str] | None] = field(default_factory=list)


def parse(source: str) -> Page:
    """Elements and texts of a page, however broken. Raw elements (scripts, styles, text areas, inner frames) hold nothing."""
    page = Page([Node("html", -1, "")])
    stack, at, n, body = [0], 0, len(source), 0
    # How many elements of each tag are open, so that a search through them starts only if it finds one.
    opened: Counter[str] = Counter()

    def into_body() -> None:
        """What stands outside head and body belongs to the body, which need not be marked."""
        nonlocal body
        if not body:
            body = len(page.nodes)
            page.nodes.append(Node("body", 0, "", above="html"))
        stack.append(body)

    def text(raw: str) -> None:
        if len(stack) == 1 and not raw.isspace() and raw:
            into_body()
        if raw:
            page.parts.append((stack[-1], html.unescape(raw)))

    def close(depth: int) -> None:
        if any(page.nodes[i].tag in BLOCKS for i in stack[depth:]):
            page.parts.append(None)
        opened.subtract(page.nodes[i].tag for i in stack[depth:])
        del stack[depth:]

    def close_open(tags: set[str], stop: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.nodes[stack[depth]].tag
            if tag in tags:
                close(depth)
                return
            if tag in stop:
                return

    # Each search begins where the last token or raw element ended, so nothing inside a raw element reaches beyond it.
    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(m[0][9:].removesuffix("]]>"))
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if page.nodes[stack[depth]].tag == tag:
                    close(depth)
                    break
            continue
        if tag == "br":
            text(" ")
        elif tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
        elif m[3].rstrip().endswith("/") and (tag in EMBEDDED or page.nodes[stack[-1]].foreign):
            continue
        elif tag in VOID:
            if tag == "hr":
                page.parts.append(None)
        elif tag in ("html", "body") and (tag == "html" or body):
            continue
        else:
            if tag == "body":
                body = len(page.nodes)
                close(1)
            elif len(stack) == 1 and tag not in ("head", "title"):
                into_body()
            if tag in BLOCKS:
                close_open({"p"}, PARAGRAPH_STOP)
                page.parts.append(None)
            if tag in CLOSES:
                close_open(*CLOSES[tag])
            foreign = tag in FOREIGN or page.nodes[stack[-1]].foreign
            page.nodes.append(Node(tag, stack[-1], m[3], embedded=foreign or tag in EMBEDDED, foreign=foreign, above=page.nodes[stack[-1]].tag))
            stack.append(len(page.nodes) - 1)
            opened[tag] += 1
    text(source[at:].removesuffix("<"))  # a tag that was cut off is no text
    return page


def measure(page: Page) -> None:
    """Characters and linked characters below each element, and those straight in it."""
    links = [False] * len(page.nodes)
    for i, x in enumerate(page.nodes):
        links[i] = x.tag == "a" or (x.parent >= 0 and links[x.parent])
    for part in page.parts:
        if part:
            size = len("".join(part[1].split()))
            page.nodes[part[0]].chars += size
            page.nodes[part[0]].own += size
            page.nodes[part[0]].linked += size * links[part[0]]
    for x in reversed(page.nodes[1:]):
        page.nodes[x.parent].chars += x.chars
        page.nodes[x.parent].linked += x.linked


def looks(x: Node) -> tuple[str, ...]:
    """What the potentials see of an element; the first ties it to its parent: the kinds of both."""
    kind = KINDS.get(x.tag, "inline")
    hint = "none"
    if x.attributes:
        named = [(k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(x.attributes)]
        names = " ".join(v for k, v in named if k in ("class", "id", "role", "aria-label", "itemprop"))
        hints = {HINT_OF[w] for w in map(str.lower, NAME_WORDS.findall(names)) if w in HINT_OF}
        hint = min(hints, key=HINT_ORDER.get, default="none")
        if any(k in ("hidden", "aria-hidden") and v != "false" for k, v in named):
            hint = "notice"
    share = x.linked / x.chars if x.chars else -1
    density = "void" if share < 0 else "free" if share == 0 else "some" if share < 0.35 else "many" if share < 0.7 else "all"
    length, own = (next((str(c) for c in (0, 20, 80, 300) if n <= c), "long") for n in (x.chars, x.own))
    return f"{KINDS.get(x.above, 'inline')} {kind}", f"hint {hint}", f"{kind} links {density}", f"{kind} length {length}", f"{kind} own {own}"


@dataclass
class Model:
    """Relative counts: of states given the parent's state and the kind, and of looks given the state."""

    edges: dict[tuple[int, str], tuple[float, float]]
    looks: dict[str, tuple[float, float]]
    root: tuple[float, float]

    def marginals(self, page: Page) -> list[float]:
        """Probability that each element is content: messages up to the root, then down."""
        nodes = page.nodes
        n = len(nodes)
        here, up, edge = [None] * n, [None] * n, [None] * n
        for i, x in enumerate(nodes):
            kind, *seen = looks(x)
            a = b = 1.0
            for s in () if x.silent else seen:
                p, q = self.looks.get(s, (1.0, 1.0))
                a, b = a * p, b * q
            here[i] = [a / (a + b), b / (a + b)]
            edge[i] = (self.edges.get((0, kind), (0.5, 0.5)), self.edges.get((1, kind), (0.5, 0.5)))
        for i in range(n - 1, 0, -1):
            a, b = here[i]
            (e00, e01), (e10, e11) = edge[i]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            up[i] = (m0, m1)
            above = here[nodes[i].parent]
            a, b = above[0] * m0, above[1] * m1
            above[0], above[1] = a / (a + b), b / (a + b)
        out = [0.0] * n
        a, b = self.root[0] * here[0][0], self.root[1] * here[0][1]
        down = [None] * n
        down[0] = (a / (a + b), b / (a + b))
        out[0] = down[0][1]
        for i in range(1, n):
            # The parent's belief without this element's own message, through the edge, times what is seen here and below.
            p0, p1 = down[nodes[i].parent]
            p0, p1 = p0 / up[i][0], p1 / up[i][1]
            (e00, e01), (e10, e11) = edge[i]
            a, b = (p0 * e00 + p1 * e10) * here[i][0], (p0 * e01 + p1 * e11) * here[i][1]
            down[i] = (a / (a + b), b / (a + b))
            out[i] = down[i][1]
        return out


def train(pages: list[str], smooth: float = 0.05) -> Model:
    """Counts potentials over labelled pages: attribute x-main marks content and what is in it, x-not what isn't."""
    edges: dict[tuple[int, str], list[float]] = {}
    seen: dict[str, list[float]] = {}
    states = [smooth, smooth]
    for source in pages:
        page = parse(source)
        measure(page)
        for x in page.nodes:
            above = page.nodes[x.parent].label if x.parent >= 0 else False
            if x.silent:
                x.label = above
                continue
            x.label = True if "x-main" in x.attributes else False if "x-not" in x.attributes else above
            kind, *found = looks(x)
            states[x.label] += 1
            if x.parent >= 0:
                edges.setdefault((int(above), kind), [smooth, smooth])[x.label] += 1
            for s in found:
                seen.setdefault(s, [smooth, smooth])[x.label] += 1
    share = {k: (a / (a + b), b / (a + b)) for k, (a, b) in edges.items()}
    return Model(share, {s: (a / states[0], b / states[1]) for s, (a, b) in seen.items()}, (1 - 1e-3, 1e-3))


def extract(source: str | None, model: Model) -> str:
    """The page's content: blocks in page order, white space runs as one space, joined by line feeds."""
    if not source:
        return ""
    page = parse(source)
    measure(page)
    p = model.marginals(page)
    blocks, held = [], []
    for part in [*page.parts, None]:
        if part is None:
            if line := " ".join("".join(held).split()):
                blocks.append(line)
            held = []
        elif p[part[0]] >= 0.5:
            held.append(part[1])
    return "\n".join(blocks)


def labelled_pages(count: int = 1500, seed: int = 5) -> list[str]:
    """Labelled pages drawn from a grammar of common page layouts; stand in where no hand-labelled ones are given."""
    r = random.Random(seed)
    syllables = "ba be da do ga in ka lo ma ne or pa ri sa te un va zo".split()

    def words(least: int, most: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(least, most))).capitalize()

    def links(least: int, most: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(r.randint(least, most)))

    def named(*names: str) -> str:
        return r.choice([f'class="{r.choice(names)}"', f'id="{r.choice(names)}"'])

    def outside() -> str:
        return r.choice(
            [
                lambda: f"<nav><ul>{links(2, 9)}</ul></nav>",
                lambda: f"<div {named('menu', 'navbar', 'main-nav', 'breadcrumbs')}><ul>{links(2, 9)}</ul></div>",
                lambda: f"<header><a href='/'>{words(1, 3)}</a><p>{words(2, 8)}</p></header>",
                lambda: f"<div {named('site-header', 'masthead')}><h1>{words(1, 3)}</h1></div>",
                lambda: f"<div {named('ad', 'ads', 'advert', 'ad-banner', 'promo', 'sponsored')}>{words(1, 60)}</div>",
                lambda: f"<div {named('ad', 'advertisement')}><p>{words(1, 40)}</p></div>",
                lambda: f"<aside>{r.choice(['', f'<h3>{words(1, 3)}</h3>'])}<p>{words(3, 60)}</p><ul>{links(0, 5)}</ul></aside>",
                lambda: f"<div {named('sidebar', 'widget', 'related', 'recommended')}><h4>{words(1, 3)}</h4><ul>{links(2, 6)}</ul><p>{words(0, 30)}</p></div>",
                lambda: f"<div {named('cookie', 'cookie-notice', 'consent', 'newsletter', 'notice', 'alert')}><p>{words(4, 40)}</p><button>{words(1, 2)}</button></div>",
                lambda: f"<form {named('search', 'login', 'signup', 'f')}><label>{words(1, 2)}</label><input><button>{words(1, 1)}</button><p>{words(2, 20)}</p></form>",
                lambda: f"<section {named('comments', 'comment-list', 'discussion', 'replies')}><h2>{words(1, 2)}</h2>"
                + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(3, 80)}</p></div>' for _ in range(r.randint(1, 4)))
                + "</section>",
                lambda: f"<ol {named('comments', 'commentlist')}>" + "".join(f"<li><p>{words(3, 60)}</p></li>" for _ in range(r.randint(1, 4))) + "</ol>",
                lambda: f"<footer>{words(2, 30)}<a href='/'>{words(1, 2)}</a></footer>",
                lambda: f"<footer>&copy; {words(2, 30)}</footer>",
                lambda: f"<div {named('footer', 'copyright', 'site-footer')}><p>{words(2, 20)}</p></div>",
                lambda: f"<div {named('share', 'social')}><a href='/'>{words(1, 1)}</a> <a href='/'>{words(1, 1)}</a></div>",
            ]
        )()

    def inside() -> str:
        return r.choice(
            [
                lambda: f"<p>{words(1, 120)}</p>",
                lambda: f"<p>{words(1, 120)}</p>",
                lambda: f"<p>{words(5, 40)} <a href='/'>{words(1, 3)}</a> {words(3, 30)} <em>{words(1, 3)}</em></p>",
                lambda: f"<p><b>{words(3, 80)}.<br><p>{words(3, 80)}</p>",
                lambda: f"<p><b>{words(1, 80)}<br>",
                lambda: f"<h2>{words(1, 8)}</h2><p>{words(10, 90)}</p>",
                lambda: f"<ul>{''.join(f'<li>{words(1, 25)}</li>' for _ in range(r.randint(1, 6)))}</ul>",
                lambda: f"<ol><li>{words(2, 20)} <a href='/'>{words(1, 3)}</a></li><li>{words(2, 20)}</li></ol>",
                lambda: f"<blockquote><p>{words(3, 40)}</p></blockquote>",
                lambda: f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 6)}</td></tr></table>",
                lambda: f"<figure><img><figcaption>{words(2, 15)}</figcaption></figure>",
                lambda: f"<div><p>{words(3, 60)}</p><p>{words(3, 60)}</p></div>",
                lambda: f"<section><h3>{words(1, 6)}</h3><p>{words(10, 60)}</p></section>",
                lambda: f"<pre>{words(2, 30)}</pre>",
                lambda: f"<div>{words(5, 80)}</div>",
                lambda: f"<dl><dt>{words(1, 3)}</dt><dd>{words(2, 12)}</dd></dl>",
                lambda: f"<div {named('section', 'row', 'information', 'part', 'col', 'block-a', 'inner')}><p>{words(3, 60)}</p><p>{words(3, 60)}</p></div>",
                lambda: f"<table><tr><th>{words(1, 2)}</th><th>{words(1, 2)}</th></tr>{''.join(f'<tr><td>{words(1, 9)}</td><td>{words(1, 3)}</td></tr>' for _ in range(r.randint(1, 5)))}</table>",
            ]
        )()

    def apart() -> str:
        """What stands in an article without being part of it."""
        name = r.choice(["ad", "advert", "promo", "share", "social", "related", "newsletter", "comments", "cookie-notice"])
        return r.choice(
            [
                lambda: f'<div x-not class="{name}"><p>{words(1, 40)}</p></div>',
                lambda: f'<div x-not class="{name}">{words(1, 40)}</div>',
                lambda: f"<aside x-not><p>{words(2, 40)}</p></aside>",
                lambda: f"<nav x-not><ul>{links(1, 4)}</ul></nav>",
                lambda: f"<footer x-not>{words(1, 20)}</footer>",
                lambda: f"<form x-not><input><button>{words(1, 2)}</button></form>",
                lambda: f'<section x-not class="comments"><h3>{words(1, 2)}</h3><p>{words(3, 60)}</p></section>',
            ]
        )()

    def wrapped(main: str) -> str:
        """The content within further elements that say little."""
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 4])):
            name = r.choice(["", named("wrap", "container", "page", "row", "outer", "site", "layout", "col-8")])
            main = r.choice([f"<div {name}>{main}</div>", f"<main>{main}</main>", f"<section {name}>{main}</section>", f"<div>{main}</div>"])
        return main

    pages = []
    for _ in range(count):
        # An article's own header holds its headline and belongs to it.
        title = f"<h1>{words(1, 12)}</h1>"
        title = r.choice([title, title, title, f"<header>{title}</header>", f"<header>{title}<p>{words(2, 20)}</p></header>"])
        body = [title] * (r.random() < 0.85) + [inside() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(0, len(body)), apart())
        before, after = [outside() for _ in range(r.randint(0, 4))], [outside() for _ in range(r.randint(0, 4))]
        kind, attributes = r.random(), ""
        if kind < 0.2:
            # Straight under body, or as bare text between what surrounds it.
            if r.random() < 0.3:
                attributes, main = "x-main", r.choice([words(3, 60), words(3, 200), f"{words(3, 200)}<br>{words(1, 90)}"])
                if r.random() < 0.5:
                    before, after = [], []
            else:
                main = "".join(x if "x-not" in x else re.sub(r"<(\w+)", r"<\1 x-main", x) for x in body)
            before, after = (["<div x-not>" + x + "</div>" if r.random() < 0.2 else re.sub(r"^<(\w+)", r"<\1 x-not", x) for x in side] for side in (before, after))
        else:
            tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
            name = r.choice(["", named("post", "content", "entry")])
            if tag in ("div", "section"):
                name = r.choice(["", named("content", "post", "entry-content", "article-body", "story"), named("platform", "inside", "primary", "left", "center", "page-1")])
            main = wrapped(f"<{tag} x-main {name}>{''.join(body)}</{tag}>")
        head = f"<head><meta><title>{words(1, 10)}</title><style>p{{}}</style></head>"
        pages.append(f"<!DOCTYPE html><html>{head}<body {attributes}>{''.join(before)}{main}{''.join(after)}</body></html>")
    return pages


def main_text(pages: DataFrame, labelled: list[str] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points). A page that is null, empty or without content has an empty text.
    An article's own header, with its headline, belongs to it; the page's header doesn't.

    labelled: pages with x-main and x-not marks to train on; by default drawn ones. Pages are read whole; rows are independent of each other.
    """
    prepare(pages.sparkSession)
    model = train(labelled_pages() if labelled is None else labelled)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            texts = [extract(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
