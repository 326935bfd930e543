"""HTML extraction by tag-path ratios.

Method: a page is cut into text nodes, each under its root-to-leaf path of tags (with class, id and role of containers).
Nodes with one path are aggregated: text length per node, and punctuation marks per character. Both ratios are smoothed over
the page's order of nodes with a Gaussian window, fused, and nodes above a threshold, a share of the standard
deviation, are content. Paths that only boilerplate elements hold (navigation, forms, notices, comments and the like, by
tag, role or a class name or id) have no weight, unless a class or id alone marks an element that holds the page's only articles or nearly all other text; where a page marks its article (article or main), paths outside it have none.
The smoothed ratios are fused with the path's own, so that an odd short block between paragraphs isn't carried by its neighbours; a path
whose text is mostly links has no weight. All nodes of the block that holds content paths are content too: short paragraphs of
the article stay. Within a marked article further containers stay unless their paths' ratios are those of boilerplate (neither punctuation nor length); lists, tables and quotations belong to the block around them, and headings stay.

Output: character references decoded, white space within a block made one space, blocks in page order joined by one space.

Defined results: null, empty or text-free html gives "" ; plain text without tags is one block; unclosed or stray tags
are balanced as browsers do for paragraphs, list items and cells, and ignored otherwise; equal rows give equal texts; pages of any length are read whole.
"""

from __future__ import annotations

import html as references
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a block; all others begin and end one.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
#: Last words of a class name or id (cut at non-letters and at capitals) that mark boilerplate.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "cookie", "cookies", "consent", "copyright", "disqus", "disclaimer", "footer", "foot", "form", "gdpr",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "topbar", "widget", "widgets", "skip", "discussion", "alert", "toc", "tags", "cta",
}
#: Words after a mark that only say where or what kind of box it is, and words that make a name say something of another element.
PLACES = {"area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "group", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "logo", "main", "media", "mobile", "outer", "panel", "posts", "primary", "right", "row", "secondary", "section", "slot", "sticky", "text", "top", "unit", "wrap", "wrapper"}
OF_OTHERS = {"has", "no", "not", "with", "without", "hide", "show"}
#: Marks that are as likely a section's subject within an article; the ratios decide there.
SUBJECTS = {"discussion", "notice", "notices", "alert", "disclaimer"}
#: Marks that tell a reader's comment where each is an article of its own, and marks that an article's own parts have.
GUESTS = {"comment", "comments", "reply", "replies", "respond"}
INSIDE = {"header", "masthead"}
#: Containers that belong to the block around them within an article.
WITHIN = {"ul", "ol", "table", "td", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？؟،]")
#: Start tags that end an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


@dataclass(frozen=True)
class Ratios:
    #: Reach of the smoothing window, in nodes on either side.
    reach: int = 2
    #: Content lies above this share of the standard deviation of the fused ratios.
    share: float = 1.1
    #: Weight of a path's own ratios against those that its neighbours smooth.
    own: float = 2 / 3
    #: Within a marked article a container without content stays if a path of it has so many punctuation marks or characters a node.
    marks: float = 0.5
    length: float = 80


@dataclass
class Node:
    path: tuple
    blocked: bool
    article: int
    block: int
    container: int
    text: list = field(default_factory=list)
    #: Characters outside white space, and those of them in links.
    chars: int = 0
    links: int = 0
    #: Elements around it that a class or id marks, and the outermost article.
    marks: tuple = ()
    story: int = 0


def marked(tag: str, attributes: str) -> bool:
    """Boilerplate by tag, role or being hidden."""
    if tag in BOILERPLATE:
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def named(tag: str, attributes: str, article: int) -> bool:
    """Boilerplate by a class name or id: as a whole, or by its last word but for words of place."""
    if tag in ("html", "body", "main"):
        return False
    of = GUESTS if tag == "article" else MARKS - INSIDE if article else MARKS
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for one in "".join(values).split():
                words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", one)]
                while len(words) > 1 and words[-1] in PLACES:
                    words.pop()
                if words and not OF_OTHERS.intersection(words) and ("".join(words) in of or words[-1] in of) and not (article and words[-1] in SUBJECTS and MARKS.isdisjoint(words[:-1])):
                    return True
    return False


def settle(nodes: list[Node], outside: set[int]) -> None:
    """Blocks nodes under marked elements, but for elements that hold the only articles and more text than is left, or nine times as much as is left."""
    held: dict[int, int] = {}
    under: dict[int, list[int]] = {}
    stories: dict[int, int] = {}
    for k, x in enumerate(nodes):
        for m in x.marks:
            held[m] = held.get(m, 0) + (0 if x.blocked else x.chars)
            under.setdefault(m, []).append(k)
            stories[m] = stories.get(m, 0) + bool(x.story and not x.blocked)
    all_stories = sum(bool(x.story and not x.blocked) for x in nodes)
    waiting = [len(x.marks) for x in nodes]  # marks around a node that aren't void
    left = sum(x.chars for x in nodes if not x.blocked and not x.marks)
    for m in sorted(held, key=lambda m: (-held[m], m)):
        # What is left only grows and held text shrinks, so no later element passes either.
        if held[m] <= left:
            break
        only = m in outside and 0 < all_stories == stories[m]
        if held[m] > (1 if only else 9) * left:
            for k in under[m]:
                waiting[k] -= 1
                if not waiting[k] and not nodes[k].blocked:
                    left += nodes[k].chars
    for x, n in zip(nodes, waiting, strict=True):
        x.blocked = x.blocked or n > 0


def parse(page: str) -> list[Node]:
    """Text nodes by block: one for each run of text that no block element interrupts."""
    # Each open element: (tag, path, boilerplate, article depth, container number, link, marks, outermost article).
    stack: list[tuple] = [("", (), False, 0, 0, False, (), 0)]
    nodes: list[Node] = []
    block, containers, marks_, stories, at, n = 0, 0, 0, 0, 0, len(page)
    outside: set[int] = set()
    last: Node | None = None

    def text(raw: str) -> None:
        nonlocal last
        if not raw:
            return
        _, path, blocked, article, container, link, marks, story = stack[-1]
        if last is None or last.block != block or last.blocked != blocked or last.marks != marks:
            if not raw.strip():
                return
            # Inline elements are part of their block's node; its path is that of the first text.
            last = Node(path, blocked, article, block, container, marks=marks, story=story)
            nodes.append(last)
        last.text.append(raw)
        chars = len("".join(raw.split()))
        last.chars += chars
        last.links += chars * link

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(references.unescape(page[at:]))
            break
        text(references.unescape(page[at : m.start()]))
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                text(m.group()[9:].removesuffix("]]>"))
            continue
        if m.group(1):
            if tag not in INLINE:
                block += 1
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag not in INLINE:
            block += 1
        if tag in VOID or m.group(3).endswith("/") and tag not in ("p", "div", "article", "span", "a"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        elif tag in CLOSE_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        _, path, blocked, article, container, link, marks, story = stack[-1]
        own = tag == "header" and not article or marked(tag, m.group(3))
        if tag in ("div", "section", "article", "main", "td", "body", "ul", "ol", "table", "blockquote", "form", "nav", "aside", "header", "footer") and not (article and tag in WITHIN):
            containers += 1
            container = containers
        if m.group(3) and named(tag, m.group(3), article):
            marks_ += 1
            marks = (*marks, marks_)
            if not article:
                outside.add(marks_)
        if tag in ("article", "main") and not article:
            stories += 1
            story = stories
        stack.append((tag, path if tag in INLINE else (*path, tag), blocked or own, article + (tag in ("article", "main")), container, link or tag == "a", marks, story))
    if marks_:
        settle(nodes, outside)
    return nodes


def extract(page: str, how: Ratios = Ratios()) -> str:
    nodes = parse(page)
    for node in nodes:
        node.text = " ".join("".join(node.text).split())
    nodes = [x for x in nodes if x.text]
    if not nodes:
        return ""
    marked_article = any(x.article and not x.blocked for x in nodes)
    open_ = [not x.blocked and (x.article > 0 or not marked_article) for x in nodes]
    sums: dict[tuple, list] = {}
    for x, free in zip(nodes, open_, strict=True):
        own = sums.setdefault((x.path, free), [0, 0, 0, 0, 0])
        own[0] += len(x.text)
        own[1] += len(PUNCTUATION.findall(x.text))
        own[2] += 1
        own[3] += x.chars
        own[4] += x.links
    heading = [x.path[-1:] != () and x.path[-1] in HEADINGS for x in nodes]
    # Mostly links: a list of links, not a paragraph that is one among others without.
    # A bare container's text is judged by itself, as its path says little of it.
    bare = lambda x: x.path[-1:] != () and x.path[-1] in ("div", "section") and 2 * x.links > x.chars
    linked = [f and not h and (2 * sums[x.path, f][4] > sums[x.path, f][3] or bare(x)) for x, f, h in zip(nodes, open_, heading, strict=True)]
    if all(n for n, f in zip(linked, open_, strict=True) if f):
        linked = [False] * len(nodes)
    weight = [f and not n for f, n in zip(open_, linked, strict=True)]
    length = [sums[x.path, True][0] / sums[x.path, True][2] if w else 0.0 for x, w in zip(nodes, weight, strict=True)]
    marks = [(1 + sums[x.path, True][1]) / (1 + sums[x.path, True][2]) if w else 0.0 for x, w in zip(nodes, weight, strict=True)]
    smooth_length, smooth_marks = smooth(length, how.reach), smooth(marks, how.reach)
    fused = [math.sqrt(a * b) * (c > 0) for a, b, c in zip(smooth_length, smooth_marks, length, strict=True)]
    fused = [v ** (1 - how.own) * math.sqrt(a * b) ** how.own for v, a, b in zip(fused, length, marks, strict=True)]
    mean = sum(fused) / len(fused)
    limit = min(how.share * math.sqrt(sum((v - mean) ** 2 for v in fused) / len(fused)), max(fused))
    content = [w and v > 0 and v >= limit for w, v in zip(weight, fused, strict=True)]
    # In containers that hold content all nodes with weight stay, however short, and the article's headings.
    holds = {x.container for x, c in zip(nodes, content, strict=True) if c}
    if marked_article:
        for x, w, h in zip(nodes, weight, heading, strict=True):
            if w and not h:
                chars, punctuation, n, *_ = sums[x.path, True]
                if punctuation >= how.marks * n or chars >= how.length * n:
                    holds.add(x.container)
    return " ".join(x.text for x, w, c, h in zip(nodes, weight, content, heading, strict=True) if c or w and (h and marked_article or x.container in holds))


def smooth(values: list[float], reach: int) -> list[float]:
    """Weighted means with a Gaussian window."""
    if not reach:
        return values
    kernel = [math.exp(-(k * k) / (2 * reach * reach / 4 or 1)) for k in range(reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k in range(-reach, reach + 1):
            if 0 <= i + k < n:
                total += kernel[abs(k)] * values[i + k]
                weight += kernel[abs(k)]
        out.append(total / weight)
    return out


def main_texts(pages: DataFrame, how: Ratios = Ratios(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages; no shuffle."""
    mine = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def make():
        def each(batch):
            found = [extract(t, how) for t in texts(batch, "html")]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

        return each

    return map_rows(mine, make, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
