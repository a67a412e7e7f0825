"""Main text of web pages by tag-path ratios.

A page is read once into text runs, each under the path of block tags from the root to its leaf. Per path
the runs' length, punctuation and count give a ratio (text and punctuation per run); ratios are smoothed
over neighbouring paths in page order and fused with the ratio of the path's container, the subtree it
stands in, so that a short heading or list item of an article shares the article's weight. Paths whose fused
ratio passes the threshold are content. Elements whose tag or whole class, id or role token names what stands
around an article (fixed values below) have their paths' ratio lowered; it does not count for the threshold.
An element that holds an article, the main part or the heaviest container is not such a one, whatever its
name. Where the heaviest container is an article, ratios outside articles are lowered too. A page is one
row; pages need no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tags of the HTML standard by what they do to a text.
#: Elements whose content is code or never shown.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "audio", "video", "map"}
#: Elements whose content is read as plain characters up to their end tag.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand inside a line of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements around an article.
AROUND = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "textarea", "dialog", "fieldset", "input", "datalist"}
#: Words of class, id and role tokens that name what stands around an article.
AROUND_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form",
                "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promotion", "related", "replies",
                "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "widgets", "complementary", "contentinfo", "search", "alert", "overlay"}
#: Such words on an article, which may be a reader's comment or a teaser.
NO_ARTICLE = {"ad", "advert", "comment", "comments", "promo", "related", "replies", "reply", "sponsored", "teaser"}
#: Words that may stand beside such a word in one token without changing what it names.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "card", "container", "global", "icons", "inner", "item", "left", "link", "links", "list", "main", "page", "primary", "right", "secondary", "section",
           "site", "slot", "top", "unit", "wrap", "wrapper"}
#: Elements around an article that may hold teasers written as articles.
TEASERS = {"nav", "footer", "aside", "menu", "dialog"}
#: Elements whose id is a link target named after their text.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An open element that another of its kind ends, and the elements it is looked for in.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu", "body", "html"}
#: Elements that hold a part of a page of their own.
CONTAINERS = {"article", "main", "section", "div", "td", "body", "html", "header"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z!?/][^>]*+>?", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
HIDE = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
SPACES = re.compile(r"\s+")
WORD_ENDS = re.compile(r"[^a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")

#: Share of the best path's fused ratio from which a path is content.
THRESHOLD = 0.1
#: What the weight of a container counts in the choice of the heaviest if it is named as around an article, if it is so named and holds most of the page, and if it is in an article.
DOUBTED, MOST, RAISED = 0.01, 0.1, 4.0
#: What the fused ratio of a path counts if it is around an article, and if it is outside the articles of a page whose heaviest container is one.
LOWERED, OUTSIDE = 0.002, 0.05


@dataclass
class Path:
    """What the runs under one tag path add up to."""

    container: int
    runs: int = 0
    chars: int = 0
    marks: int = 0


@dataclass
class Element:
    tag: str
    path: int
    doubted: bool
    hidden: bool
    container: int
    in_article: bool


@dataclass
class Page:
    """Blocks of text in page order (path number, text), the paths, and of every container its parent, its tag, whether it is named as around an article, and whether it is in one."""

    blocks: list[tuple[int, str]] = field(default_factory=list)
    paths: list[Path] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    kinds: list[str] = field(default_factory=lambda: [""])
    doubted: list[bool] = field(default_factory=lambda: [False])
    in_article: list[bool] = field(default_factory=lambda: [False])


@lru_cache(100_000)
def _names(token: str, article: bool) -> bool:
    """Whether a token as a whole names what stands around an article: it has such a word, and no word that may mean something else."""
    names = NO_ARTICLE if article else AROUND_NAMES
    words = [w for w in WORD_ENDS.split(token.lower()) if w]
    return any(w in names for w in words) and all(w in names or w in NEUTRAL or w.isdigit() for w in words)


def _named(tag: str, attributes: str) -> bool:
    return any(_names(token, tag == "article") for name, *value in NAMES.findall(attributes) if tag not in HEADINGS or name.lower() != "id" for token in "".join(value).split())


def read(source: str) -> Page:
    """Cut the source into blocks under their tag paths; never fails on broken markup."""
    page, numbers, steps, opened = Page(), {}, {}, Counter()
    stack = [Element("", 0, False, False, 0, False)]
    text: list[str] = []

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def flush() -> None:
        run = SPACES.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        top = stack[-1]
        if not run or top.hidden:
            return
        key = (top.path, top.container)
        if key not in numbers:
            numbers[key] = len(page.paths)
            page.paths.append(Path(top.container))
        path = page.paths[numbers[key]]
        path.runs += 1
        path.chars += len(run)
        path.marks += len(PUNCTUATION.findall(run))
        page.blocks.append((numbers[key], run))

    def close(tags: set[str], scopes: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in scopes:
                return

    at = 0
    while (m := TOKEN.search(source, at)) is not None:
        if not stack[-1].hidden:
            text.append(source[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "br" and not stack[-1].hidden:
                text.append(" ")
            continue
        if not ends and tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = stop.end() if stop else len(source)
            continue
        flush()
        if ends:
            if tag == "p":
                close({"p"}, CONTAINERS)
            elif opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in ENDS_P and opened["p"]:
            close({"p"}, CONTAINERS | {"li", "td", "blockquote"})
        if tag in SIBLINGS:
            while any(e.tag in SIBLINGS[tag] for e in _inside(stack)):
                pop()
        if tag == "body":
            while stack[-1].hidden and len(stack) > 1:
                pop()
        if tag in VOID or m[3].endswith("/") and tag not in ENDS_P:
            continue
        top, attributes = stack[-1], m[3]
        doubted = tag in AROUND or tag == "header" and not top.in_article or tag not in ("html", "body", "main") and _named(tag, attributes)
        in_article = top.in_article or tag == "main" or tag == "article" and not doubted and not any(opened[t] for t in TEASERS)
        container = top.container
        if tag in CONTAINERS or doubted:
            container = len(page.parents)
            page.parents.append(top.container)
            page.kinds.append(tag)
            page.doubted.append(doubted)
            page.in_article.append(in_article)
        hidden = top.hidden or tag in HIDDEN or bool(HIDE.search(attributes))
        stack.append(Element(tag, steps.setdefault((top.path, tag), len(steps) + 1), doubted, hidden, container, in_article))
        opened[tag] += 1
    if not stack[-1].hidden:
        text.append(source[at:])
    flush()
    return page


def _inside(stack: list[Element]) -> list[Element]:
    """The open elements up to the nearest list or table."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in SCOPES or stack[i].tag == "":
            return stack[i + 1:]
    return stack


def around(page: Page) -> tuple[list[bool], int]:
    """Which containers are around an article or in one that is, and the heaviest container."""
    n = len(page.parents)
    doubted, cleared = list(page.doubted), [False] * n
    # whatever holds an article or the main part is not around it
    for c in range(1, n):
        above = page.parents[c]
        if page.in_article[c] and not page.in_article[above] and not page.doubted[c]:
            while above > 0 and not cleared[above]:
                doubted[above], cleared[above] = False, True
                above = page.parents[above]

    def inherited() -> list[bool]:
        out = list(doubted)
        for c in range(1, n):
            out[c] = out[c] or out[page.parents[c]]
        return out

    out = inherited()
    own = [0.0] * n
    for p in page.paths:
        own[p.container] += p.chars * (1 + p.marks / p.runs)
    inside = list(own)
    for c in range(n - 1, 0, -1):
        inside[page.parents[c]] += inside[c]
    most = [False] * n
    for c in range(1, n):
        most[c] = most[page.parents[c]] or out[c] and 2 * inside[c] > inside[0]
    weight = [w * (1.0 if not out[c] else MOST if most[c] else DOUBTED) for c, w in enumerate(own)]
    for c in range(n - 1, 0, -1):
        if page.kinds[page.parents[c]] not in ("", "html", "body"):
            weight[page.parents[c]] += 0.5 * weight[c]
    heaviest = max(range(n), key=lambda c: weight[c] * (RAISED if page.in_article[c] and not out[c] else 1.0))
    if out[heaviest]:
        # nor is what holds most of the text of a page without any other content
        c = heaviest
        while c > 0:
            if 2 * inside[c] > inside[0]:
                doubted[c] = False
            c = page.parents[c]
        out = inherited()
    return out, heaviest


def ratios(page: Page) -> list[tuple[float, bool]]:
    """The fused ratio of every path: its own, smoothed over its neighbours, times that of its container; and whether the path is around the content."""
    beside, heaviest = around(page)
    in_article = [page.in_article[c] and not beside[c] for c in range(len(beside))]
    factor = [(LOWERED if b else 1.0) * (OUTSIDE if in_article[heaviest] and not page.in_article[c] else 1.0) for c, b in enumerate(beside)]
    own = [p.chars / p.runs * (1 + p.marks / p.runs) * factor[p.container] for p in page.paths]
    n = len(page.parents)
    weight = [0.0] * n
    for p in page.paths:
        weight[p.container] += p.chars * (1 + p.marks / p.runs) * factor[p.container]
    total = sum(weight) or 1.0
    # half of a container's weight counts for the one around it, so that an article cut into boxes stays one
    for c in range(n - 1, 0, -1):
        if page.kinds[page.parents[c]] not in ("", "html", "body"):
            weight[page.parents[c]] += 0.5 * weight[c]
    for c in range(1, n):
        above = page.parents[c]
        if page.kinds[above] not in ("", "html", "body") and factor[c] >= factor[above]:
            weight[c] = max(weight[c], weight[above] * (1.0 if in_article[above] else 0.5))
    smooth = []
    for i, p in enumerate(page.paths):
        near = [(own[j], 2 if j == i else 1) for j in (i - 1, i, i + 1) if 0 <= j < len(own) and page.paths[j].container == p.container]
        smooth.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    best = max(smooth, default=0.0) or 1.0
    return [((0.5 + 0.5 * s / best) * weight[p.container] / total, beside[p.container]) for p, s in zip(page.paths, smooth, strict=True)]


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    """The content blocks of a page, one per line."""
    page = read(source or "")
    fused = ratios(page)
    best = max((ratio for ratio, beside in fused if not beside), default=0.0)
    return "\n".join(run for path, run in page.blocks if best > 0 and fused[path][0] >= threshold * best)


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with ``text`` (empty if none) and ``n_chars`` (its code points) of every row.

    A null or empty source has an empty text. Repeated rows and null ids stay; other columns are left out; a
    kept column with the name of a result is replaced by it.
    """
    names = [n for n in keep if n not in ("text", "n_chars")]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), threshold) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return df.select(*names, html_col).mapInArrow(run, schema)
