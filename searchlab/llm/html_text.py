"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped so that each block element leaves one line. Lines of menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments keep their place but lose their
text, and where the page marks its article or main part, so do the lines outside it. The text
lengths of ``WINDOW`` consecutive lines are summed; the main text starts where the sum
first surges above a threshold and ends with the dive back to nothing after its last surge. All lines
between that are not skipped are kept, and so are those before and after, up to a menu of links. On pages with
a marked article or main part the threshold is 0, so there the marks decide alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: A window of more characters begins the main text of a page without marked parts, however long others are.
#: Where none has more, every line that is not skipped is kept.
SURGE = 86

# Element names and words of the HTML language and of common page templates.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "label", "fieldset"}
UNREAD = {"script", "style", "textarea", "title"}  # of these, without an end tag they reach to the end of the page
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "popup", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
READER_WORDS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
TITLE_WORDS = {"header", "masthead", "banner"}
CONTENT_WORDS = {"article", "blog", "content", "entry", "news", "post", "story", "title"}
HAVING = {"has", "have", "no", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
# Elements that may go without an end tag: the start tags that end them, and the elements that, when open
# inside them, hold such tags of their own.
ENDED_BY = {
    "p": (BLOCK, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|"
    # A quote opens a value only behind an equals sign; any other is a character like the rest.
    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>",
    re.DOTALL,
)
# One attribute: its name and, quoted or not, its value. Matches follow one another, so no value is read as a name.
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag; of a repeated name the first counts, as in browsers."""
    found: dict[str, str] = {}
    for one in _ATTRIBUTE.finditer(source):
        found.setdefault(one[1].lower(), (one[2] or one[3] or one[4] or "").lower())
    return found


def _side_words(name: str, value: str, in_main: bool) -> set[str]:
    """Words of a class or id that name a side part.

    Names that tell what an element has or lacks (has-sidebar, layout--sidebar) do not name the element,
    and the header of an article or a heading is its title.
    """
    words: set[str] = set()
    for one in value.split():
        parts = _WORDS.findall(one.split("--")[0] or one)
        if parts and parts[0] in HAVING:
            continue
        side = ASIDE_WORDS.intersection(parts)
        if in_main or name in HEADINGS or CONTENT_WORDS.intersection(parts):
            side -= TITLE_WORDS
        words |= side
    return words


def _aside(name: str, source: str, in_main: bool) -> str:
    """Why an element is a menu, notice, advert or the like: tag, hidden, readers, form or box; else empty.

    Forms and boxes may turn out to be wrappers of the whole page.
    """
    if name in ASIDE:
        return "" if name == "header" and in_main else "form" if name == "form" else "tag"
    if name in MAIN or name in ("html", "body") or not source:
        return ""
    attributes = _attributes(source)
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "hidden"
    words = _side_words(name, attributes.get("class", ""), in_main) | _side_words(name, attributes.get("id", ""), in_main)
    if words:
        return "readers" if words <= READER_WORDS else "box"
    role = attributes.get("role", "").split()[:1]
    return "box" if role and role[0] in ASIDE_ROLES and not (in_main and role[0] == "banner") else ""


def _ends(skipped: str, name: str, closing: bool, inside: Counter, around: Counter) -> bool:
    """Whether a tag ends the skipped element though it is not the end tag of it.

    That is the end of an element around it, or a start that an element without end tag cannot hold.
    """
    if closing:
        return name not in ENDED_BY and not inside[name] and around[name] > 0
    starts, holders = ENDED_BY.get(skipped, ((), ()))
    return name in starts and not any(inside[h] for h in holders)


@dataclass
class _Skipped:
    """A skipped element: why, whether it lies in the article or main part, and the characters that it holds."""

    why: str
    in_main: bool
    chars: int = 0
    has_main: bool = False
    parts: list[int] = field(default_factory=list)  # of each article or main part inside of it


def _wrappers(skipped: dict[int, _Skipped], parts: list[int], has_main: bool, kept: int) -> set[int]:
    """Skipped elements that hold the article or main part, or most of the text of a page without one.

    ``parts`` are the characters kept of each article or main part, ``kept`` those of the page.
    """
    found = set()
    total = kept + sum(s.chars for s in skipped.values())
    for at, one in skipped.items():
        box = one.why in ("box", "form")
        if one.parts:
            rest = max(parts) if parts else kept
            only = box and not parts and len(one.parts) == 1
            if one.has_main and not has_main or only or max(one.parts) > rest:
                found.add(at)
        elif box and not parts and 2 * one.chars > total:
            found.add(at)
    if parts and not max(parts) and not found:
        # Nothing is left of the article: the largest box in it is its text.
        boxes = [(one.chars, -at) for at, one in skipped.items() if one.in_main and one.why in ("box", "form") and one.chars]
        found |= {-max(boxes)[1]} if boxes else set()
    return found


def lines_of(page: str) -> tuple[list[str], list[bool], list[bool], bool]:
    """Lines of a page in order, whether each is content, whether it is links only, whether an article is marked.

    An element that is named like a side part but holds the article is read like any other.
    """
    spared: set[int] = set()
    while True:
        *result, wrappers = _read_lines(page, spared)
        if not wrappers:
            return tuple(result)
        spared |= wrappers


def _read_lines(page: str, spared: set[int]) -> tuple[list[str], list[bool], list[bool], bool, set[int]]:
    """Lines as ``lines_of`` gives them, and the places of skipped elements that are to be spared next.

    Missing end tags are read as browsers do for paragraphs, list items and cells, so that a side part
    without one does not reach over the text after it.
    """
    lines: list[str] = []
    content: list[bool] = []
    links: list[bool] = []
    marked: list[bool] = []
    current: list[str] = []
    skipped, in_main, any_main = "", 0, False
    boxes: dict[int, _Skipped] = {}
    box = None
    parts: list[int] = []  # characters kept of each article or main part
    has_main = False
    in_link, plain = False, False  # plain: the current line has text outside of links, or is a heading
    endless: set[str] = set()  # elements of which no end tag follows any more
    around, inside = Counter(), Counter()  # open blocks outside and inside of the skipped element

    def flush() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(current)).split())
        if text:
            lines.append(text)
            content.append(not skipped)
            links.append(not plain)
            marked.append(in_main > 0)
            if skipped:
                box.chars += len(text)
                if box.parts and any(inside[m] for m in MAIN):
                    box.parts[-1] += len(text)
            elif in_main:
                parts[-1] += len(text)
        current.clear()
        plain = False

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        current.append(page[at : token.start() if token else len(page)])
        plain = plain or not in_link and not current[-1].isspace() and bool(current[-1])
        if token is None:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        closing = bool(token[1])
        if name in RAW and not closing:
            if not (token[3] or "").endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in UNREAD:
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if name == "a":
            in_link = not closing and "href" in _attributes(token[3] or "")
        if name in BLOCK:
            flush()
            plain = name in HEADINGS and not closing
        elif name == "br":
            current.append("\n")
        counted = name in BLOCK and name not in VOID
        if skipped and name in BLOCK and _ends(skipped, name, closing, inside, around):
            flush()
            skipped = ""
        if skipped:
            if counted or name == skipped:
                if name in MAIN and not closing:
                    box.has_main |= name == "main"
                    if not any(inside[m] for m in MAIN):
                        box.parts.append(0)
                inside[name] = max(0, inside[name] + (-1 if closing else 1))
                if not inside[skipped]:
                    flush()
                    skipped = ""
            continue
        why = "" if closing or name in VOID or token.start() in spared else _aside(name, token[3] or "", in_main > 0)
        if why:
            flush()
            skipped, inside = name, Counter({name: 1})
            box = boxes[token.start()] = _Skipped(why, in_main > 0)
            continue
        if counted:
            around[name] = max(0, around[name] + (-1 if closing else 1))
        if name in MAIN:
            if not closing:
                has_main |= name == "main"
                if not in_main:
                    parts.append(0)
            in_main = max(0, in_main + (-1 if closing else 1))
            any_main = any_main or not closing
    flush()
    kept = sum(len(x) for x, c in zip(lines, content) if c)
    if any_main:
        content = [c and m for c, m in zip(content, marked)]
    return lines, content, links, any_main, _wrappers(boxes, parts, has_main, kept)


def stretches(lengths: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Ranges of lines from each surge of the window sum to the dive that follows it."""
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(WINDOW, lengths.dtype))[WINDOW - 1 :]
    found, at = [], 0
    while at < len(sums):
        if sums[at] > threshold:
            end = at
            while end < len(sums) and sums[end] > 0:
                end += 1
            found.append((at, end))
            at = end
        at += 1
    return found


def _neighbours(content: list[bool], links: list[bool], start: int, end: int) -> tuple[int, int]:
    """The range with the content lines before and after it, up to ``WINDOW`` lines of links in a row.

    Skipped lines between do not end it, since they tell nothing of the lines behind them.
    """

    def reach(places: range, edge: int) -> int:
        run, last = 0, edge
        for i in places:
            if not content[i]:
                continue
            run = run + 1 if links[i] else 0
            if run == WINDOW:
                return edge
            last = i
            if not run:
                edge = i
        return last

    return reach(range(start - 1, -1, -1), start), reach(range(end, len(content)), end - 1) + 1


def main_text(page: str) -> str:
    """Main text of one page, blocks joined by a line break."""
    lines, content, links, marked = lines_of(page)
    lengths = np.array([len(x) if c else 0 for x, c in zip(lines, content)], dtype=np.int64)
    if not lengths.any():
        return ""
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))
    found = stretches(lengths, 0 if marked or sums.max() <= SURGE else SURGE)
    start, end = found[0][0], found[-1][1]
    if not marked:
        start, end = _neighbours(content, links, start, end)
    return "\n".join(lines[i] for i in range(start, end) if content[i])


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    A null page is empty; without main text ``text`` is empty and ``n_chars`` 0. Null ids
    and addresses stay null, repeated rows are extracted each, other columns are
    ignored, an empty table gives no rows. Whole pages are read, whatever their length.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
