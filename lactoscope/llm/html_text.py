"""Main text of web pages as a maximum-scoring subsequence.

A page is a row of tokens: words and tags. Each word scores by the element it stands
in, each tag by its name, and the contiguous stretch with the greatest sum is the main
content; one linear scan finds it. The weights are log odds learned from labelled
pages, those that mark their content by exactly one ``article`` or ``main`` element: how
much more often a word of such an element (or a tag) is seen inside the content than
outside. Words score positive as a prior and tags negative.

The stretch is then widened to the element that holds its blocks, and what the element
has of menus, notices, adverts, forms and comments is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages that weights are learned from; more do not change them much.
LABELLED_PAGES = 2000

# The elements of HTML by how they take part in a text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
LEFT_OUT = {
    "head", "title", "script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "object", "svg",
    "math", "canvas", "audio", "video", "map", "nav", "aside", "footer", "form", "button", "select", "option", "datalist",
    "fieldset", "input", "dialog", "menu", "xmp",
}
# Elements whose start ends an open p, and elements that end an open one of their own kind.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "section", "table", "ul",
}
ENDS_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "status"}
# Parts of class names and ids that mark what is not the article.
HINTS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adverts?|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    r"footer|header|masthead|topbar|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|"
    r"widget|toolbar|skip|hidden)(?=$|[^a-z])"
)
CONTENT = {"article", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))")


def _is_out(name: str, attributes: str, inside_content: bool) -> bool:
    """Whether an element is none of the article's text."""
    if name in LEFT_OUT or (name == "header" and not inside_content):
        return True
    if not attributes.strip() or name in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in ROLES_OUT or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?=$|[\s=/])", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) or "hidden" in found:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True
    marks = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().replace("_", "-")
    return bool(HINTS.search(marks))


class Page:
    """Tokens of a page: kind, text or tag name, path of open elements, whether left out."""

    def __init__(self, source: str | None):
        self.tokens: list[tuple[str, str, int, bool]] = []
        # Elements by number: name, number of the parent, whether left out.
        self.elements: list[tuple[str, int, bool]] = [("", -1, False)]
        # For each element, the nearest one that is not inline, and whether a link lies between.
        self.blocks: list[tuple[int, bool]] = [(0, False)]
        self.open: Counter[str] = Counter()
        stack, text = [0], source or ""
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            at = m.end()
            if m[2] is None:
                if m[0][0] != "<" or m[0] == "<":
                    self._add("word", m[0], stack)
                continue
            if not m[4]:
                break  # a tag that the end of the page cuts off
            name = m[2].lower()
            if m[1]:
                self._close(name, stack)
                continue
            self._imply_ends(name, stack)
            self._add("tag", name, stack)
            if name in VOID or m[3].endswith("/") and name not in INLINE | ENDS_P:
                continue
            inside = any(self.open[n] for n in CONTENT)
            out = self.elements[stack[-1]][2] or _is_out(name, m[3], inside)
            block, linked = self.blocks[stack[-1]]
            self.blocks.append((block, linked or name == "a") if name in INLINE else (len(self.elements), False))
            self.elements.append((name, stack[-1], out))
            stack.append(len(self.elements) - 1)
            self.open[name] += 1
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                self._add("word", text[at : end.start() if end else len(text)], stack)
                at = end.end() if end else len(text)
                self._leave(stack, len(stack) - 1)
        # Elements are numbered in page order, so those inside one follow it up to its last.
        self.last = list(range(len(self.elements)))
        for e in range(len(self.elements) - 1, 0, -1):
            parent = self.elements[e][1]
            self.last[parent] = max(self.last[parent], self.last[e])

    def _add(self, kind: str, value: str, stack: list[int]) -> None:
        self.tokens.append((kind, value, stack[-1], self.elements[stack[-1]][2]))

    def _leave(self, stack: list[int], at: int) -> None:
        for e in stack[at:]:
            self.open[self.elements[e][0]] -= 1
        del stack[at:]

    def _imply_ends(self, name: str, stack: list[int]) -> None:
        if name in ENDS_P and self.open["p"]:
            ended, bounds = "p", ENDS_P
        elif name in ENDS_OWN and self.open[name]:
            ended, bounds = name, ENDS_OWN[name]
        else:
            return
        for at in range(len(stack) - 1, 0, -1):
            open_name = self.elements[stack[at]][0]
            if open_name == ended:
                self._leave(stack, at)
                return
            if open_name in bounds:
                return

    def _close(self, name: str, stack: list[int]) -> None:
        self._add("end", name, stack)
        if not self.open[name]:
            return
        for at in range(len(stack) - 1, 0, -1):
            open_name = self.elements[stack[at]][0]
            if open_name == name:
                self._leave(stack, at)
                return
            if name in INLINE and open_name not in INLINE:
                return  # an inline end tag does not end a block

    def holds(self, outer: int, element: int) -> bool:
        return outer <= element <= self.last[outer]

    def around(self, first: int, last: int) -> list[int]:
        """The elements that hold both, innermost first."""
        found, element = [], first
        while element >= 0:
            if self.holds(element, last):
                found.append(element)
            element = self.elements[element][1]
        return found

    def feature(self, element: int, out: bool) -> str:
        """Where a word stands: a left-out place or its nearest element that is not inline."""
        block, linked = self.blocks[element]
        return f"{'out' if out else 'in'} {self.elements[block][0]}{' a' if linked else ''}"

    def label(self) -> int | None:
        """The one element that marks the content, if the page has just one."""
        marked = [i for i, (name, _, out) in enumerate(self.elements) if name == "article" and not out]
        marked = marked or [i for i, (name, _, out) in enumerate(self.elements) if name == "main" and not out]
        return marked[0] if len(marked) == 1 else None


def counted_features(pages: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, tuple[int, int]]:
    """How many words and tags of each feature the labelled pages have inside and outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for source in batch.column("html"):
                page = Page(source.as_py())
                content = page.label()
                if content is None:
                    continue
                for kind, value, element, out in page.tokens:
                    key = page.feature(element, out) if kind == "word" else f"{kind} {value}"
                    n = len(value.split()) if kind == "word" else 1
                    (inside if page.holds(content, element) else outside)[key] += n
            keys = sorted(inside | outside)
            columns = [pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "inside", "outside"])

    # The labelled pages of least content hash, each once, so every run learns from the same pages.
    marked = pages.select("html", F.xxhash64("html").alias("key")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    keys = [r.key for r in marked.select("key").distinct().orderBy("key").limit(limit).collect()]
    if not keys:
        return {}
    sample = marked.where(F.col("key") <= max(keys)).dropDuplicates(["key"]).select("html")
    counts = sample.mapInArrow(run, "feature string, inside long, outside long").groupBy("feature")
    found = counts.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return {r.feature: (r.inside, r.outside) for r in found.collect()}


def learn_weights(pages: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Log odds of being inside the content, for each feature, held between -4 and 4."""
    counts = counted_features(pages, limit)
    return {k: max(-4.0, min(4.0, math.log((i + 1) / (o + 1)))) for k, (i, o) in counts.items()}


def _score(page: Page, weights: dict[str, float]) -> list[float]:
    """Words score a half at least where their element speaks for them; tags never score above zero."""
    scores = []
    for kind, value, element, out in page.tokens:
        if kind == "word":
            n = len(value.split())
            weight = weights.get(page.feature(element, out), 1.0)
            scores.append(n * (min(-0.5, weight) if out else max(weight, -1.0)))
        else:
            scores.append(min(-0.1, 0.25 * weights.get(f"{kind} {value}", -1.0) - 0.1))
    return scores


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous stretch with the greatest sum; (0, -1) for none."""
    best, found, total, first = 0.0, (0, -1), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, found = total, (first, i)
    return found


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The article's text; empty for a null or empty page and for one without words."""
    page = Page(source)
    first, last = best_stretch(_score(page, weights))
    if last < first:
        return ""
    held = [t[2] for t in page.tokens[first : last + 1] if t[0] == "word" and not t[3] and t[1].strip()]
    if not held:
        return ""
    # The element that holds the stretch: an article or main around it, else the next that is no text block.
    around = page.around(min(held), max(held))
    marked = [e for e in around if page.elements[e][0] in CONTENT]
    holder = marked[0] if marked else next((e for e in around if page.elements[e][0] in ("div", "section", "body", "html", "td", "")), 0)
    pieces: list[str] = []
    for kind, value, element, out in page.tokens:
        if not page.holds(holder, element):
            continue
        if kind == "word":
            if not out:
                pieces.append(html.unescape(value))
        elif value not in INLINE:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def extract(pages: DataFrame, labelled: int = LABELLED_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    ``text`` is the main text of the whole ``html``: character references decoded, white
    space turned to single spaces, blocks in page order. A page that is null, empty or
    has no such text gives an empty one. Repeated rows are extracted like others.
    """
    weights = learn_weights(pages, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.as_py(), weights) for source in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
