"""Main text of web pages: parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without an end, elements that stand as blocks, elements whose text is no page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video map datalist".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select textarea input fieldset label".split())
# Words in class or id that mark page furniture, adverts, notices and reader comments; words of an
# article, whose header is no furniture; words that deny or only mention what follows.
MARKED = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice outbrain pager pagination popup promo promoted promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "taboola toolbar widget".split()
)
OF_ARTICLE = frozenset("article body content entry main post story text".split())
DENIED = frozenset("no not without has with hide disable".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = frozenset(("article", "main"))
SELF_CLOSED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def marked(value: str) -> bool:
    """Whether a class or id names furniture: word by word, so that no-sidebar and article-header do not."""
    for token in value.lower().split():
        words = re.findall("[a-z]+", token)
        if words and words[0] not in DENIED:
            if any(w in MARKED and not (w == "header" and not OF_ARTICLE.isdisjoint(words)) for w in words):
                return True
    return False


class _Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, number of the innermost element). Elements are numbered as they
    begin; parent, kind, mark and heading of each are kept, so that a line costs the same at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # tag, hidden, number
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = 0
        self.parent, self.kinds, self.marks = [0], [""], [False]

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1][2] if self.stack else 0))
        if text or self.tags > 50:
            self.tags = 0
        self.text = []

    def pop_to(self, tag: str) -> None:
        while self.stack:
            top = self.stack.pop()[0]
            self.open[top] -= 1
            if top == tag:
                return

    def close_inner(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        """Ends an open element of `tags` unless one of `walls` stands between."""
        if any(self.open[t] for t in tags):
            for top, *_ in reversed(self.stack):
                if top in tags:
                    self.pop_to(top)
                    return
                if top in walls:
                    return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.open["head"] and (tag == "body" or tag in BLOCK) and not any(self.open[t] for t in HIDDEN - {"head"}):
            self.pop_to("head")  # its end tag may be left out
        if tag in ("td", "th", "br"):
            self.text.append(" ")
        if tag in BLOCK:
            self.flush()
            if self.open["p"]:
                self.close_inner(("p",), ("table", "button", "object"))
        if tag in SELF_CLOSED:
            self.close_inner(SELF_CLOSED[tag], ("ul", "ol", "dl", "table", "select"))
        if tag in VOID:
            return
        hidden = bool(self.stack) and self.stack[-1][1]
        mark = False
        if not hidden and tag not in ("html", "body"):
            a = {k: v or "" for k, v in attrs}
            within = any(self.open[t] for t in MAIN)
            mark = tag in FURNITURE or (tag == "header" and not within) or a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or "hidden" in a
            if tag not in MAIN or within:
                mark = mark or marked(a.get("class", "")) or marked(a.get("id", ""))
        self.parent.append(self.stack[-1][2] if self.stack else 0)
        self.kinds.append("main" if tag in MAIN or dict(attrs).get("role") == "main" else tag)
        self.marks.append(mark)
        self.stack.append((tag, hidden or tag in HIDDEN, len(self.kinds) - 1))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or tag in ("td", "th"):
            self.text.append(" ")
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.text.append(data)


def smooth(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing with a kernel of 2 * radius + 1 lines, weights renewed at the ends."""
    kernel = [math.exp(-(i * i) / (2 * (radius / 2 + 0.5) ** 2)) for i in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(values[j], kernel[j - i + radius]) for j in range(max(0, i - radius), min(len(values), i + radius + 1))]
        out.append(sum(v * k for v, k in pairs) / sum(k for _, k in pairs))
    return out


def _clusters(ratio: list[float]) -> list[bool]:
    """Which lines reach half a standard deviation of the smoothed ratios."""
    soft = smooth(ratio)
    mean = sum(soft) / len(soft)
    least = 0.5 * math.sqrt(sum((x - mean) ** 2 for x in soft) / len(soft))
    return [x >= least for x in soft]


def _below(page: _Lines, values: list[float]) -> list[float]:
    """Sums of the values of each element and all within it."""
    out = list(values)
    for n in range(len(out) - 1, 0, -1):
        out[page.parent[n]] += out[n]
    return out


def _dull(page: _Lines) -> list[bool]:
    """Of each element, whether it is furniture. A mark is a vote; density overrules it where the marked element holds
    an article or a first heading with most of the page's dense text, or where nothing dense is left outside marks."""
    lines, count = page.lines, len(page.kinds)
    dense = _clusters([len(text) / max(1, tags) for text, tags, _ in lines])
    own = [0.0] * count
    for (text, _, n), d in zip(lines, dense, strict=True):
        own[n] += len(text) * d
    weight = _below(page, own)
    kept = _below(page, [float(k in ("main", "h1")) for k in page.kinds])

    def spread(marks: list[bool]) -> list[bool]:
        out = [False] * count
        for n in range(1, count):
            out[n] = marks[n] or out[page.parent[n]]
        return out

    marks = [m and not (kept[n] > 0 and 2 * weight[n] >= weight[0] > 0) for n, m in enumerate(page.marks)]
    dull = spread(marks)
    while weight[0] and not any(d and not dull[n] for (_, _, n), d in zip(lines, dense, strict=True)):
        # all that is dense is marked: the outermost mark that holds most of it gives way
        outer = [n for n in range(1, count) if marks[n] and not dull[page.parent[n]]]
        top = max(outer, key=lambda n: (weight[n], -n))
        if 2 * weight[top] < weight[0] or page.kinds[top] in ("nav", "footer", "aside", "menu", "dialog", "button", "select"):
            break
        marks[top] = False
        dull = spread(marks)
    return dull


def main_text(html: str | None) -> str:
    """The article of a page, block by block.

    The lines' text-to-tag ratios (0 for furniture) are smoothed; lines at or over half a standard deviation form the
    content clusters. The region is the article or main element with most clustered text, else the smallest element
    that holds nine tenths of it. In an article every block stays that is no furniture, however short; without one,
    the blocks from the first clustered line to the last, with headings right before."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    dull = _dull(page)
    plain = [i for i, (_, _, n) in enumerate(lines) if not dull[n]]
    if not plain:
        return ""
    cluster = _clusters([0.0 if dull[n] else len(text) / max(1, tags) for text, tags, n in lines])
    dense = [i for i in plain if cluster[i]] or plain
    own = [0.0] * len(page.kinds)
    for i in dense:
        own[lines[i][2]] += len(lines[i][0])
    weight = _below(page, own)
    mains = [n for n, kind in enumerate(page.kinds) if kind == "main" and weight[n] > 0]
    if mains:
        region = max(mains, key=lambda n: (weight[n], -n))
    else:
        region = max((n for n, kind in enumerate(page.kinds) if weight[n] * 10 >= weight[0] * 9 and kind not in ("p", "li", "tr", "pre", "blockquote", *HEADINGS)), default=0)
    inside = [n == region for n in range(len(page.kinds))]
    for n in range(1, len(inside)):
        inside[n] = inside[n] or inside[page.parent[n]]
    stay = [i for i in plain if inside[lines[i][2]]]
    if not mains:
        first, last = dense[0], dense[-1]
        while first > 0 and page.kinds[lines[first - 1][2]] in HEADINGS:
            first -= 1
        stay = [i for i in stay if first <= i <= last]
    return "\n\n".join(lines[i][0] for i in stay)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row; n_chars counts code points.

    Null and empty html give an empty text. Rows are kept as they are, repeated and null ids included; other
    columns are left out. Each page is parsed alone, so one long page costs one task its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = src.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
