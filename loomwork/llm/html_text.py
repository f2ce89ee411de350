"""Main text of web pages by smoothed text-to-tag ratios.

Events of the standard library's parser stream into lines: runs of text
between block boundaries.  Each line has its text-to-tag ratio, weighed by
features: text in links does not count, elements that are boilerplate by tag,
role, class or id keep ``FAINT`` of it, and an article or main element has
``STRONG`` times it.  The ratios of a page are smoothed with a Gaussian (over
lines that are alike in being boilerplate or mostly links), and a threshold of ``LAMBDA``
standard deviations makes two clusters.  Regions are the innermost sections,
divisions, cells and boilerplate elements; an article or main element is one
region with all that is in it but boilerplate, so that neither its short
paragraphs nor its tables are judged alone.  A region is content if the mean
smoothed ratio of its text reaches the threshold, and is then kept whole.  If
none reaches it, the region of the greatest mean is kept.

Defined results: null or empty html gives the empty string; broken markup is
read as far as the parser goes; of regions with equal content (ties) the first
is the best; very long pages are read whole; null ids and urls are passed
through; repeated rows give equal texts; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents

LAMBDA, SIGMA = 0.5, 1.0
FAINT, STRONG = 0.002, 1.5
#: Elements without readable text, and those that are boilerplate by their tag.
MUTE = frozenset("script style noscript template svg math iframe object select option button textarea canvas audio video head title label datalist".split())
BOILERPLATE = frozenset("nav aside footer header form dialog menu".split())
#: Elements that end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are a region of their own, as are those that are marked.
REGIONS = BOILERPLATE | frozenset("article main section div td th body center fieldset".split())
#: Elements that are tracked as open; void ones and other inline ones are not.
OPEN = MUTE | REGIONS | frozenset("html ul ol dl table figure blockquote details span li p a".split())
#: Names in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation topnav breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social comment "
    "comments commentlist disqus respond reply replies related recommended popup modal overlay widget pagination pager search toolbar complementary contentinfo".split()
)
#: Words that only say what shape an element has.
LAYOUT = frozenset("area bar block body box button buttons column container content form group holder icons inner item items left link links list panel right row section slot top bottom unit wrap wrapper".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAME = re.compile(r"[A-Za-z]+")


def _is_mark(name: str) -> bool:
    """A mark by itself, at the end of a compound name (site-footer), or before a word of layout (ad-box); a share-price is none."""
    parts = _NAME.findall(name)
    if not parts or parts[0] in ("has", "with", "no", "without"):
        return False
    return "".join(parts) in MARKS or parts[-1] in MARKS or (parts[0] in MARKS and LAYOUT.issuperset(parts[1:]))


def _marked(attrs: list) -> bool:
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            if any(map(_is_mark, value.lower().split())):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


@dataclass
class Line:
    """A run of text: the tags before it, its characters in links, its weight and its region."""

    text: str
    tags: int
    linked: int
    weight: float
    region: int

    @property
    def ratio(self) -> float:
        return self.weight * max(0, len(self.text) - self.linked) / max(1, self.tags)


class Lines(HTMLParser):
    """The lines of one page, each with its region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions = 1
        #: Open elements: tag and what held outside: mute, boilerplate, own (article or main), link, region.
        self.stack: list[tuple] = []
        self.mute = self.bad = self.own = self.link = False
        self.region = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), FAINT if self.bad else STRONG if self.own else 1.0, self.region))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
            if self.stack and self.stack[-1][0] == "p":
                self.pop()
        self.tags += 1
        if tag not in OPEN or tag in _VOID:
            return
        if tag in ("article", "main"):  # page furniture that was left open ends here
            while self.stack and self.stack[-1][0] in ("nav", "header", "footer", "ul", "ol", "li", "head", "title"):
                if not any(t in ("nav", "header", "footer", "head") for t, *_ in self.stack):
                    break
                self.pop()
        elif tag == "body":
            while self.stack and self.stack[-1][0] in ("head", "title"):
                self.pop()
        self.stack.append((tag, self.mute, self.bad, self.own, self.link, self.region))
        own_header, within = tag == "header" and self.own, self.own
        marked = tag not in ("html", "body") and not own_header and bool(attrs) and _marked(attrs)
        self.bad = self.bad or marked or (tag in BOILERPLATE and not own_header)
        self.mute = self.mute or tag in MUTE
        self.own = self.own or tag in ("article", "main")
        self.link = self.link or tag == "a"
        if marked or tag in BOILERPLATE - ({"header"} if own_header else set()) or (tag in REGIONS and not within):
            self.region, self.regions = self.regions, self.regions + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in OPEN and tag not in _VOID:
            self.handle_endtag(tag)

    def pop(self) -> str:
        tag, self.mute, self.bad, self.own, self.link, self.region = self.stack.pop()
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in OPEN and any(t == tag for t, *_ in self.stack):
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def read(self, html: str) -> list[Line]:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # the parser gives up on some broken declarations
            pass
        self.end_line()
        return self.lines


def smoothed(ratios: list[float], alike: list, sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over the lines that are ``alike``; past the ends the weights of what is there count."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i, own in enumerate(alike):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        near = [(kernel[k - i + reach], ratios[k]) for k in range(low, high) if alike[k] == own]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def chosen_regions(lines: list[Line]) -> set[int]:
    """The regions in the content cluster: the mean smoothed ratio of their text reaches the threshold."""
    level = smoothed([x.ratio for x in lines], [x.weight == FAINT or 2 * x.linked >= len(x.text) for x in lines])
    mean = sum(level) / len(level)
    threshold = LAMBDA * math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    size: dict[int, int] = {}
    total: dict[int, float] = {}
    for x, height in zip(lines, level, strict=True):
        size[x.region] = size.get(x.region, 0) + len(x.text)
        total[x.region] = total.get(x.region, 0.0) + height * len(x.text)
    means = {r: total[r] / size[r] for r in size}
    found = {r for r, m in means.items() if m > 0 and m >= threshold}
    return found or {max(means, key=means.get)}


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in order, joined by one space."""
    page = Lines()
    lines = page.read(html) if html else []
    if not lines:
        return ""
    chosen = chosen_regions(lines)
    return " ".join(x.text for x in lines if x.region in chosen)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                text = pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["page_id", "url", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
