"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events (no tree is built); a *line* is the text between two block boundaries, with
its counts of tags and of link characters and the number of the container that it stands in.  Lines under boilerplate
(navigation, forms, scripts, notices, comments, by element, role, class or id) are marked and have ratio 0.  The ratios are
smoothed with a Gaussian kernel; lines above 0 and the threshold (the standard deviation, or the mean if that is less) form
the clusters, and those of their lines that reach the threshold unsmoothed choose the content region: from the page
downward, the container that holds all of their text and two unmarked lines or more, an article or main element that holds half of it, or the only article in a main element.

In a region below the page's body every unmarked line is content, however short.  Where the clusters are spread over the
body itself, it is every unmarked line from the first cluster to the last, and a heading before.  Inside an article or main
element a class or id marks only blocks that say they are adverts, notices, comments or the like, never a paragraph,
heading or list item.

Each page is one row of one map task; there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, utf8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Where the search for an inline or list element to close ends.
SCOPE = frozenset("html body article main section div nav header footer aside form table td th ul ol dl blockquote".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe svg canvas object menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist respond replies disqus share "
    "sharing social related recommended recommendations widget pagination pager login search".split()
)
HEADS = frozenset("header topheader siteheader pageheader".split())
#: What still marks a block inside an article or main element.
OWN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup "
    "sidebar breadcrumb breadcrumbs comments commentlist respond disqus related recommended recommendations pagination".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption span a b i em strong small u mark".split())
#: Elements that a region can be.
CONTAINERS = frozenset("html body article main section div center table tbody tr td".split())
_tokens = re.compile(r"[a-z0-9]+").findall
#: A tag that the end of the page cuts off: a name and whole or half attributes.
_open_end = re.compile(r"""<[a-zA-Z/!?][^\s<>"'=]*(\s+[^\s<>"'=]+\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*(\s+[^\s<>"'=]*(\s*=\s*("[^"<>]*|'[^'<>]*|[^\s"'<>]*))?)?\Z""")
_bare = re.compile(r"<(?=[a-zA-Z][^<>]*\Z)")


class Lines(HTMLParser):
    """Collects lines: text, tags, link characters, boilerplate or not, heading or not, number of the container (0: the page).

    ``above`` has the container around each container, ``named`` those that are article or main elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []
        self.stack: list[tuple[str, bool, int, bool, int]] = []  # tag, dropped, in an article or main, in a link, container
        self.text: list[str] = []
        self.tags = self.links = 0
        self.above, self.named, self.body = [0], {0: False}, {0}
        self.head = False

    def state(self) -> tuple[str, bool, int, bool, int]:
        return self.stack[-1] if self.stack else ("", False, 0, False, 0)

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, dropped, _, _, container = self.state()
            self.lines.append((text, self.tags, self.links, dropped, self.head, container))
            self.tags = 0
        self.text, self.links, self.head = [], 0, False

    def drops(self, tag: str, attrs: list[tuple[str, str | None]], root: int) -> bool:
        if tag in DROP or tag == "header" and not root:
            return True
        if not attrs or tag in ("html", "body"):
            return False
        found = dict(attrs)
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES or re.search(r"display\s*:\s*none", found.get("style") or ""):
            return True
        names = {*_tokens((found.get("class") or "").lower()), *_tokens((found.get("id") or "").lower())}
        if root:
            return tag not in PLAIN and bool(names & OWN_NAMES)
        return bool(names & (NAMES | HEADS))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
            self.close_to("p", also=BLOCK) if tag != "p" else self.close_to("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.close_to(tag)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, dropped, root, link, container = self.state()
        dropped = dropped or self.drops(tag, attrs, root)
        main = tag in ("article", "main") or dict(attrs).get("role") == "main"
        if tag in CONTAINERS and not dropped:
            self.above.append(container)
            container = len(self.above) - 1
            self.named[container] = main
            if tag in ("html", "body"):
                self.body.add(container)
        self.stack.append((tag, dropped, root or (main and not dropped), link or tag == "a", container))
        self.head = self.head or tag in HEADING

    def close_to(self, tag: str, also: frozenset = frozenset()) -> bool:
        """Close the nearest open ``tag`` with all that is open in it, unless a scope lies between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return True
            if self.stack[k][0] in SCOPE:
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        if tag in SCOPE:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    return
        elif tag not in VOID:
            self.close_to(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        tag, dropped, _, link, _ = self.state()
        if dropped and tag in ("script", "style", "template"):
            return
        if link:
            self.links += len(data)
        if dropped and self.text == [] and not data.strip():
            return
        self.text.append(data)

    def close(self) -> None:
        super().close()
        self.cut()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """With a normalised kernel cut at three sigma; ends are padded with their own value."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def clusters(lines: list[tuple], free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are in clusters, and which of them reach the threshold by themselves (if none does, all of them)."""
    ratios = np.array([max(0, len(x[0]) - x[2]) / max(1, x[1]) if ok else 0.0 for x, ok in zip(lines, free, strict=True)])
    smooth = smoothed(ratios)
    least = min(smooth.std(), smooth.mean())
    chosen = free & (smooth > 0) & (smooth >= least)
    cores = chosen & (ratios >= least)
    return chosen, cores if cores.any() else chosen


def region(parser: Lines, chosen: np.ndarray) -> tuple[int, np.ndarray]:
    """The container that the clusters choose, and which containers lie in it (itself included)."""
    n = len(parser.above)
    text, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for x, ok in zip(parser.lines, chosen, strict=True):
        text[x[5]] += len(x[0]) * int(ok)
        count[x[5]] += not x[3]
    for k in range(n - 1, 0, -1):  # a container is numbered after the one around it
        text[parser.above[k]] += text[k]
        count[parser.above[k]] += count[k]
    within: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        within[parser.above[k]].append(k)
    best = 0
    while True:
        inner = max(within[best], key=lambda k: text[k], default=0)
        whole = text[inner] == text[0] and count[inner] > 1
        half = 2 * text[inner] >= text[0] and any_named(parser, within, inner, text)
        sole = parser.named[best] and parser.named[inner] and text[inner] == sum(text[k] for k in within[best] if parser.named[k])
        if not (inner and text[inner] and (whole or half or sole)):
            break
        best = inner
    inside = np.zeros(n, dtype=bool)
    inside[best] = True
    for k in range(best + 1, n):
        inside[k] = inside[parser.above[k]] and k != best
    return best, inside


def any_named(parser: Lines, within: list[list[int]], k: int, text: np.ndarray) -> bool:
    """Whether ``k`` is an article or main element with half of the clusters' text, or leads down to one."""
    while k and 2 * text[k] >= text[0]:
        if parser.named[k]:
            return True
        k = max(within[k], key=lambda x: text[x], default=0)
    return False


def main_text(html: str) -> str:
    """The main text of one page; empty if none.  Never fails: what the parser can't read is text or nothing."""
    parser = Lines()
    parser.feed(_bare.sub("&lt;", _open_end.sub("", html)))
    parser.close()
    lines = parser.lines
    free = np.array([not x[3] for x in lines], dtype=bool)
    if not free.any():
        return ""
    chosen, cores = clusters(lines, free)
    at = np.flatnonzero(chosen)
    if not len(at):
        return ""
    best, inside = region(parser, cores)
    keep = free & inside[[x[5] for x in lines]]
    if best in parser.body:
        first = at[0] - 1 if at[0] and lines[at[0] - 1][4] else at[0]
        keep[:first] = keep[at[-1] + 1 :] = False
    return "\n".join(x[0] for x, ok in zip(lines, keep, strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id, url, text`` for every row.  Null and empty pages have an empty text; null ids and urls stay null;
    repeated rows are extracted each; an empty table gives no row; pages of any length are read whole."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(h.decode("utf-8", "replace")) for h in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    return map_batches(given, run, "page_id long, url string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
