"""Main text of HTML pages from streamed parser events and text density.

``html.parser`` streams a page's events; they are folded into lines, one per block element,
each with its text, the number of tags met in it and the region (nearest article, main,
section or division) it stands in. Content is where text outweighs markup: the text-to-tag
ratio of the lines is smoothed with a Gaussian along the page, lines are clustered into high
and low by a threshold between the two groups' means, and the regions that hold the high
lines are the content, however long they or others are; where the groups lie near each other
all regions are. An article or main element adds weight to its lines and decides nothing. Lines in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments never count, by element and by class, id or role.
Within a content region every line is kept, short ones too.

Character references are decoded; white space within a line becomes one space; lines are
trimmed, empty ones left out, and joined in page order by a newline.

Defined cases: null and empty html give the empty text; unclosed, misnested and cut-off
markup is read as browsers do, and a comment or tag that never ends is no text; repeated rows get a row each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.functions.markup import TolerantParser
from termloom.llm.common import short

SIGMA = 1.5
#: In logarithms of characters a tag: what an article or main element adds, and how far apart text and markup are.
STRONG_WEIGHT, LEAST_GAP = 1.0, 2.0

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form button select textarea label input menu dialog".split())
REGIONS = frozenset("article main section div body td".split())
STRONG_REGIONS = frozenset("article main".split())
#: Names in class, id and role that mark what isn't the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer colophon cookie cookies "
    "consent gdpr notice notices popup modal overlay comment comments commentlist respond replies reply disqus discussion share "
    "sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets toolbar "
    "pagination pager copyright complementary contentinfo search alert teaser teasers outbrain taboola skip".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _is_marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in BOILERPLATE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            if not MARKED.isdisjoint(_SPLIT.split((value or "").lower())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and _HIDDEN.search((value or "").lower()):
            return True
    return False


class LineReader(TolerantParser):
    """Folds parser events into lines: [text, tags, region, strong]."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool]] = []  # tag, whether it opened something dropped
        self.named: Counter[str] = Counter()  # open elements by tag
        self.blocks: list[int] = []  # where in ``open`` the block elements are
        self.dropped = self.silent = 0
        self.regions: list[tuple[int, bool]] = [(0, False)]
        self.count = 0
        self.text: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            if line:
                self.lines.append((line, self.tags, *self.regions[-1]))
            self.text.clear()
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_text(" ")
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.blocks and self.open[self.blocks[-1]][0] == tag:
            # a paragraph or item that opens ends the one before it in the same parent
            self._close(tag)
        if tag in STRONG_REGIONS and self.dropped:
            # an article does not stand in an advert or menu: that one was left open
            while self.dropped and not self.silent:
                self._pop()
        dropped = tag in SILENT or _is_marked(tag, attrs)
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, dropped))
        self.named[tag] += 1
        self.dropped += dropped
        self.silent += tag in SILENT
        if tag in REGIONS:
            region, strong = self.regions[-1]
            self.count += 1
            # cells of an article's table are the article's own; elsewhere a cell may lay out the page
            self.regions.append((region if tag == "td" and strong else self.count, strong or tag in STRONG_REGIONS))

    def _pop(self) -> str:
        tag, dropped = self.open.pop()
        self.named[tag] -= 1
        self.dropped -= dropped
        self.silent -= tag in SILENT
        if tag in BLOCKS:
            self.blocks.pop()
        if tag in REGIONS:
            self.regions.pop()
        return tag

    def _close(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.named[tag]:
            self._close(tag)

    def handle_text(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; edges weigh what there is."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weights


def threshold(values: np.ndarray) -> float:
    """The point midway between the means of two clusters, found by repeated assignment;
    the least value where the clusters are too near each other to be two kinds."""
    cut = float(values.min() + values.max()) / 2
    for _ in range(20):
        high, low = values[values >= cut], values[values < cut]
        if not len(high) or not len(low):
            break
        moved = float(high.mean() + low.mean()) / 2
        if abs(moved - cut) < 1e-9:
            break
        cut = moved
    if not len(high) or not len(low) or high.mean() - low.mean() < LEAST_GAP:
        return float(values.min())
    return cut


def main_lines(html: str | None) -> list[str]:
    reader = LineReader()
    reader.read(html or "")
    reader.end_line()
    lines = reader.lines
    if not lines:
        return []
    # the ratio of a line, in logarithms, so that one long paragraph does not hide the others
    density = smoothed(np.log1p(np.array([len(t) / max(1, tags) for t, tags, *_ in lines])))
    density += STRONG_WEIGHT * np.array([strong for *_, strong in lines])
    peak: dict[int, float] = {}
    for (_, _, region, _), d in zip(lines, density.tolist(), strict=True):
        peak[region] = max(peak.get(region, d), d)
    cut = threshold(np.array(list(peak.values())))
    kept = {r for r, d in peak.items() if d >= cut}
    return [t for t, _, r, _ in lines if r in kept]


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            texts = ["\n".join(main_lines(h)) for h in batch.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    shape = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, shape)
