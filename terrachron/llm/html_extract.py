"""Main text of pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are never article text.
DROPPED = frozenset(
    "script style noscript template title nav aside footer form menu dialog button select option textarea input "
    "iframe object embed svg math canvas audio video map".split()
)
#: Words of class, id and role that mark the same, and those that do so only outside an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion "
    "banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars complementary footer contentinfo "
    "notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended recommendations comment comments respond replies disqus "
    "widget widgets toolbar pagination pager form".split()
)
HEADS = frozenset("header masthead topbar".split())
ARTICLES = frozenset(("article", "main"))
#: Elements around a whole page, whose classes describe the page and not a part of it.
ROOTS = frozenset(("html", "body", "main"))
#: Blocks that may hold the paragraphs of an article; other blocks are a part of its text.
HOLDERS = frozenset("center details dialog div fieldset".split())
#: Words that add nothing to a mark beside them in one name.
PLAIN = frozenset(
    "area article articles bar block bottom box btn button buttons cell center col column container content element "
    "end group header holder icon icons inline inner item items js label large latest layout left legal level link links "
    "list lower main message messages mini mobile more news outer page panel parent pane post posts primary privacy "
    "reader readers right row secondary section site slot small space start stories sub text thread title to top unit "
    "upper user view wide wrap wrapper zone".split()
)
#: Why text is dropped: inside a form, which may also be put around a whole page, or for good. A name
#: that holds a marking word among others leaves it to the ratios.
IN_FORM, FOR_GOOD, UNSURE = 1, 2, 3
#: Start tags before which an open paragraph or item ends by itself.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_WORD = re.compile(r"[^0-9a-z]+")
_CUT = re.compile(r"<[a-zA-Z/!?]")
#: Standard deviation, in lines, of the Gaussian that smooths the ratios.
SIGMA = 1.0
#: Doubtful lines go below this share of the border: where all lines are text, the border parts
#: paragraphs from slightly shorter ones.
DOUBT = 0.5
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


class Line(NamedTuple):
    """A block's text, the tags before it, and where it stands."""

    text: str
    tags: int
    region: tuple[bool, int] | None  # None inside boilerplate
    holder: int
    unsure: int  # number of the element around it whose name tells little, or 0
    linked: bool  # all of its words are in links


class State(NamedTuple):
    """What the open elements say of the text in them."""

    dropped: int = 0
    article: int = 0
    holder: int = 0
    unsure: int = 0
    linked: bool = False


class Events(HTMLParser):
    """Turns parser events into lines. Text keeps the state it was met in, so a block may hold dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, State]] = []
        self.around = [0]  # of each holder, the one around it; 0 is the page
        self.counts: dict[str, int] = {}  # of names in open
        self.text: list[str] = []
        self.lost: list[str] = []  # dropped text of the same block
        self.at: State | None = None  # of the block's last kept words
        self.linked = True  # all words so far are in links
        self.tags = self.articles = self.run = self.unsure = 0

    def _state(self) -> State:
        return self.open[-1][1] if self.open else State()

    def flush(self) -> None:
        text, lost = (" ".join("".join(x).split()) for x in (self.text, self.lost))
        self.text.clear()
        self.lost.clear()
        if lost:
            if not text:
                self.run += 1
            self.lines.append(Line(lost, self.tags, None, self._state().holder, 0, False))
            self.tags = 0
        if text:
            at = self.at
            region = at.article > 0, at.article if at.article else self.run
            self.lines.append(Line(text, self.tags, region, at.holder, at.unsure, self.linked))
            self.tags = 0
        self.at, self.linked = None, True

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in BLOCKS:
            ends = SELF_CLOSING.get(tag)
            if self.open and (self.open[-1][0] == "p" or ends and self.open[-1][0] in ends):
                self._cut(len(self.open) - 1)
        dropped, article, holder, unsure, linked = self._state()
        if dropped == IN_FORM and tag in ARTICLES:
            dropped = 0
        if dropped != FOR_GOOD:
            if tag == "form":
                dropped = IN_FORM
            elif tag in DROPPED or (tag == "header" and not article):
                dropped = FOR_GOOD
            elif tag not in ROOTS:
                told = self._marked(attrs, article)
                if told == FOR_GOOD:
                    dropped = FOR_GOOD
                elif told and not unsure:
                    self.unsure += 1
                    unsure = self.unsure
        if tag in ARTICLES and not dropped and not article:
            self.articles += 1
            article = self.articles
        if tag in HOLDERS:
            self.around.append(holder)
            holder = len(self.around) - 1
        self.open.append((tag, State(dropped, article, holder, unsure, linked or tag == "a")))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _cut(self, i: int) -> None:
        for name, *_ in self.open[i:]:
            self.counts[name] -= 1
        del self.open[i:]

    @staticmethod
    def _marked(attrs, article: int) -> int:
        """``FOR_GOOD`` if a name says what the contract drops, ``UNSURE`` if it only holds such a word."""
        found = 0
        for name, value in attrs:
            if name == "hidden":
                return FOR_GOOD
            if value and name in ("class", "id", "role"):
                for one in value.lower().split():
                    words = {w for w in _WORD.split(one) if w and not w.isdigit()}
                    telling = words & MARKS if article else words & MARKS | words & HEADS
                    if telling and words <= telling | PLAIN:
                        return FOR_GOOD
                    if telling:
                        found = UNSURE
        return found

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.counts.get(tag):
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self._cut(i)

    def handle_data(self, data):
        state = self._state()
        if state.dropped:
            self.lost.append(data)
            return
        self.text.append(data)
        if not data.isspace():
            self.at = state
            self.linked = self.linked and state.linked


def joined(events: Events) -> dict:
    """The region that each run of lines belongs to, where there is no article.

    Runs with lines in the same holder are one region. A line's holder is the nearest one around it
    that has more lines than this one, so a paragraph with a holder of its own counts with the next.
    """
    kept = [(line.region, line.holder) for line in events.lines if line.region]
    lines = [0] * len(events.around)
    for _, holder in kept:
        lines[holder] += 1
    for i in range(len(lines) - 1, 0, -1):  # holders come after the ones around them
        lines[events.around[i]] += lines[i]
    of = list(range(len(lines)))
    for i in range(1, len(lines)):
        if lines[i] < 2:
            of[i] = of[events.around[i]]
    root = {region: region for region, _ in kept}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict = {}
    for region, holder in kept:
        root[find(region)] = find(first.setdefault(of[holder], region))
    return {region: find(region) for region in root}


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios after a Gaussian over neighbouring lines; the ends repeat."""
    return np.convolve(np.pad(ratios, 3, mode="edge"), _KERNEL, mode="valid")


def threshold(ratios: np.ndarray) -> float:
    """The border between the two clusters of smoothed ratios (two means in one dimension)."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(20):
        border = (low + high) / 2
        above = ratios >= border
        if above.all() or not above.any():
            break
        new = float(ratios[~above].mean()), float(ratios[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def doubtful(lines: list[Line]) -> list[list[int]]:
    """Groups of kept lines that their ratios must decide on.

    A group is what stands in one element with a name that tells little, or a run of two or more
    lines one after the other whose words are all in links.
    """
    named: dict[int, list[int]] = {}
    runs: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if line.region and line.unsure:
            named.setdefault(line.unsure, []).append(i)
        elif line.region and line.linked:
            if runs[-1] and runs[-1][-1] != i - 1:
                runs.append([])
            runs[-1].append(i)
    return [*named.values(), *(run for run in runs if len(run) > 1)]


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in page order, joined by ``\\n``.

    Each block is a line with its characters per tag. Smoothed ratios are clustered by a threshold;
    a region (an article element, or where there is none the runs of lines between boilerplate that
    have a container in common, so that an advert does not part an article) is content when one of
    its lines lies above the border. If no region has such a line, the one with the largest ratio is
    the content. A content region keeps its headings and short paragraphs, which have low ratios of
    their own, but its doubtful groups (``doubtful``) stay only if one of their lines reaches
    ``DOUBT`` of the border: a line with words outside links by its smoothed ratio, a line of links by its own, since
    long paragraphs beside a menu say nothing of the menu. Where only doubtful lines are left, they
    are the content.
    """
    if not html:
        return ""
    events = Events()
    events.feed(html)
    if _CUT.match(events.rawdata):  # a tag or comment that the end of the page cuts off
        events.rawdata = ""
    events.close()
    events.flush()
    lines = events.lines
    regions = {line.region: line.region for line in lines if line.region}
    if any(inside for inside, _ in regions):
        regions = {r: r for r in regions if r[0]}
    else:
        regions = joined(events)
    if not regions:
        return ""
    own = np.array([len(line.text) / max(1, line.tags) for line in lines])
    ratios = smoothed(own)
    border = threshold(ratios)
    best: dict = {}
    for line, ratio in zip(lines, ratios):
        if line.region in regions:
            region = regions[line.region]
            best[region] = max(best.get(region, 0.0), ratio)
    chosen = {r for r, ratio in best.items() if ratio >= border} or {max(best, key=best.get)}
    kept = [i for i, line in enumerate(lines) if regions.get(line.region) in chosen]
    low = {
        i
        for group in doubtful(lines)
        if all((own if lines[i].linked else ratios)[i] < DOUBT * border for i in group)
        for i in group
    }
    return "\n".join(lines[i].text for i in [i for i in kept if i not in low] or kept)


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from the whole html; a scan without a shuffle.

    Defined cases: null, empty or text-free html gives the empty text; a page without any markup is
    one block; elements that are not closed end with their parent; tags cut off by the end of the
    page are ignored; ids and urls may be null or repeated; other columns are not read.
    """
    rows = ship(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op2_html_extract(spark, sf_dir):
    """Main text of every page of the whole pages table."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
