"""Main text of web pages by minimum cut.

A page is read to blocks: text between the tags of block elements, with references decoded and white space squeezed. Each
block has a log-odds of being content, from what the elements around it say (`article`, `nav`, names in class, id and
role) and from its form (length, share of links, how it ends), by a classifier. The log-odds are its capacity to the
source or to the sink; blocks that follow each other, and blocks of one parent element, are joined by smoothness edges. A maximum
flow separates content from the rest at the least total cost; content blocks are joined in page order.

The weights of forms are fitted here: blocks that elements mark are the examples, and blocks are counted by the cell of their
form, of which there are a few hundred however many pages there are; about SAMPLE pages are counted, chosen by a hash. Where
none is marked, the weights stay at `PRIOR`, to which the fit is drawn as well. Elements' weights are fixed.

Pages are read where they lie: no shuffle, no state between pages, memory of one page; a page is always read whole.

Defined cases: null or empty html has an empty text; html without tags is one block; a tag that is never closed ends with the page,
as do an open comment and an open script; repeated pages repeat; an empty table has no rows; other columns pass through, but
for `text`, in whatever case, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000

# Elements of HTML by what they do to text around and inside them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = RAW | frozenset("audio button canvas datalist head map math noscript object select svg template video".split())
ASIDE = frozenset("aside dialog footer form menu nav search".split())
CLOSES = {"li": ({"li"}, {"ol", "ul", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Own lists: words in class, id and role by what they say of an element.
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus discussion replies reply respond responses".split())
AWAY_WORDS = frozenset(
    "ad ads adsense adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies copyright cta disclaimer "
    "footer gdpr header hidden legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted promotion "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending warning widget widgets".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text".split())
OF_MAIN = frozenset(("header", "sidebar", "meta"))

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
LOOSE_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"[\s\x00]+")

# What elements say: inside an article; inside a part that holds no article; nothing; beside the article; never content.
ARTICLE, LIKELY, NOTHING, OUTSIDE, NEVER = range(5)
SAYS = {ARTICLE: 5.0, LIKELY: 2.0, NOTHING: 0.0, OUTSIDE: -7.0, NEVER: -40.0}
#: A block that no article holds, on a page that has one.
BESIDE = -5.0
#: Capacities of smoothness edges: to the next block, and to the next one of the same parent element.
NEXT, SIBLING = 0.6, 0.8

#: Forms: weights of a constant, words (log), share of links, an end of a sentence, heading, a sign of ownership.
PRIOR = np.array([-1.2, 0.55, -4.0, 1.0, 1.0, -3.0])
LINK_STEPS = 5


def spoken(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of class, id, role and label, and whether the element is hidden."""
    words, hidden = set(), False
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden", "style"):
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
        else:
            words.update(w.lower() for w in WORDS.findall(value))
    return frozenset(words), hidden


def state_in(outer: int, name: str, attributes: str) -> int:
    """What an element says of what it holds. An article inside takes back what is around it, but for comments."""
    if outer == NEVER or name in UNSEEN:
        return NEVER
    words, hidden = spoken(attributes) if attributes else (frozenset(), False)
    if hidden or words & COMMENT_WORDS:
        return NEVER
    if name in ("html", "body"):
        return outer
    away = words & AWAY_WORDS
    if words & MAIN_WORDS and not away - OF_MAIN:
        away = frozenset()
    if name in ("article", "main") and not away:
        return ARTICLE if name == "article" else max(min(outer, LIKELY), LIKELY) if outer != ARTICLE else ARTICLE
    if name in ASIDE or away or name == "header" and outer != ARTICLE:
        return OUTSIDE
    return LIKELY if outer == NOTHING and words & MAIN_WORDS else outer


class Page:
    """Blocks of a page: texts, and by block what is said, form and parent element."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.said: list[int] = []
        self.forms: list[tuple[int, int, bool, bool, bool]] = []
        self.parents: list[int] = []
        self.read(source)

    def read(self, source: str) -> None:
        stack: list[tuple[str, int, int]] = [("", NOTHING, 0)]  # name, what is said, number of the element or of the block element around
        pieces: list[str] = []
        linked, links, at, elements, tags = 0, 0, 0, 0, TAG
        heading = False

        def flush() -> None:
            nonlocal linked, pieces
            if pieces:
                text = SPACE.sub(" ", "".join(pieces)).strip()
                if text and stack[-1][1] != NEVER:
                    words = text.count(" ") + 1
                    form = min(7, int(math.log2(words))), min(LINK_STEPS, LINK_STEPS * linked // max(1, len(text))), text[-1] in ".!?…\"”»:", heading, "©" in text or "(c)" in text.lower()
                    self.texts.append(text)
                    self.said.append(stack[-1][1])
                    self.forms.append(form)
                    self.parents.append(stack[-1][2])
                pieces, linked = [], 0

        def drop(count: int) -> None:
            nonlocal links
            for name, _, _ in stack[count:]:
                links -= name == "a"
            del stack[count:]

        def text(raw: str) -> None:
            nonlocal linked
            if stack[-1][1] != NEVER:
                told = html.unescape(raw) if "&" in raw else raw
                pieces.append(told)
                linked += len(told) if links else 0

        while (start := source.find("<", at)) >= 0:
            if start > at:
                text(source[at:start])
            m = tags.match(source, start)
            if m is None and tags is TAG and source[start + 1 : start + 2].isalpha():
                tags = LOOSE_TAG  # a quote stays open to the end: from here on, a tag ends with its bracket
                m = tags.match(source, start)
            if m is None:
                text("<")
                at = start + 1
                continue
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            block = name in BLOCK
            if m[1]:
                held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if held and (block or name in UNSEEN or not any(x[0] in BLOCK for x in stack[held:])):
                    if block or stack[held][1] != stack[held - 1][1]:
                        flush()
                    drop(held)
                    heading = heading and name not in HEADINGS
                elif block:
                    flush()
                continue
            if block:
                flush()
                if name != "br":
                    held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "td", "th", "table")), 0)
                    if held and stack[held][0] == "p":
                        drop(held)
                    if name in CLOSES:
                        ends, within = CLOSES[name]
                        held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ends or stack[i][0] in within), 0)
                        if held and stack[held][0] in ends:
                            drop(held)
                    heading = name in HEADINGS
            if name in VOID:
                continue
            state = state_in(stack[-1][1], name, m[3])
            if state != stack[-1][1]:
                flush()
            elements += 1
            stack.append((name, state, elements if block else stack[-1][2]))
            links += name == "a"
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
        text(source[at:])
        flush()


def cell_features(cells: np.ndarray) -> np.ndarray:
    """Rows of forms to rows of what weights apply to."""
    cells = np.asarray(cells, dtype=float).reshape(-1, 5)
    return np.column_stack([np.ones(len(cells)), cells[:, 0], cells[:, 1] / LINK_STEPS, cells[:, 2], cells[:, 3], cells[:, 4]])


def fit(pages: DataFrame, sample: int = SAMPLE, strength: float = 4.0) -> np.ndarray:
    """Weights of forms, from blocks of about `sample` pages that their elements mark as content or not."""
    count = pages.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for source in batch.column(0).to_pylist():
                page = Page(source or "")
                for said, form in zip(page.said, page.forms, strict=True):
                    if said in (ARTICLE, OUTSIDE):
                        key = (*map(int, form), int(said == ARTICLE))
                        seen[key] = seen.get(key, 0) + 1
            columns = list(zip(*[(*k, n) for k, n in seen.items()], strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["length", "links", "ends", "heading", "owned", "content", "n"]
    chosen = pages.where(F.pmod(F.xxhash64("html"), F.lit(max(1, count))) < sample)
    cells = chosen.select("html").mapInArrow(counted, ", ".join(f"{n} long" for n in names)).groupBy(*names[:-1]).agg(F.sum("n").alias("n")).collect()
    return fitted(np.array([[r[n] for n in names] for r in cells], dtype=float).reshape(-1, len(names)), strength)


def fitted(cells: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Logistic regression on counted cells by Newton's method, drawn to PRIOR; both classes weigh the same, as 200 blocks each."""
    x, y, n = cell_features(cells[:, :5]), cells[:, 5], cells[:, 6].copy()
    for side in (0, 1):
        n[y == side] *= 200 / max(1.0, n[y == side].sum())
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n * (y - p)) - strength * (w - PRIOR)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source: which nodes are content at the least cost of odds given up and edges cut.

    Nodes of positive odds are sources of so much flow, those of negative odds sinks. Flow goes along shortest ways with
    room left (breadth first) until none is left; what sources still reach is content.
    """
    room: list[dict[int, float]] = [{} for _ in odds]
    for a, b, capacity in edges:
        room[a][b] = room[a].get(b, 0.0) + capacity
        room[b][a] = room[b].get(a, 0.0) + capacity
    left = list(odds)
    sources = [i for i, c in enumerate(odds) if c > 0]
    while True:
        came = {i: -1 for i in sources if left[i] > 1e-9}
        queue, end = list(came), -1
        for i in queue:
            if left[i] < -1e-9:
                end = i
                break
            for j, c in room[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(len(odds))]
        flow, i = -left[end], end
        while came[i] >= 0:
            flow = min(flow, room[came[i]][i])
            i = came[i]
        flow = min(flow, left[i])
        left[i] -= flow
        left[end] += flow
        i = end
        while (j := came[i]) >= 0:
            room[j][i] -= flow
            room[i][j] += flow
            i = j


def odds_of(page: Page, weights: np.ndarray) -> list[float]:
    """Log-odds of each block: what its elements say, and its form."""
    beside = BESIDE if ARTICLE in page.said else 0.0
    forms = (cell_features(page.forms) @ weights).tolist() if page.forms else []
    return [SAYS[s] + (beside if s in (NOTHING, LIKELY) else 0.0) + max(-4.0, min(4.0, f)) for s, f in zip(page.said, forms, strict=True)]


def main_text(source: str, weights: np.ndarray) -> str:
    page = Page(source)
    odds = odds_of(page, weights)
    edges, last = [(i, i + 1, NEXT) for i in range(len(odds) - 1)], {}
    for i, parent in enumerate(page.parents):
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return " ".join(t for t, content in zip(page.texts, cut(odds, edges), strict=True) if content)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """Pages with their main text as `text`."""

    @F.arrow_udf("string")
    def texts(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(s or "", weights) for s in sources.to_pylist()], pa.string())

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"]
    return pages.select(*kept, texts(F.col("html")).alias("text"))
