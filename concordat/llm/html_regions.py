"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read once as a sequence of words and tags. Words score above zero, by how likely
words under such elements are content; tags score below zero, by how often such tags stand
outside the main text. A linear scan finds the contiguous region of the highest score (of
several the first, without words or tags that add nothing at its start). What stands in
elements that are no content (menus, forms, adverts, ...) scores nothing and is left out,
wherever it is, and counts as one opening and one closing tag of the full cost. The region
is then widened to whole blocks: to the element that the page marks as its article (else
main) part where all of it lies in one, else to the innermost block element around it.

Weights come from labelled pages: pages of the table that mark exactly one main part. Words
in it are content, all others not; the marking elements themselves are never features. A
logistic model over the elements that words stand in (their names and the words of class,
id and role) starts from ``PRIOR`` and moves to what the labelled pages say. It is fitted
on the at most ``FIT_PAGES`` different pages of the smallest hashes, none above ``FIT_CHARS``
characters; counts are summed in tasks and the driver gets one row for each set of features.
A table without labelled pages is read by the prior weights.

Blocks: block elements part text, inline ones and comments do not, a line break is a space.
White space inside a block (Unicode's) becomes one space; blocks without any text go.

Nulls: a null html is an empty page with an empty text; page_id and url pass through, null
or not. Broken markup: unclosed elements end with the page or with what implies their end, an
unclosed comment or script reaches to the end, ``<`` before anything but a name is text. Rows
that repeat are extracted each for itself. Pages of any length are read whole in linear
time. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concordat.llm.shared import slices

FIT_PAGES, FIT_CHARS, LEAST_PAGES = 2000, 200_000, 5
#: A tag that always stands outside costs as much as so many words of content; scores are thousandths of a word.
TAG_WORDS, UNIT = 3.25, 1000

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
MAIN = ("article", "main")
#: An opening tag ends the nearest of these open elements, unless one of the others is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

#: Log-odds of content before any page is seen: the bias, names of elements and words of class, id and role that are no content.
BIAS, NO_CONTENT = 2.0, -6.0
NAMES = (
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noembed noframes noscript object option script search select style svg template textarea title "
    "video xmp"
)
WORDS = (
    "ad ads advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus dropdown footer gdpr "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion recommendations recommended related replies "
    "respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets"
)
PRIOR = {**{f"<{n}": NO_CONTENT for n in NAMES.split()}, **{w: NO_CONTENT for w in WORDS.split()}, "<header": NO_CONTENT, "header": NO_CONTENT, "hidden": NO_CONTENT, "": BIAS}
#: Share of a tag's occurrences outside the main text, before any page is seen.
TEXT_TAGS = "a abbr b blockquote br cite code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li mark ol p pre q s small span strong sub sup u ul".split()
TEXT_SHARE, OTHER_SHARE, PRIOR_TAGS = 0.1, 0.5, 20

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(>|\Z)|<[!?/][^>]*+>?""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|style|hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.IGNORECASE)
MARKED = re.compile("class|id|role|style", re.IGNORECASE)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ABOUT = re.compile(r"(?:has|no|not|with|without|is)[-_]", re.IGNORECASE)
OWN_HEADER = frozenset("article entry post story".split())
RAW_END = {n: re.compile(f"</{n}(?=[\\s/>]|\\Z)", re.IGNORECASE) for n in RAW}


@dataclass(frozen=True)
class Weights:
    """Log-odds by feature ("" is the bias) and share outside by tag name."""

    odds: dict[str, float]
    outside: dict[str, float]

    def cost(self, name: str) -> int:
        """Of one tag, in thousandths of a word."""
        share = self.outside.get(name, TEXT_SHARE if name in TEXT_TAGS else OTHER_SHARE)
        return -max(1, round(UNIT * TAG_WORDS * share))


def hints(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and ``hidden`` for what is not shown."""
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            out.add("hidden")
        elif key != "style":
            for token in value.split():
                if not ABOUT.match(token):
                    words = {w.lower() for w in PIECE.findall(token)}
                    out |= words - {"header"} if words & OWN_HEADER else words
    return tuple(sorted(out))


class Contexts:
    """Sets of features of open elements, numbered as they come up; element after element leads from one to the next."""

    def __init__(self, weights: Weights, known_only: bool):
        self.weights, self.known_only = weights, known_only
        self.clear()

    def clear(self) -> None:
        self.sets: list[tuple[frozenset, bool]] = [(frozenset(), False)]
        self.number = {self.sets[0]: 0}
        self.next: dict[tuple, int] = {}
        self.score = [self.worth(frozenset())]

    def worth(self, features: frozenset) -> int:
        """Of a word, in thousandths; 0 where it is no content."""
        odds = self.weights.odds.get("", BIAS) + sum(self.weights.odds.get(f, 0.0) for f in sorted(features))
        return round(UNIT / (1 + math.exp(-max(min(odds, 30.0), -30.0)))) if odds >= 0 else 0

    def step(self, at: int, name: str, hint: tuple[str, ...]) -> int:
        key = (at, name, hint)
        if key not in self.next:
            features, inside = self.sets[at]
            own = set() if name in ("html", "body") or (name in MAIN and not inside) else set(hint)
            if name not in (*MAIN, "html", "body") and not (name == "header" and inside):
                own.add(f"<{name}")
            if inside:
                own.discard("header")
            if self.known_only:
                own &= self.weights.odds.keys()
            to = (features | own, inside or name in MAIN)
            if to not in self.number:
                self.number[to] = len(self.sets)
                self.sets.append(to)
                self.score.append(self.worth(to[0]))
            self.next[key] = self.number[to]
        return self.next[key]


def walk(page: str, contexts: Contexts, text: Callable, tag: Callable) -> None:
    """Calls ``text(run, context)`` and ``tag(name, opens, context outside it, context inside it)`` in page order.

    Open elements are frames, one a block element, each with its open inline elements: an end tag of an inline element
    reaches no further than its block.
    """
    frames: list[tuple] = [("", 0, [], Counter())]  # name, context outside, [(inline name, context outside)], inline names
    blocks: Counter = Counter()
    at = here = 0

    def leave() -> None:
        nonlocal here
        name, outside, inline, _ = frames.pop()
        while inline:
            n, o = inline.pop()
            tag(n, False, o, here)
            here = o
        blocks[name] -= 1
        tag(name, False, outside, here)
        here = outside

    def leave_to(name: str) -> None:
        while frames[-1][0] != name:
            leave()
        leave()

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at:
            text(page[at:start], here)
        if not m:
            break
        at = m.end()
        if not m[4]:  # no element, or a tag that the page's end cuts off
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                if blocks[name] > 0:
                    leave_to(name)
            elif frames[-1][3][name] > 0:
                _, _, inline, names = frames[-1]
                while True:
                    n, o = inline.pop()
                    names[n] -= 1
                    tag(n, False, o, here)
                    here = o
                    if n == name:
                        break
            continue
        if name in BLOCK:
            if blocks["head"] > 0 and name not in HEAD and name != "head":
                leave_to("head")
            if frames[-1][0] == "p":
                leave()
            if name in ENDS:
                ends, stops = ENDS[name]
                k = len(frames) - 1
                while k and frames[k][0] not in ends and frames[k][0] not in stops:
                    k -= 1
                if k and frames[k][0] in ends:
                    while len(frames) > k:
                        leave()
        inside = contexts.step(here, name, hints(m[3]) if m[3] and MARKED.search(m[3]) or "hidden" in m[3] else ())
        tag(name, True, here, inside)
        if name in VOID:
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else size
            tag(name, False, here, inside)
            if end:  # its end tag goes with it
                close = page.find(">", at)
                at = close + 1 if close >= 0 else size
        elif name in BLOCK:
            frames.append((name, here, [], Counter()))
            blocks[name] += 1
            here = inside
        else:
            frames[-1][2].append((name, here))
            frames[-1][3][name] += 1
            here = inside
    while len(frames) > 1:
        leave()


def best_region(scores: list[int]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the highest sum above 0: the first to end, and of those the shortest; (0, 0) if there is none."""
    s = np.concatenate([[0], np.cumsum(np.array(scores, np.int64))])
    low = np.minimum.accumulate(s)
    end = int(np.argmax(s - low))
    if s[end] == low[end]:
        return 0, 0
    return int(end - 1 - np.argmax((s[:end] == low[end])[::-1])), end


def extract(page: str, contexts: Contexts) -> str:
    """The main text of one page."""
    score, costs = contexts.score, {}
    scores: list[int] = []  # of events
    runs: list[tuple[int, int, str]] = []  # event, block, text of content
    edge: list[int] = []  # block by event
    boxes: list[list] = []  # name, first and last event of block elements
    open_boxes: list[int] = []
    block = 0

    def text(run: str, here: int) -> None:
        if score[here]:
            runs.append((len(scores), block, run))
            scores.append(score[here] * len(run.split()))
            edge.append(block)

    def tag(name: str, opens: bool, outside: int, inside: int) -> None:
        nonlocal block
        if name in BLOCK:
            block += 1
        if not score[outside]:
            return
        if name == "br":
            runs.append((len(scores), block, " "))
        if name in BLOCK and name not in VOID:
            if opens:
                open_boxes.append(len(boxes))
                boxes.append([name, len(scores), len(scores)])
            else:
                boxes[open_boxes.pop()][2] = len(scores)
        if name not in costs:
            costs[name] = contexts.weights.cost(name)
        scores.append(costs[name] if score[inside] else -round(UNIT * TAG_WORDS))
        edge.append(block)

    walk(page, contexts, text, tag)
    start, end = best_region(scores)
    if start == end:
        return ""
    around = [b for b in boxes if b[1] <= start and end <= b[2] + 1 and b[0] not in ("html", "body")]
    whole = next((b for name in MAIN for b in around if b[0] == name), around[-1] if around else None)
    first, last = edge[start], edge[end - 1]
    out: dict[int, list[str]] = {}
    for event, b, run in runs:
        if whole[1] <= event <= whole[2] if whole else first <= b <= last:
            out.setdefault(b, []).append(entities.unescape(run) if "&" in run else run)
    return "\n".join(filter(None, (" ".join("".join(x).split()) for x in out.values())))


def evidence(page: str, contexts: Contexts) -> tuple[Counter, Counter] | None:
    """Words by (features, in the main part) and tags by (name, in the main part) of a page that marks one main part, else None.

    Of tags only those count that the prior weights do not call no content.
    """
    words: Counter = Counter()
    tags: Counter = Counter()
    main, level = 0, 0

    def text(run: str, here: int) -> None:
        n = len(run.split())
        if n:
            words[contexts.sets[here][0], level > 0] += n

    def tag(name: str, opens: bool, outside: int, inside: int) -> None:
        nonlocal main, level
        if name in MAIN:
            main += opens and level == 0
            level += 1 if opens else -1
        elif contexts.score[inside] and name not in ("html", "body"):
            tags[name, level > 0] += 1

    walk(page, contexts, text, tag)
    return (words, tags) if main == 1 and any(inside for _, inside in words) else None


def fit(pages: DataFrame) -> Weights:
    """Weights from the pages of (page_id, url, html) that mark one main part."""
    prior = Weights(PRIOR, {})
    h = F.xxhash64("page_id", "url", "html")
    some = pages.where(F.length("html") <= FIT_CHARS).where(F.lower("html").rlike("<(article|main)[\\s>]"))
    top = some.select(h.alias("h")).distinct().orderBy("h").limit(FIT_PAGES).agg(F.max("h")).first()[0]
    if top is None:
        return prior

    names = ["kind", "what", "inside", "outside", "pages"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts(prior, known_only=False)
        for b in batches:
            rows = []
            for page in b.column(0).to_pylist():
                contexts.clear()
                words, tags = evidence(page, contexts) or ({}, {})
                rows += [("words", " ".join(sorted(w)), words[w, True], words[w, False], 1) for w in {w for w, _ in words}]
                rows += [("tags", t, tags[t, True], tags[t, False], 1) for t in {t for t, _ in tags}]
            columns = [pa.array([r[k] for r in rows], pa.string() if k < 2 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names)

    each = some.where(h <= top).select("html").mapInArrow(count, "kind string, what string, inside long, outside long, pages long")
    rows = each.groupBy("kind", "what").agg(*[F.sum(c).alias(c) for c in names[2:]]).orderBy("kind", "what").collect()
    share = {}
    for r in rows:
        if r.kind == "tags" and r.pages >= LEAST_PAGES:
            before = PRIOR_TAGS * (TEXT_SHARE if r.what in TEXT_TAGS else OTHER_SHARE)
            share[r.what] = (r.outside + before) / (r.inside + r.outside + PRIOR_TAGS)
    return Weights(learned([(r.what.split(), r.inside, r.outside, r.pages) for r in rows if r.kind == "words"]), share)


def learned(rows: list[tuple[list[str], int, int, int]]) -> dict[str, float]:
    """Log-odds by feature: a logistic model of words, drawn to ``PRIOR``. The words of all pages together weigh as much as the pages are many."""
    seen: Counter = Counter()
    for features, _, _, pages in rows:
        for f in features:
            seen[f] += pages
    names = ["", *sorted(f for f, n in seen.items() if n >= LEAST_PAGES)]
    place = {f: k for k, f in enumerate(names)}
    total = sum(i + o for _, i, o, _ in rows)
    if not total:
        return dict(PRIOR)
    x = np.zeros((len(rows), len(names)))
    fixed = np.zeros(len(rows))
    for k, (features, *_) in enumerate(rows):
        x[k, [0, *[place[f] for f in features if f in place]]] = 1
        fixed[k] = sum(PRIOR.get(f, 0.0) for f in features if f not in place)
    weight = max(p for *_, p in rows) / total
    inside, outside = (weight * np.array([r[c] for r in rows], float) for c in (1, 2))
    mean = np.array([PRIOR.get(f, 0.0) for f in names])
    theta = mean.copy()
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ theta + fixed, -30, 30)))
        slope = x.T @ (inside * (1 - p) - outside * p) - (theta - mean)
        curve = (x * ((inside + outside) * p * (1 - p))[:, None]).T @ x + np.eye(len(names))
        move = np.clip(np.linalg.solve(curve, slope), -2, 2)
        theta = theta + move
        if np.abs(move).max() < 1e-9:
            break
    return {**PRIOR, **dict(zip(names, np.round(theta, 6).tolist(), strict=True))}


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of (page_id, url, html)."""
    d = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    weights = weights or fit(d)
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts(weights, known_only=True)
        for b in slices(batches, "html"):
            contexts.clear()
            out = [extract(h, contexts) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
