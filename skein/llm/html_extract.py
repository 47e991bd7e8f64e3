"""Main text of web pages by a tree-structured graphical model over their block elements.

Every block element is a binary variable, content or not. Its own potential comes from its tag, names, text and
links; a potential between parent and child says how alike they are. Both are fitted on labelled pages. Sum-product
messages, once up and once down the tree, give each element's marginal; text of elements at one half or more stays.

Cases: null, empty and textless pages give an empty text; pages of any length and depth are read whole, in time that
grows with their length alone; unclosed and stray tags are closed as browsers do for the common ones; a tag whose quote
or bracket never closes ends at the next bracket, or is text if there is none; script, style and the like never hold
text, whatever they contain; formulas and the labels of drawings are text of the block around them, a space before each of
their parts; an element at exactly even odds is content; equal rows each give their row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import bounded_batches, table, trimmed
from skein.llm.html_pages import MAIN_NAMES, SIDE_NAMES, labelled_pages

#: Labelled pages that the model is fitted on.
PAGES = 1500
#: Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source input".split())
VOID = frozenset("area base br head col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction menclose mfenced semantics annotation annotation-xml".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video title textarea select option".split())
SWALLOWS = frozenset("script style title textarea".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Of the opening tags that close an earlier one like them: what they close, and what stops the search for it.
ALIKE = ((("li",), {"li"}, {"ul", "ol", "menu"}), (("dd", "dt"), {"dd", "dt"}, {"dl"}), (("tr",), {"tr"}, {"table"}), (("td", "th"), {"td", "th"}, {"tr", "table"}))
SCOPES = frozenset("article aside blockquote body div footer form header html main nav ol section table td th ul li".split())
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dd dt table tr td th nav header footer aside form fieldset label button blockquote pre figure figcaption body html address menu details summary hr".split()
#: The searches for an earlier tag to close: first that for a paragraph, then those of ALIKE.
SEARCHES = (({"p"}, SCOPES), *((shut, stop) for _, shut, stop in ALIKE))
SEARCH_OF = dict.fromkeys(CLOSES_P, 0) | {t: k + 1 for k, (tags, _, _) in enumerate(ALIKE) for t in tags}
#: Without a way back into what has matched, so that a failed match is one reading.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BLIND_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>", re.I) for t in RAW}
#: Within a drawing: what holds text that is shown, and what doesn't within that.
LABELS, UNSHOWN = frozenset(("text", "foreignobject")), frozenset(("script", "style", "title"))
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARK = re.compile(r'data-main="([01])"')
NAME_WORDS = {w: k for k, w in enumerate(dict.fromkeys([*MAIN_NAMES, *(w for names in SIDE_NAMES.values() for w in names)]))}
TAG_PLACE = {t: k for k, t in enumerate(TAGS)}
LEVELS = 6
OTHER_TAG, NAME_0 = len(TAGS), len(TAGS) + 1
TEXT_0 = NAME_0 + len(NAME_WORDS)
LINK_0, STOP_0, WHOLE_0 = TEXT_0 + LEVELS, TEXT_0 + LEVELS + 4, TEXT_0 + LEVELS + 7
ABOVE_0 = WHOLE_0 + LEVELS + 1
N_FEATURES = ABOVE_0 + TEXT_0
#: Tags that tell about all that stands below them, as names do.
TELLING = frozenset(TAG_PLACE[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "button", "label", "details", "menu"))


@functools.lru_cache(maxsize=50_000)
def tag_features(tag: str, attributes: str) -> tuple[int, ...]:
    named = [a or b or c for a, b, c in NAMES.findall(attributes)] if "=" in attributes else []
    found = {NAME_WORDS[w] for x in named for w in re.split(r"[^a-z]+", x.lower()) if w in NAME_WORDS}
    return (TAG_PLACE.get(tag, OTHER_TAG), *sorted(NAME_0 + k for k in found))


@functools.lru_cache(maxsize=50_000)
def below(above: tuple[int, ...], own: tuple[int, ...]) -> tuple[int, ...]:
    """What an element's children have above them."""
    return tuple(sorted({*above, *(ABOVE_0 + f for f in own if f in TELLING or f >= NAME_0)}))


class Scanner:
    """The tags of a page from left to right. What was once looked for in vain isn't looked for again."""

    def __init__(self, source: str):
        self.source, self.pattern, self.missing = source, TAG, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def next(self, at: int, end: int) -> tuple[int, int, re.Match | None]:
        """Where the next markup before end begins and ends, and its match if it is a tag; (end, end, None) if there is none."""
        source = self.source
        while 0 <= (begin := source.find("<", at, end)):
            after = source[begin + 1 : begin + 2]
            if after == "/" or after.isalpha():
                if self.find(">", begin) < 0:
                    break
                m = self.pattern.match(source, begin)
                if m is None and self.pattern is TAG and BLIND_TAG.match(source, begin):  # a quote that never closes
                    self.pattern = BLIND_TAG
                    m = BLIND_TAG.match(source, begin)
                if m is not None:
                    return begin, m.end(), m
            elif source.startswith("!--", begin + 1):
                stop = self.find("-->", begin + 4)
                return begin, stop + 3 if stop >= 0 else len(source), None
            elif after in ("!", "?") and (stop := self.find(">", begin)) >= 0:
                return begin, stop + 1, None
            at = begin + 1
        return end, end, None

    def raw_end(self, tag: str, at: int) -> tuple[int, int] | None:
        """Where the end tag of an element that holds no text stands."""
        if f"</{tag}" in self.missing:
            return None
        stop = RAW_END[tag].search(self.source, at)
        if stop is None:
            self.missing.add(f"</{tag}")
            return None
        return stop.span()

    def labels(self, at: int, end: int) -> str:
        """The text shown in a drawing, a space before each part."""
        out, open_, depth, hidden = [], Counter(), 0, None
        while at < end:
            begin, stop, m = self.next(at, end)
            if depth and hidden is None:
                out.append(self.source[at:begin])
            at = stop
            out.append(" ")
            if m is None:
                continue
            tag = m[2].lower()
            if hidden is not None:
                hidden = None if m[1] and tag == hidden else hidden
            elif tag in UNSHOWN:
                hidden = None if m[1] or m[3].endswith("/") else tag
            elif tag in LABELS and not m[3].endswith("/"):
                step = (0 if open_[tag] < 1 else -1) if m[1] else 1
                open_[tag] += step
                depth += step
        text = " ".join("".join(out).split())
        return f" {text} " if text else ""


class Page:
    """The block elements of a page in order (parents first) and its blocks of text."""

    def __init__(self, source: str, marks: bool = False):
        self.parent, self.fixed, self.own, self.linked, self.stops, self.marked = [-1], [(OTHER_TAG,)], [0], [0], [0], [None]
        self.above: list[tuple[int, ...]] = [()]
        self.blocks: list[tuple[int, str]] = []
        #: Of the open elements: place, tag, and for each search the level of what it finds (0: nothing).
        stack, names, found, pending, links = [0], ["#root"], [(0,) * len(SEARCHES)], [], 0
        open_ = Counter()
        scanner = Scanner(source)

        def flush() -> None:
            if pending:
                text = "".join(pending)
                pending.clear()
                if "&" in text:
                    text = entities.unescape(text)
                if text := " ".join(text.split()):
                    k = stack[-1]
                    self.blocks.append((k, text))
                    self.own[k] += len(text)
                    self.stops[k] += text.count(". ") + text.count(", ") + (text[-1] in ".!?")

        def close(level: int) -> None:
            open_.subtract(names[level:])
            del names[level:], stack[level:], found[level:]

        at, end = 0, len(source)
        while at < end:
            begin, after, m = scanner.next(at, end)
            if begin > at:
                pending.append(source[at:begin])
                if links:
                    self.linked[stack[-1]] += begin - at
            at = after
            if m is None:
                continue
            tag = m[2].lower()
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    stop = scanner.raw_end(tag, at)
                    if tag == "svg" and stop and (label := scanner.labels(at, stop[0])):
                        pending.append(label)
                        if links:
                            self.linked[stack[-1]] += len(label)
                    at = stop[1] if stop else end if tag in SWALLOWS else at
                continue
            if tag in MATH:
                if not m[1]:
                    pending.append(" ")
                continue
            if tag in INLINE:
                if tag == "a":
                    links = 0 if m[1] else 1
                elif tag == "br":
                    pending.append(" ")
                continue
            flush()
            links = 0
            if m[1]:
                if open_[tag] > 0:
                    level = len(names) - 1
                    while names[level] != tag:
                        level -= 1
                    close(level)
                continue
            if tag in SEARCH_OF and (level := found[-1][SEARCH_OF[tag]]):
                close(level)
            if tag in VOID:
                continue
            self.parent.append(stack[-1])
            self.above.append(below(self.above[stack[-1]], self.fixed[stack[-1]]))
            self.fixed.append(tag_features(tag, m[3] if m[3].find("=") >= 0 and ("class" in m[3] or "id" in m[3] or "role" in m[3]) else ""))
            self.own.append(0)
            self.linked.append(0)
            self.stops.append(0)
            if marks:
                told = MARK.search(m[3])
                self.marked.append(int(told[1]) if told else None)
            found.append(tuple([len(names) if tag in shut else 0 if tag in stop else last for (shut, stop), last in zip(SEARCHES, found[-1], strict=True)]))
            stack.append(len(self.parent) - 1)
            names.append(tag)
            open_[tag] += 1
        flush()

    def features(self) -> list[tuple[int, ...]]:
        """The places of the features that each element has."""
        n = len(self.parent)
        whole, linked, stops = self.own[:], self.linked[:], self.stops[:]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            whole[p] += whole[k]
            linked[p] += linked[k]
            stops[p] += stops[k]
        out = []
        for k in range(n):
            w, o = whole[k], self.own[k]
            out.append((*self.fixed[k], *self.above[k], TEXT_0 + min(LEVELS - 1, o.bit_length() // 2), LINK_0 + (min(3, 4 * linked[k] // w) if w else 0),
                        STOP_0 + (0 if not stops[k] else 1 if stops[k] * 60 < w else 2), WHOLE_0 + min(LEVELS - 1, max(0, w.bit_length() // 2 - 1))))
        return out


def soft(x: float) -> float:
    """log(1 + e**x)"""
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


class Model:
    def __init__(self, weights: list[float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def marginals(self, page: Page) -> list[float]:
        """The log odds of content of each element, by messages up and down."""
        (p00, p01), (p10, p11) = self.pair
        parent, w = page.parent, self.weights
        local = [sum([w[f] for f in fs]) for fs in page.features()]
        n = len(parent)
        up, sent = local[:], [0.0] * n
        for k in range(n - 1, 0, -1):
            a = up[k]
            sent[k] = m = p10 - p00 + soft(a + p11 - p10) - soft(a + p01 - p00)
            up[parent[k]] += m
        belief = up[:]
        for k in range(1, n):
            a = belief[parent[k]] - sent[k]
            belief[k] = up[k] + p01 - p00 + soft(a + p11 - p01) - soft(a + p10 - p00)
        return belief

    def text(self, source: str | None) -> str:
        page = Page(source or "")
        if not page.blocks:
            return ""
        belief = self.marginals(page)
        return " ".join([text for k, text in page.blocks if belief[k] >= 0])


def fit(pages: Iterator[str], rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Own potentials by logistic regression, those between parent and child by smoothed counts."""
    rows, labels, owner, counts = [], [], [], np.ones((2, 2))
    for source in pages:
        page = Page(source, marks=True)
        for k, fs in enumerate(page.features()):
            if page.marked[k] is None:
                continue
            rows += fs
            owner += [len(labels)] * len(fs)
            labels.append(page.marked[k])
            p = page.parent[k]
            if p >= 0 and page.marked[p] is not None:
                counts[page.marked[p], page.marked[k]] += 1
    x = np.zeros((len(labels), N_FEATURES), np.float32)
    x[owner, rows] = 1
    y, w, velocity = np.array(labels, np.float32), np.zeros(N_FEATURES, np.float32), np.zeros(N_FEATURES, np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        velocity = 0.9 * velocity + x.T @ (y - p) / len(y) - ridge * w
        w = w + 1.0 * velocity
    joint = counts / counts.sum()
    pair = np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))
    return Model(w.tolist(), pair.tolist())


@functools.cache
def fitted(pages: int = PAGES) -> Model:
    return fit(labelled_pages(pages))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars per page row."""
    model = model or fitted()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [model.text(x.as_py()) for x in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
