"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between two tags that are not
inline. A block's features are its ancestors' tags, classes and ids, and its
text's length, links, marks and capitals. The field scores a page's whole
chain of labels (main text or not) by block features and by which label
follows which; the best chain is found by Viterbi.

Labelled pages are those that mark their article (``article``, ``main``) in
the source; a block in it counts as main text unless it is in a menu, header,
footer, sidebar, notice, advert, form or comment. A few built-in pages of
other layouts are always among them. At most ``max_pages`` pages, the least by a hash of
their id (a documented bound), are learned from, in one task; the model has
a fixed size. All pages are decoded whole, where they lie.

Scripts, styles and text areas are no text, to their end tag or the end of the
page. Pictures (svg), frames, lists to choose from, templates and what stands
for a script are left out only if they are ended; a start tag without its end
hides nothing.

Null html is an empty page; a page without main text has an empty text. An
empty table gives no rows; repeated pages each have theirs; input columns named
as the added text are replaced. A page is read once from front to back: what has
been found to lack its end is not looked for again, so long or broken pages
cost time in proportion to their length.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.quality import least

MAX_PAGES = 300
FEATURES = 1 << 14
EPOCHS, RATE, DECAY = 6, 0.3, 1e-4
#: Content that is no markup and runs to its own end tag, or to the end of the page.
RAW = ("script", "style", "textarea")
#: Content that is not shown, if its end tag is there; without it they are tags like others.
PLAIN, NESTED = ("iframe", "noscript"), ("svg", "template", "select")
OPEN = re.compile(r"(?P<comment><!--)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)|<[!?]")
STOP = re.compile(r"[\"'>]")
END = {k: re.compile(rf"</{k}\s*>", re.I) for k in RAW}
#: To the end tag, with no other start tag of the kind before it.
CLOSED = {k: re.compile(rf"(?:(?!<{k}[\s/>]).)*?</{k}\s*>", re.S | re.I) for k in RAW + PLAIN}
SVG_END = re.compile(r"(?=</svg\s*>)", re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends the open element of its own kind (and what is in it).
ENDS_ITSELF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main nav header footer aside form section body".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button label head title address".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer header menu "
    "nav navbar navigation newsletter notice pagination popup promo related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
PRIMER = [
    ("<div id=top class=header>Site name</div><ul class=menu><li><a href=/>Home</a><li><a href=/n>News</a></ul><div class=content><h2>A title of a story</h2>"
     "<p>The first paragraph says what has happened, and where.</p><p>The second one tells more of it, at some length.</p></div>"
     "<div class=comments><p>I liked this very much, thank you.</p></div><div class=footer>Copyright, all rights reserved.</div>", "content"),
    ("<header><a href=/>Home</a></header><div class=cookie-notice>We use cookies on this site. <button>Accept</button></div><main class=post><h1>News of the day</h1>"
     "<p>It rained in the morning, then the sun came out.</p><div class=advert>Buy now, for less.</div><form><label>Mail</label>Subscribe to our letters</form>"
     "<p>In the evening it rained again, as it had been said.</p></main><aside><p>Most read stories of this week.</p></aside><footer>About us</footer>", "post"),
    ("<table><tr><td class=sidebar>Links and more links<td class=body><p>A long text stands in a table here, as it once was done.</p><p>It goes on, and then it ends.</p></table>", "body"),
    ("<nav><a href=/>Home</a></nav><article class=story><h1>A story told at length</h1><p>It begins here, with a sentence.</p><aside>Read more of this elsewhere</aside>"
     "<p>It goes on.<div class='ad box'>Buy things, now and here.</div><p>Then comes more text, as it does.</p><ul><li>An item of it.<li>One more item.</ul>"
     "<form>Get our letters by mail, each day.</form><p>It ends.</p><div class=comments><p>What a story, I liked it.</p><p>So did I.</p></div></article><footer>All rights</footer>", "story"),
    ("<article id=story><header>By a writer, on a day</header><h2>Short</h2><p>One.</p><div class=notice>This site keeps cookies.</div><p>Two words.</p><nav>Back and forth</nav>"
     "<blockquote>Somebody said so.</blockquote><p>Three.</p><section class=comment>A reader's thought.</section><div class=sidebar><p>Other news of today.</p></div><footer>Tags and dates</footer></article>", "story"),
]


class Mark(NamedTuple):
    """A comment, declaration or tag: where it lies, its name in small letters, its attributes, and what kind of tag."""

    start: int
    end: int
    tag: str | None = None
    ends: bool = False
    attributes: str = ""
    raw: bool = False
    unseen: bool = False


class Marks:
    """The marks of a page, from any place on. What has been found to have no end is remembered, so a page is read once."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.span = (0, -1, None)  # between these two places the next stop is the third
        self.dead: set[tuple[bool, int]] = set()  # quotes from which no end of a tag is reached
        self.none: dict[str, int] = {}  # from here on there is none of it

    def next(self, at: int) -> Mark | None:
        page = self.page
        while m := OPEN.search(page, at):
            start, at = m.start(), m.end()
            if m["comment"]:
                end = self.find("-->", at)
                return Mark(start, len(page) if end < 0 else end + 3)
            if self.last < at:
                continue  # nothing but comments can follow
            if m["tag"] is None:
                return Mark(start, page.index(">", at) + 1)
            name, ends = m["tag"].lower(), bool(m["end"])
            plain = not ends and (page[at] in "/>" or page[at].isspace())
            if plain and name in RAW:
                end = page.index(">", at)
                return Mark(start, end + 1, name, False, page[at:end], raw=True)
            unseen = plain and name in PLAIN + NESTED
            end = self._end(at, unseen)
            if end is None and unseen:
                end = page.index(">", at)
            if end is not None:
                return Mark(start, end + 1, name, ends, page[at:end], unseen=unseen)
        return None

    def find(self, text: str, at: int) -> int:
        """Like ``str.find``; a text that is not there is looked for once."""
        if at >= self.none.get(text, len(self.page) + 1):
            return -1
        found = self.page.find(text, at)
        if found < 0:
            self.none[text] = at
        return found

    def _stop(self, at: int) -> int | None:
        if not self.span[0] <= at <= self.span[1]:
            m = STOP.search(self.page, at)
            self.span = (at, m.start() if m else len(self.page), m.start() if m else None)
        return self.span[2]

    def _end(self, at: int, no_tags: bool) -> int | None:
        """Place of the ``>`` after attributes; quotes are read as wholes (with ``no_tags``, without any ``<`` in them)."""
        met = []
        while (stop := self._stop(at)) is not None:
            quote = self.page[stop]
            if quote == ">":
                return stop
            met.append((no_tags, stop))
            close = -1 if met[-1] in self.dead else self.find(quote, stop + 1)
            if close < 0 or no_tags and self.page.find("<", stop, close) >= 0:
                break
            at = close + 1
        self.dead.update(met)
        return None


def _tags(page: str) -> Iterator[Mark]:
    """Where the text breaks off and goes on again, and the tag there if it counts."""
    marks, found = Marks(page), []
    unended: dict[str, list[int]] = {k: [] for k in NESTED}
    unseen: dict[int, int] = {}  # start tag to end tag
    svg_end: tuple[int, re.Match | None] = (0, None)
    at = 0
    while m := marks.next(at):
        at, name = m.end, m.tag
        if m.raw:
            if not unended["svg"]:
                end = END[name].search(page, at)
                at = end.end() if end else len(page)
            elif not m.attributes.endswith("/"):  # in an svg a tag can be its own end
                end = CLOSED[name].match(page, at)
                if not end:
                    if svg_end[1] is None and svg_end[0] <= at < len(page) or svg_end[1] and svg_end[1].start() < at:
                        svg_end = (len(page) + 1, None) if not (x := SVG_END.search(page, at)) else (0, x)
                    end = svg_end[1] or END[name].search(page, at)
                at = end.end() if end else len(page)
            name = m.tag
        elif name in PLAIN and m.unseen:
            if end := CLOSED[name].match(page, at):
                name, at = None, end.end()
        elif name in NESTED:
            if m.ends:
                if unended[name]:
                    unseen[unended[name].pop()] = len(found)
            elif name == "svg" and m.attributes.endswith("/"):
                name = None
            else:
                unended[name].append(len(found))
        # what a script holds is no tag
        found.append(Mark(m.start, at, None if m.raw else name, m.ends, m.attributes))
    i = 0
    while i < len(found):
        if i in unseen:
            yield Mark(found[i].start, found[unseen[i]].end)
            i = unseen[i]
        else:
            yield found[i]
        i += 1


class Node:
    """An open element: its tag and names, and what they and all those around it add up to."""

    __slots__ = ("tag", "words", "parent", "own", "tags", "section", "aside", "inside")

    def __init__(self, tag: str = "", names: str = "", parent: Node | None = None) -> None:
        self.tag, self.words, self.parent = tag, (), parent
        if parent is None:
            self.own, self.tags, self.section, self.aside, self.inside = frozenset([_number("bias")]), frozenset(), "", False, False
            return
        words = [w for w in re.split(r"[\s_-]+", names) if w] if names else []
        self.words = tuple(words)
        aside = tag in ASIDE_TAGS or bool(ASIDE_NAMES & set(words))
        own = {_number(f) for f in [f"in:{tag}", *(f"name:{w}" for w in words), *["aside"] * aside]}
        self.own = parent.own if own <= parent.own else parent.own | own  # shared where nothing is new
        self.tags = parent.tags if tag in parent.tags else parent.tags | {tag}
        self.section = tag if tag in SECTIONS else parent.section
        self.aside = parent.aside or aside
        self.inside = parent.inside or tag in ("article", "main") or "main" in words or "article" in words

    def label(self) -> int:
        """The label that the source itself gives: in the article, and in nothing aside within."""
        return int(self.inside and not self.aside)

    def within(self, name: str) -> bool:
        """Whether the element or one around it has the name."""
        node: Node | None = self
        while node is not None and name not in node.words:
            node = node.parent
        return node is not None

    def features(self) -> tuple[int, ...]:
        last = [n.tag for n in (self.parent, self) if n is not None and n.parent is not None]
        return _path_features(self.own, self.tags, self.section, ">".join(last), self.tag)


@lru_cache(maxsize=20_000)
def _path_features(own: frozenset, tags: frozenset, section: str, last: str, tag: str) -> tuple[int, ...]:
    """Numbers of the features of a block's ancestors."""
    return tuple(sorted(own | {_number(f) for f in [*(f"{section}/{t}" for t in tags), f"last:{last}", f"parent:{tag}"]}))


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """The leaf blocks in order: the innermost open element, text, and how many characters stand in links."""
    found: list[tuple[Node, str, int]] = []
    here = Node()
    opened: dict[str, list[Node]] = {}  # by tag, those that are open
    texts: list[str] = []
    linked = at = 0
    depth = 0  # of open links

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                found.append((here, text, linked))
            texts.clear()
        linked = 0

    def close(node: Node) -> Node:
        """Close an element and all in it."""
        current = here
        while current is not node.parent:
            opened[current.tag].pop()
            current = current.parent
        return current

    for mark in _tags(page):
        if mark.start > at:
            texts.append(page[at : mark.start])
            linked += (mark.start - at) * (depth > 0)
        at, tag = mark.end, mark.tag
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "a":
                depth = 0 if mark.ends else 1
            elif tag == "br":
                texts.append(" ")
            continue
        flush()
        depth = 0
        if mark.ends:
            if opened.get(tag):
                here = close(opened[tag][-1])
            continue
        if tag in ENDS_ITSELF:
            node = here
            while node.parent is not None and node.tag != tag and node.tag in ENDS_ITSELF:
                node = node.parent
            if node.parent is not None and node.tag == tag:
                here = close(node)
        if tag not in VOID and not mark.attributes.endswith("/"):
            names = " ".join("".join(g) for g in NAMES.findall(mark.attributes)).lower() if mark.attributes else ""
            here = Node(tag, names, here)
            opened.setdefault(tag, []).append(here)
    if at < len(page):
        texts.append(page[at:])
    flush()
    return found


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


@lru_cache(maxsize=50_000)
def _text_numbers(key: tuple) -> tuple[int, ...]:
    return tuple(_number(f"{kind}:{value}") for kind, value in zip(("size", "links", "end", "capitals", "first"), key))


def text_features(text: str, linked: int) -> tuple[int, ...]:
    size = len(text)
    capitals = sum(map(str.isupper, text[:80]))
    key = (size.bit_length(), min(4, 4 * linked // size), text[-1] in ".!?:;\"'", capitals > 24, text[0] if not text[0].isalnum() else "")
    return _text_numbers(key)


class Field:
    """Weights of features for label 1 against label 0, and of label pairs."""

    def __init__(self) -> None:
        self.weight = np.zeros(FEATURES)
        self.step = np.zeros((2, 2))

    def scores(self, features: list[np.ndarray]) -> list[float]:
        return [float(self.weight[f].sum()) for f in features]

    def learn(self, features: list[np.ndarray], labels: list[int], rate: float) -> None:
        """A step up the chain's log-likelihood, by forward and backward sums."""
        n = len(labels)
        own = np.zeros((n, 2))
        own[:, 1] = self.scores(features)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = own[0]
        for i in range(1, n):
            ahead[i] = own[i] + np.logaddexp(ahead[i - 1][0] + self.step[0], ahead[i - 1][1] + self.step[1])
        for i in range(n - 2, -1, -1):
            after = own[i + 1] + back[i + 1]
            back[i] = np.logaddexp(self.step[:, 0] + after[0], self.step[:, 1] + after[1])
        total = np.logaddexp(*ahead[-1])
        share = np.exp(ahead + back - total)[:, 1]
        pairs = np.zeros((2, 2))
        for i in range(1, n):
            joint = ahead[i - 1][:, None] + self.step + (own[i] + back[i])[None]
            pairs[labels[i - 1], labels[i]] += 1
            pairs -= np.exp(joint - total)
        for f, y, p in zip(features, labels, share):
            self.weight[f] += rate * ((y - p) - DECAY * self.weight[f])
        self.step += rate * (pairs / n - DECAY * self.step)

    def decode(self, scores: list[float]) -> list[int]:
        """The best chain of labels (Viterbi)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one, came = 0.0, scores[0], []
        for x in scores[1:]:
            a, b = zero + s00 >= one + s10, zero + s01 >= one + s11
            came.append((0 if a else 1, 0 if b else 1))
            zero, one = (zero + s00 if a else one + s10), (zero + s01 if b else one + s11) + x
        label = int(one > zero)
        out = [label]
        for step in reversed(came):
            label = step[label]
            out.append(label)
        return out[::-1]


def features_of(blocks: list[tuple[Node, str, int]]) -> list[np.ndarray]:
    return [np.array(node.features() + text_features(t, n)) for node, t, n in blocks]


def fit(pages: list[str]) -> Field:
    """Learn from pages that mark their article, and from the built-in ones."""
    data = []
    for page, name in PRIMER:
        blocks = blocks_of(page)
        data += [(features_of(blocks), [int(node.within(name) and not node.aside) for node, _, _ in blocks])] * 12
    for page in pages:
        blocks = blocks_of(page)
        labels = [node.label() for node, _, _ in blocks]
        if any(labels):
            data.append((features_of(blocks), labels))
    field, random = Field(), np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for i in random.permutation(len(data)):
            field.learn(*data[i], RATE / (1 + epoch))
    return field


def extract(page: str | None, field: Field) -> str:
    """The main text: blocks of label 1, joined by line ends."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    weight = field.weight
    path = _path_score(field)
    scores = [path(node) + sum(weight[i] for i in text_features(t, n)) for node, t, n in blocks]
    return "\n".join(b[1] for b, y in zip(blocks, field.decode(scores)) if y)


def _path_score(field: Field):
    known = field.__dict__.setdefault("_known", {})

    def score(node: Node) -> float:
        numbers = node.features()
        if numbers not in known:
            if len(known) > 20_000:
                known.clear()
            known[numbers] = float(sum(field.weight[i] for i in numbers))
        return known[numbers]

    return score


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows]))])], names=["model"])


def train(pages: DataFrame, html: str = "html", key: str = "page_id", max_pages: int = MAX_PAGES) -> Field:
    """Fit on at most ``max_pages`` pages that mark their article, those of least hash of the key."""
    marked = pages.filter(F.col(html).rlike("(?i)<(article|main)\\b"))
    rows = marked.select(F.xxhash64(F.col(key).cast("string"), F.length(html)).alias("h"), F.col(html).alias("page"))
    made = least(rows, max_pages).coalesce(1).mapInArrow(_fit_rows, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])


def _texts(sent):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [extract(page, field) for page in part.column(part.num_columns - 1).to_pylist()]
                names = part.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string())], names=[*names, "text"])

    return texts


def main_text(pages: DataFrame, field: Field, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all but the html by default) and ``text``."""
    carry = [c for c in (pages.columns if carry is None else carry) if c not in (html, "text")]
    rows = pages.select(*carry, F.col(html).alias("__html"))
    schema = type(rows.schema)(rows.schema.fields[:-1]).add("text", "string")
    return rows.mapInArrow(_texts(pages.sparkSession.sparkContext.broadcast(field)), schema)
