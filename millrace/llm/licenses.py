"""License scan: short notices found in whole texts although they are misspelt.

Texts are read as words in small letters, one blank between them, so line
breaks, capitals and punctuation do not hide a notice. A notice that may have
k edits is split into k + 1 seeds; whatever k edits do, one seed stays exact
(pigeonhole), so the places of exact seeds are all the places where the notice
can be. One pass of an automaton over a slice of texts finds the seeds of all
notices; the regex library's bounded-error matching then looks at the few
characters around each, and its edits and span are reported. Words of at most
three characters must be exact, or every "it licence" would be one of MIT.

A place where a notice's words stand consecutively is found on the same way,
by its seeds, and checked by comparison, so none is missed and places that
overlap count each. Other matches of one notice do not overlap each other or
an exact place.

Null and empty texts have no words: zeros, null places and a score of 0.
Repeated rows and ids each keep their row; an empty table gives no rows.
Columns to carry keep their names; those that clash with a column made here
are replaced by it. A very long text is a slice of its own; work and memory
grow with its bytes. Two notices at one place are both reported, but for a
match inside one of another notice with fewer edits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import lean
from millrace.llm.words import ALNUM, Words, words_of

SHORT_WORD = 3
TEXT_BREAK = 0x0A  # stands between texts; no seed and no word has it
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

# Phrases that are always counted, word by word.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of our own, with their labels.
OWN = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "boost",
}


@dataclass(frozen=True)
class Notice:
    text: str  # words in small letters, one blank between them
    label: str
    edits: int
    base: bool = False  # whether its exact places are counted

    def seeds(self) -> list[tuple[int, str]]:
        """One more piece than edits, of about equal length, with their places."""
        cuts = [round(i * len(self.text) / (self.edits + 1)) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def edits_for(text: str) -> int:
    """An edit for every eight characters: seeds keep at least four."""
    return len(text) // 8


NOTICES = tuple(
    [Notice(t, label, edits_for(t), True) for t, label in BASE.items()] + [Notice(t, label, edits_for(t)) for t, label in OWN.items()]
)


def latin(text: str) -> str:
    """The text's bytes as characters, so that places are places of bytes."""
    return text.encode().decode("latin-1")


@dataclass
class Match:
    notice: int
    word: int  # first and last word within the text
    last: int
    edits: int


class Scanner:
    def __init__(self, notices: Sequence[Notice]) -> None:
        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        owners = defaultdict(list)
        for i, notice in enumerate(notices):
            for place, seed in notice.seeds():
                owners[latin(seed)].append((i, len(latin(notice.text[:place]))))
        for seed, own in owners.items():
            self.automaton.add_word(seed, (len(seed), own))
        self.automaton.make_automaton()
        self.bytes = [len(n.text.encode()) for n in notices]
        self.plain = [latin(n.text) for n in notices]
        # whole words, as close as can be; the best match of the characters at hand
        self.patterns = [
            regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.text, special_only=True, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") for n in notices
        ]
        self.short_words = [[w for w in n.text.split(" ") if len(w) <= SHORT_WORD] for n in notices]

    def scan(self, words: Words) -> list[tuple[int, list[Match]]]:
        """Matches of the texts of a slice that have any, by text."""
        if not len(words.starts):
            return []
        data, first = self._joined(words)
        text = data.tobytes().decode("latin-1")
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, own) in self.automaton.iter(text):
            for notice, place in own:
                starts[notice].add(end + 1 - size - place)
        found = defaultdict(list)
        for notice, places in starts.items():
            for match in self._verify(notice, np.array(sorted(places)), data, text, first):
                found[int(np.searchsorted(words.bounds, match.word, "right")) - 1].append(match)
        out = []
        for t in sorted(found):
            shift = int(words.bounds[t])
            out.append((t, [Match(m.notice, m.word - shift, m.last - shift, m.edits) for m in _closest(found[t])]))
        return out

    def _joined(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All words in small letters, a blank between them and a break between texts; where each begins.

        A break stands in front as well, so that every word has a byte before it.
        """
        lengths = words.ends - words.starts + 1
        places = 1 + np.cumsum(lengths) - lengths
        size = int(lengths.sum())
        at = np.arange(size) + np.repeat(words.starts - (places - 1), lengths)
        at[places + lengths - 2] = 0
        data = np.empty(size + 1, np.uint8)
        data[1:] = FOLD[words.data[at]]
        data[places + lengths - 1] = 0x20
        data[0] = TEXT_BREAK
        lasts = words.bounds[1:][words.counts > 0] - 1
        data[(places + lengths - 1)[lasts]] = TEXT_BREAK
        return data, places

    def _verify(self, n: int, places: np.ndarray, data: np.ndarray, text: str, first: np.ndarray) -> Iterator[Match]:
        notice, size, plain = self.notices[n], self.bytes[n], self.plain[n]
        n_words = notice.text.count(" ") + 1
        exact = []
        for place in places.tolist():
            if place > 0 and text.startswith(plain, place) and text[place - 1] in " \n" and text[place + size] in " \n":
                exact.append(place)
                word = int(np.searchsorted(first, place))
                yield Match(n, word, word + n_words - 1, 0)
        if not notice.edits:
            return
        # each insertion or removal moves the start by at most four bytes; windows that overlap are looked at as one
        reach = 4 * notice.edits
        windows, taken = _merged(places, reach, size), np.array(exact, np.int64)
        done = -1
        for low, high in windows:
            near = taken[(taken > low - size - 1) & (taken < high + size)]
            for a, b in _without(max(low, 1), min(high, len(data) - 1), near, size):
                a, b = max(a, done), b
                for found in self._fuzzy(n, data, a, b):
                    done = max(done, found[1] + 1)
                    word = int(np.searchsorted(first, found[0]))
                    yield Match(n, word, int(np.searchsorted(first, found[1])) - 1, found[2])

    def _fuzzy(self, n: int, data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Matches with edits between two places, cut to whole words: start, end, edits."""
        raw = data[low:high].tobytes()
        # do not begin or end within a word or a text
        if low and data[low - 1] not in (0x20, TEXT_BREAK):
            cut = min((i for i in (raw.find(b" "), raw.find(b"\n")) if i >= 0), default=len(raw))
            raw, low = raw[cut + 1 :], low + cut + 1
        at = 0
        for piece in raw.split(b"\n"):
            start, text = low + at, piece.decode("utf-8", "replace")
            at += len(piece) + 1
            while len(text) + self.notices[n].edits >= len(self.notices[n].text):
                m = self.patterns[n].search(text)
                if m is None:
                    break
                own = m.group().split(" ")
                a, b = m.start(), m.end()
                left = len(text[:a].encode())
                if b > a and _in_order(self.short_words[n], own) and m.group() != self.notices[n].text:
                    yield start + left, start + left + len(m.group().encode()), sum(m.fuzzy_counts)
                step = b if b > a else a + 1
                start, text = start + len(text[:step].encode()), text[step:]


def _closest(matches: list[Match]) -> list[Match]:
    """Matches by place, without those that lie inside a match of another notice with fewer edits."""
    matches = sorted(matches, key=lambda m: (m.word, -m.last, m.edits, m.notice))
    out: list[Match] = []
    around: list[Match] = []  # earlier ones that reach as far
    for m in matches:
        around = [x for x in around if x.last >= m.word]
        if not any(x.last >= m.last and x.edits < m.edits for x in around):
            out.append(m)
            around.append(m)
    return sorted(out, key=lambda m: (m.word, m.notice))


def _in_order(short: list[str], own: list[str]) -> bool:
    """Whether all short words of a notice stand among the matched words, in order."""
    rest = iter(own)
    return all(word in rest for word in short)


def _merged(places: np.ndarray, reach: int, size: int) -> list[tuple[int, int]]:
    """Windows around possible starts; starts within reach of each other share one, of bounded length."""
    out: list[list[int]] = []
    for place in places.tolist():
        if out and place - out[-1][2] <= reach and place - out[-1][3] <= size:
            out[-1][1], out[-1][2] = place + size + reach, place
        else:
            out.append([place - reach, place + size + reach, place, place])
    return [(a, b) for a, b, _, _ in out]


def _without(low: int, high: int, exact: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """What is left of a window beside the exact places in it."""
    for place in exact.tolist():
        if place - 1 > low:
            yield low, min(place - 1, high)
        low = max(low, place + size + 1)
    if high > low:
        yield low, high


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    """One scanner for a worker process."""
    return Scanner(notices)


SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("edits", T.IntegerType()), T.StructField("found", T.StringType()),
    ]
)
MADE = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_base", T.LongType()), T.StructField("last_base", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN)),
    ]
)
ARROW_SPAN = pa.struct(
    [
        ("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("found", pa.string()),
    ]
)
NOTHING = (0, None, None, [], [], 0.0, [])
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(ARROW_SPAN)]


def _row(notices: Sequence[Notice], words: Words, text: int, matches: list[Match]) -> tuple:
    """What a text with matches has, as columns of ``MADE`` after the number of words."""
    whole = words.data[words.text_bounds[text] : words.text_bounds[text + 1]].tobytes()
    shift = int(words.text_bounds[text])
    chars = np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)  # code points up to each byte, itself included
    spans = []
    for m in matches:
        n = notices[m.notice]
        a = int(words.starts[words.bounds[text] + m.word]) - shift
        b = int(words.ends[words.bounds[text] + m.last]) - shift
        spans.append((n.label, n.text, m.word, m.last, int(chars[a]) - 1, int(chars[b - 1]), m.edits, whole[a:b].decode("utf-8", "replace")))
    base = [m for m in matches if notices[m.notice].base and m.edits == 0]
    score = max(1.0 - m.edits / len(notices[m.notice].text) for m in matches)
    first, last = (min(m.word for m in base), max(m.word for m in base)) if base else (None, None)
    labels = sorted({notices[m.notice].label for m in matches})
    names = [f.name for f in ARROW_SPAN]
    return len(base), first, last, sorted({notices[m.notice].label for m in base}), labels, score, [dict(zip(names, s)) for s in spans]


def _scan(notices: tuple[Notice, ...], n_carried: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scanner(notices)
        for batch in batches:
            counts, rows = np.zeros(batch.num_rows, np.int64), [NOTHING] * batch.num_rows
            for words in words_of(batch.column(0), ALNUM, True):
                counts[words.first : words.first + words.n_texts] = words.counts
                for text, matches in of.scan(words):
                    rows[words.first + text] = _row(notices, words, text, matches)
            made = [pa.array(c, k) for c, k in zip((counts, *zip(*rows)) if rows else [[]] * 8, KINDS)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(1 + i) for i in range(n_carried)), *made], names=[*batch.schema.names[1:], *MADE.fieldNames()]
            )

    return scan


def scan_licenses(
    docs: DataFrame, notices: Sequence[Notice] = NOTICES, text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """Documents with their words, exact places of base notices, labels, score and spans.

    A span has its label, notice, words, characters in the original text (end
    not included), edits and the original characters. ``score`` is the best
    match's share of characters without an edit. No shuffle.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (text, *MADE.fieldNames())]
    schema = T.StructType([*(docs.schema[c] for c in carry), *MADE])
    return docs.select(F.col(text).alias("__text"), *carry).mapInArrow(lean(_scan(tuple(notices), len(carry))), schema)
