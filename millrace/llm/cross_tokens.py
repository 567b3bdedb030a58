"""Alignment of two tokenizers over whole texts, and corpus-wide counts of the tokens they put together.

Tokenizer A (byte-level) reads a blank and the text, B (sentence pieces) the
text, to which it adds that blank itself. Where a token of A and a token of B
end at the same byte the text is cut into groups, and those two tokens are a
link.

The end lists are intersected by galloping: the shorter list drives, and each
of its ends is looked for in the longer one in steps that double, then halve.
The common indices slice both lists into groups; their differences are how
many tokens of either side a group holds. Neither tokenizer has a token that
reaches across the place in front of a blank that follows something else, so
a text is cut there, and each distinct piece of a batch is encoded and
intersected once.

Counting goes by *parts*, runs of documents of bounded bytes. A part sends each
distinct pair of ids once with its number of links; pairs are summed (map-side
first), the highest count of each B id is found, and both go back to the part
by the pair's place in its list. Documents hold places, not pairs, so neither
texts nor tokens are shuffled, and a pair in every document is a row per part.

Null and empty texts, and texts whose joined token bytes differ from a blank
and the text (U+2581 in a text, for one), have no tokens: zeros, and an empty
digest. Rows are independent of each other: null or repeated ids and repeated
texts each keep their row. Equal counts are all highest. An empty table gives
no rows. Columns that are not asked for are not read, whatever their names. A
very long text is worked off in blocks of bounded bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import fields_of, lean, table_of, text_slices
from millrace.llm.tokens import BLANK, BLOCK_BYTES, Encoder, Memory, decimal_table, numbers_of, piece_starts, pieces_of, take_lists
from millrace.llm.words import text_buffers
from millrace.session import settle

PART_BYTES = 4 << 20  # of a part's texts; its last text may go beyond
SPACE_MARK = "▁"
ALIGNED = "part long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, times array<long>"
GROUPS = "doc_id long, a_ids array<long>, b_ids array<long>, a_ends array<long>, b_ends array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write a byte: as itself where that can be seen, else beyond 255 in turn."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """Ids of pieces by one tokenizer, and the bytes of every id."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.lengths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))


class SideA(Side):
    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        place, size = byte_of_char(), self.encoder.tokenizer.get_vocab_size()
        names = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(size)]
        super().__init__([bytes(place[c] for c in x) if all(c in place for c in x) else b"" for x in names])

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, bounds = self.encoder.encode(pa.array(pieces, pa.large_string()))
        return flat.astype(np.int64), np.diff(bounds)


class SideB(Side):
    """Sentence pieces. Special strings in a text are plain text, as the library has it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in names):
            raise ValueError("the vocabulary has a piece that reaches across a blank; texts cannot be cut there")
        byte = [self.model.is_byte(i) for i in range(len(names))]
        super().__init__([bytes([int(x[3:5], 16)]) if b else x.replace(SPACE_MARK, " ").encode() for x, b in zip(names, byte)])
        self.memory = Memory(self._work_out)
        self.blank = array("i", [names.index(SPACE_MARK)]).tobytes()

    def _work_out(self, pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), 20_000):
            coded = self.model.encode([p[1:] for p in pieces[at : at + 20_000]], num_threads=1)  # it adds the blank itself
            # a lone blank ends a text; without anything behind it the library adds none
            yield from (array("i", ids).tobytes() or self.blank for ids in coded)

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = numbers_of(self.memory.get(pieces), np.dtype(np.intc))
        return flat.astype(np.int64), n


def gallop(needles: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Place of the first end that is not less than each needle, from ``first`` to ``last`` (which is not less)."""
    low, high = first.copy(), first.copy()
    going = np.flatnonzero(ends[high] < needles)
    step = 1
    while len(going):  # double the steps
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, last[going])
        going = going[ends[high[going]] < needles[going]]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):  # then halve what is left
        middle = (low[going] + high[going]) // 2
        less = ends[middle] < needles[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def common_ends(a_ends: np.ndarray, n_a: np.ndarray, b_ends: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both lists of the ends they share. ``n_a``, ``n_b``: ends to each piece; a piece's last ends are equal."""
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    found = []
    for short, n, first, long, m, other in ((a_ends, n_a, a_first, b_ends, n_b, b_first), (b_ends, n_b, b_first, a_ends, n_a, a_first)):
        piece = np.flatnonzero((n <= m) & (n > 0)) if short is a_ends else np.flatnonzero((n < m) & (n > 0))
        count = n[piece]
        at = np.repeat(first[piece] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = gallop(short[at], np.repeat(other[piece], count), np.repeat(other[piece] + m[piece] - 1, count), long)
        same = long[place] == short[at]
        found.append((at[same], place[same]) if short is a_ends else (place[same], at[same]))
    a, b = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@dataclass
class Aligned:
    """Distinct pieces, aligned: lists by piece, end to end, and how long each piece's are."""

    good: np.ndarray
    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    a_of_group: np.ndarray  # tokens of A in each group
    b_of_group: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray  # id of A << 32 | id of B, for each group


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = SideA(a_path), SideB(b_path)
        self.decimals = pa.concat_arrays([decimal_table(len(self.a.lengths), ",|"), decimal_table(len(self.b.lengths), ",;")])

    def _same_bytes(self, side: Side, ids: np.ndarray, n: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the token bytes of each piece are the piece."""
        joined, bounds = text_buffers(side.bytes.take(pa.array(ids)))
        length = np.diff(np.concatenate([[0], bounds[np.cumsum(n)]]))
        good = length == size
        left, right = np.repeat(good, length), np.repeat(good, size)
        wrong = np.repeat(np.flatnonzero(good), size[good])[joined[left] != text[right]]
        good[wrong] = False
        return good

    def align(self, pieces: list[str]) -> Aligned:
        text, bounds = text_buffers(pa.array(pieces, pa.large_string()))
        size = np.diff(bounds)
        (a, n_a), (b, n_b) = self.a.ids(pieces), self.b.ids(pieces)
        good = self._same_bytes(self.a, a, n_a, text, size) & self._same_bytes(self.b, b, n_b, text, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        at_a, at_b = common_ends(np.cumsum(self.a.lengths[a]), n_a, np.cumsum(self.b.lengths[b]), n_b)
        n_groups = np.diff(np.searchsorted(at_a, np.concatenate([[0], np.cumsum(n_a)])))
        return Aligned(good, a, n_a, b, n_b, np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1), n_groups, a[at_a] << 32 | b[at_b])

    def written(self, x: Aligned) -> pa.Array:
        """Each piece's groups as ``a1,a2|b1;``: ids in decimal, A's before B's, group after group."""
        n_a, n_b, base = x.a_of_group, x.b_of_group, 2 * len(self.a.lengths)
        last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        last_a[np.cumsum(n_a) - 1] = 1
        last_b[np.cumsum(n_b) - 1] = 1
        group = np.arange(len(n_a))
        before_a, before_b = np.cumsum(n_b) - n_b, np.cumsum(n_a)  # tokens of the other side that stand in front
        out = np.empty(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + before_a[np.repeat(group, n_a)]] = 2 * x.a + last_a
        out[np.arange(len(x.b)) + before_b[np.repeat(group, n_b)]] = base + 2 * x.b + last_b
        data, bounds = text_buffers(self.decimals.take(pa.array(out)))
        cut = bounds[np.concatenate([[0], np.cumsum(x.n_a + x.n_b)])]
        return pa.Array.from_buffers(pa.large_binary(), len(x.good), [None, pa.py_buffer(cut), pa.py_buffer(data)])


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for a worker process."""
    return Aligner(a_path, b_path)


def with_blank(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with a blank in front of each that is not empty, and where they begin and end."""
    data, bounds = text_buffers(column)
    full = bounds[1:] > bounds[:-1]
    return np.insert(data, bounds[:-1][full], 0x20), bounds + np.concatenate([[0], np.cumsum(full)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


class Texts:
    """The texts of a slice, aligned piece by piece, in blocks of bounded bytes."""

    def __init__(self, of: Aligner, column: pa.Array, block_bytes: int = BLOCK_BYTES) -> None:
        data, bounds = with_blank(column)
        starts = piece_starts(data, bounds, BLANK) if len(data) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(starts, bounds)  # pieces before each text, and in all
        digests, made, links, at = Digests(self.bounds), [], [], 0
        for block in pieces_of(data, starts, block_bytes):
            x, which = of.align(block.distinct), block.which.to_numpy()
            made.append(np.stack([x.n_a, x.n_b, x.n_groups, ~x.good])[:, which])
            links.append(take_lists(x.links, x.n_groups, block.which))
            digests.add(at, *text_buffers(of.written(x).take(block.which)))
            at += len(which)
        made = np.concatenate(made, axis=1) if made else np.zeros((4, 0), np.int64)
        n_a, n_b, n_groups, bad = (_sums(row, self.bounds) for row in made)
        whole = bad == 0
        links = np.concatenate(links) if links else np.zeros(0, np.int64)
        self.links = links[np.repeat(whole, n_groups)]
        self.n_a, self.n_b, self.n_groups = (np.where(whole, n, 0) for n in (n_a, n_b, n_groups))
        self.digests = [d if n else "" for d, n in zip(digests.done, self.n_groups)]


class Digests:
    """Hashes of the written groups of each text, taken as blocks of pieces arrive."""

    def __init__(self, bounds: np.ndarray) -> None:
        self.bounds, self.open = bounds, {}
        self.done: list[str] = [""] * (len(bounds) - 1)

    def add(self, at: int, data: np.ndarray, ends: np.ndarray) -> None:
        """The written pieces from number ``at`` on; the ``;`` after a text's last group is left out."""
        n, view = len(ends) - 1, memoryview(np.ascontiguousarray(data))
        first = int(np.searchsorted(self.bounds, at, "right")) - 1
        last = int(np.searchsorted(self.bounds, at + n, "left"))
        lows, highs = np.maximum(self.bounds[first:last], at) - at, np.minimum(self.bounds[first + 1 : last + 1], at + n) - at
        finished = self.bounds[first + 1 : last + 1] <= at + n
        for text, a, b, over, any_piece in zip(range(first, last), ends[lows].tolist(), ends[highs].tolist(), finished.tolist(), (lows < highs).tolist()):
            if any_piece:
                digest = self.open.pop(text, None) or hashlib.sha256()
                digest.update(view[a : max(b - over, a)])
                if over:
                    self.done[text] = digest.hexdigest()
                else:
                    self.open[text] = digest


def _align(a_path: str, b_path: str, part_bytes: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, schema, part = aligner(a_path, b_path), fields_of(ALIGNED), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in text_slices(batch, 1, part_bytes):
                x, n = Texts(of, rows.column(1)), rows.num_rows
                coded = pa.array(x.links).dictionary_encode()
                places = coded.indices.to_numpy().astype("<u4")
                times = np.bincount(places, minlength=len(coded.dictionary))
                ends = (4 * np.concatenate([[0], np.cumsum(x.n_groups)])).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(places)])
                columns = [[part] * n, rows.column(0), x.n_a, x.n_b, x.n_groups, x.digests, packed, [None] * n, [None] * n]
                yield from table_of(ALIGNED, columns).to_batches()
                one = pa.array([0, len(times)], pa.int32())
                pairs = [pa.ListArray.from_arrays(one, v) for v in (coded.dictionary, pa.array(times, pa.int64()))]
                nothing = [pa.nulls(1, f.type) for f in schema][1:7]
                yield pa.RecordBatch.from_arrays([pa.array([part]), *nothing, *pairs], schema=schema)
                part += 1

    return align


def _judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts and highest counts of a part's pairs, summed over the links of each of its documents."""
    place = right.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
    data, bounds = text_buffers(left.column("links"))
    links, bounds = np.frombuffer(data.tobytes(), "<u4"), bounds // 4
    plain = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
    return table_of(RESULT, [*plain, _sums(best[links], bounds), _sums(count[links], bounds), left.column("groups_sha256")])


def _plain(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Per document: tokens of both sides, groups, links, how many of them are their B id's commonest, their counts' sum, a digest of the groups."""
    aligned = settle(_plain(docs, text, doc_id).mapInArrow(lean(_align(a_path, b_path, part_bytes)), ALIGNED), "aligned")
    lists = aligned.filter("pairs is not null").select("part", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x"))
    sent = lists.select("part", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    totals = sent.groupBy("pair").agg(F.sum("times").alias("n"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # at most a row for each id of A
    rated = totals.select("pair", "n", (F.col("n") == F.max("n").over(same_b)).alias("best"))
    answers = sent.select("part", "place", "pair").join(rated, "pair").select("part", "place", "n", "best")
    rows = aligned.filter("pairs is null").drop("pairs", "times")
    answers = answers.withColumnRenamed("part", "to_part")
    return rows.groupBy("part").cogroup(answers.groupBy("to_part")).applyInArrow(_judge, RESULT)


def _groups(a_path: str, b_path: str, slice_bytes: int):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        for batch in batches:
            for rows in text_slices(batch, 1, slice_bytes):
                out = [[] for _ in range(4)]
                for text in rows.column(1):
                    data, bounds = with_blank(pa.array([text.as_py()], pa.string()))
                    starts = piece_starts(data, bounds, BLANK) if len(data) else np.zeros(0, np.int64)
                    parts, whole = [], True
                    for block in pieces_of(data, starts):
                        x = of.align(block.distinct)
                        whole &= bool(x.good.all())
                        lists = ((x.a, x.n_a), (x.b, x.n_b), (x.a_of_group, x.n_groups), (x.b_of_group, x.n_groups))
                        parts.append([take_lists(flat, n, block.which) for flat, n in lists])
                    made = [np.concatenate(p) for p in zip(*parts)] if parts and whole else [np.zeros(0, np.int64)] * 4
                    for column, value in zip(out, (made[0], made[1], np.cumsum(made[2]), np.cumsum(made[3]))):
                        column.append(value)
                yield from table_of(GROUPS, [rows.column(0), *out]).to_batches()

    return groups


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: the ids of both sides, and for each group how many tokens of A and of B end with it or before."""
    return _plain(docs, text, doc_id).mapInArrow(lean(_groups(a_path, b_path, PART_BYTES)), GROUPS)
