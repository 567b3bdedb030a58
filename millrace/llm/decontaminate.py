"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a slice of documents in one task. Its words become numbers of the
benchmark's vocabulary (0: none), and only runs of such words that are long
enough for the shortest window stay, as nothing else can match. A suffix array
over them is sorted to the window's depth; every benchmark suffix is searched
in it, word by word, all suffixes at once. Windows that follow each other in
text and item join to the longest verbatim matches. Equal windows are met once
for all items that hold them, so repetitive texts and items cost no pairs.

A window is ``width`` consecutive words of an item; an item of fewer words,
but not none, is one window. Documents never shuffle, and no result leaves
its task but one row per document. The benchmark is sent in blocks of bounded
characters, one narrow pass each.

Null or empty texts have no words and match nothing. Repeated documents or
items each count. A null item id hits words but is no item in ``items``. An
empty benchmark hits nothing; an empty table gives no rows. Input columns of
the same names as the added ones are replaced. A very long text is a slice of
its own, and memory grows with its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.arrow import lean
from millrace.llm.words import ALNUM, words_of
from millrace.session import settle

WIDTH = 13
BLOCK_CHARS = 32_000_000
HIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]))
MATCH = "array<struct<item_id:string,item_start:int,start:int,n_words:int>>"
ADDED = f"n_words long, n_hit long, items array<string>, matches {MATCH}"


class Suffixes:
    """The benchmark's words as numbers, each item ended by 0, and its suffixes."""

    def __init__(self, ids: list, texts: list[str], width: int) -> None:
        self.width, self.ids = width, [None if i is None else str(i) for i in ids]
        hashes, items, places = [], [], []
        for words in words_of(pa.array(texts, pa.string()), ALNUM, True):
            hashes.append(words.hashes)
            items.append(words.text_of() + words.first)
            places.append(np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], words.counts))
        flat, of, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, items, places))
        self.vocabulary, number = np.unique(flat.astype(np.uint64), return_inverse=True)
        lengths = np.bincount(of.astype(np.int64), minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.words = np.zeros(int((lengths + 1).sum()) + width, np.int64)
        if len(of):
            self.words[starts[of] + place] = number + 1
        need = np.minimum(lengths, width)
        self.suffix = (starts[of] + place)[place + need[of] <= lengths[of]] if len(of) else np.zeros(0, np.int64)
        self.item = of[place + need[of] <= lengths[of]].astype(np.int64) if len(of) else np.zeros(0, np.int64)
        self.start, self.lengths = starts, lengths
        self.need = need[self.item] if len(of) else np.zeros(0, np.int64)
        self.shortest = int(self.need.min()) if len(self.need) else 0


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of non-zero words, sorted by their next ``depth`` words at least (prefix doubling)."""
    n = len(words)
    rank = words.astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] if step < n else 0
        after[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        rank += int(words.min() > 0)  # 0 stays what has no word
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[words[order] > 0]


def search(words: np.ndarray, order: np.ndarray, query: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the benchmark that occurs to its window's length: itself, and its part of the order."""
    lead = np.concatenate([words, np.zeros(query.width + 1, np.int64)])
    which = np.arange(len(query.suffix))
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    found = []
    for depth in range(query.width):
        target = query.words[query.suffix[which] + depth]
        low, high = (_bisect(lead, order, low, high, target, depth, right) for right in (False, True))
        live = low < high
        which, low, high = which[live], low[live], high[live]
        done = query.need[which] == depth + 1
        found.append((which[done], low[done], high[done]))
        which, low, high = which[~done], low[~done], high[~done]
        if not len(which):
            break
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (which, low, high)


def _bisect(lead, order, low, high, target, depth, right):
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        value = lead[order[mid] + depth]
        up = value <= target[open_] if right else value < target[open_]
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]
        open_ = open_[low[open_] < high[open_]]
    return low


def long_runs(numbers: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` non-zero numbers inside one text: their words, each run ended by 0, and the places."""
    inside = np.concatenate([[False], numbers > 0, [False]])
    cut = np.zeros(len(numbers) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    keep = end - start >= least
    start, end = start[keep], end[keep]
    length = end - start + 1
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - start, length)
    last = np.cumsum(length) - 1
    at_safe = np.minimum(at, max(len(numbers) - 1, 0))
    words = numbers[at_safe] if len(at) else np.zeros(0, np.int64)
    words[last] = 0
    return words, at


@dataclass
class Slice:
    """What a slice of texts has: words inside windows, and by text the items and longest matches."""

    first: int
    bounds: np.ndarray  # words before each text, and in all
    hit: np.ndarray  # of each word
    items: dict[int, set[int]]  # by text, for those that have any
    matches: tuple[np.ndarray, ...]  # text, item, place in the item, place in the text, words


def find(column: pa.Array, query: Suffixes, with_matches: bool = True) -> Iterator[Slice]:
    """The benchmark's windows in the texts, by slices.

    Equal windows are met once, however many items hold them: their part of the
    suffix array marks the words, and texts meet whole sets of items. Only the
    longest matches go by item, with one place of a window in each.
    """
    for words in words_of(column, ALNUM, True):
        out = Slice(words.first, words.bounds, np.zeros(len(words.hashes), bool), {}, tuple(np.zeros(0, np.int64) for _ in range(5)))
        if query.shortest:
            at = np.searchsorted(query.vocabulary, words.hashes)
            at[at == len(query.vocabulary)] = 0
            numbers = np.where(query.vocabulary[at] == words.hashes, at + 1, 0)
            kept, places = long_runs(numbers, words.bounds, query.shortest)
            if len(kept):
                order = suffix_array(kept, query.width)
                found = search(kept, order, query)
                if len(found[0]):
                    _meet(out, places[order], *found, query, with_matches)
        yield out


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first`` and the ``n - 1`` numbers after it, for each, end to end."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _meet(out: Slice, spots: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, query: Suffixes, with_matches: bool) -> None:
    item, need = query.item[which], query.need[which]
    there = query.suffix[which] - query.start[item]
    order = np.lexsort((there, item, need, low))
    item, there, need, low, high = (x[order] for x in (item, there, need, low, high))
    new = np.ones(len(low), bool)  # windows that are equal have one part of the order
    new[1:] = (low[1:] != low[:-1]) | (need[1:] != need[:-1])
    group = np.cumsum(new) - 1
    pair = new.copy()  # a window in an item, at its first place there
    pair[1:] |= item[1:] != item[:-1]
    heads, pairs = np.flatnonzero(new), np.flatnonzero(pair)
    again = np.diff(np.append(pairs, len(low))) > 1
    items, first_pair = item[pairs], np.searchsorted(group[pairs], np.arange(len(heads)))
    n_items = np.diff(np.append(first_pair, len(pairs)))

    n = high[heads] - low[heads]
    place, of = spots[_spread(low[heads], n)], np.repeat(np.arange(len(heads)), n)
    ends = np.bincount(place, minlength=len(out.hit) + 1) - np.bincount(place + need[heads][of], minlength=len(out.hit) + 1)
    out.hit[:] = np.cumsum(ends)[:-1] > 0
    text = np.searchsorted(out.bounds, place, "right") - 1

    # windows of one passage mostly share their items: a text meets each set of items once
    known: dict[bytes, int] = {}
    sets = [items[a : a + k] for a, k in zip(first_pair.tolist(), n_items.tolist())]
    named = np.array([known.setdefault(x.tobytes(), len(known)) for x in sets])
    members = {}
    for name, x in zip(named.tolist(), sets):
        members.setdefault(name, x.tolist())
    met = np.unique(text * len(known) + named[of])
    for t, name in zip((met // len(known)).tolist(), (met % len(known)).tolist()):
        out.items.setdefault(t, set()).update(members[name])

    if with_matches:
        k = n_items[of]
        at = _spread(first_pair[of], k)
        rows = [np.repeat(text, k), items[at], there[pairs][at], np.repeat(place, k), need[pairs][at], again[at]]
        out.matches = _longest(rows, query.lengths, out.bounds)


def _longest(rows: list[np.ndarray], lengths: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of one text and item, word after word in both, are one match; one that the item repeats follows any."""
    order = np.lexsort((rows[3], rows[1], rows[0]))
    text, item, there, place, need, again = (x[order] for x in rows)
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(place) != 1) | ((np.diff(there) != 1) & ~again[1:] & ~again[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    length = np.minimum(place[last] - place[first] + need[first], lengths[item[first]])
    return text[first], item[first], there[first], place[first] - bounds[text[first]], length


def _n_blocks(rows: DataFrame, block_chars: int) -> int:
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    return max(1, -(-chars // block_chars))


def _block(rows: DataFrame, n: int, k: int) -> tuple[list, list]:
    """One block of the items, about ``block_chars`` characters; copies of an item are dealt to all blocks."""
    salt = F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(n))
    part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t") + salt, F.lit(n)) == k)
    got = sorted(map(tuple, part.select("i", "t").collect()), key=lambda r: (r[0] or "", r[1]))
    return [r[0] for r in got], [r[1] for r in got]


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_chars: int = BLOCK_CHARS, carry: list[str] | None = None, matches: bool = True,
) -> DataFrame:
    """Add n_words, n_hit (words inside any occurrence of a window), items and (if asked) matches to each document.

    ``carry``: the input columns to return (all by default); the text itself is read either way. A
    benchmark of several blocks takes a written pass each, and one block's arrays are sent at a time.
    """
    spark = docs.sparkSession
    added = T._parse_datatype_string(ADDED if matches else ADDED.rpartition(", matches")[0])
    carry = [c for c in (docs.columns if carry is None else carry) if c not in T._parse_datatype_string(ADDED).names]
    df = docs.select(*carry, F.col(text).alias("__text"))
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    n = _n_blocks(rows, block_chars)
    rows = settle(rows, "benchmark") if n > 1 else rows
    for k in range(n):
        last = k == n - 1
        sent = spark.sparkContext.broadcast(Suffixes(*_block(rows, n, k), width))
        kept = [f for f in df.schema.fields if f.name in carry or not last and f.name == "__text"]
        schema = T.StructType(kept + added.fields + ([] if last else [T.StructField("__hit", HIT)]))
        df = df.mapInArrow(lean(_scan(sent, [f.name for f in kept], to_arrow_schema(schema), matches)), schema)
        if not last:
            df = settle(df, "benchmark-block")
            sent.destroy()
    return df


def _runs(hit: np.ndarray) -> list[dict]:
    """Stretches of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    return [{"start": a, "n": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _scan(sent, kept: list[str], schema: pa.Schema, with_matches: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = sent.value
        for batch in batches:
            names = batch.schema.names
            before = {c: batch.column(names.index(c)).to_pylist() for c in ("items", "matches", "__hit") if "__hit" in names and c in names}
            counts, hits, items, spans, stretches = [], [], [], [], []
            for part in find(batch.column(names.index("__text")), query, with_matches):
                n = len(part.bounds) - 1
                found = [{query.ids[i] for i in part.items[t]} - {None} if t in part.items else () for t in range(n)]
                texts: list[list] = [[] for _ in range(n)]
                for t, i, a, b, size in zip(*(x.tolist() for x in part.matches)):
                    texts[t].append({"item_id": query.ids[i], "item_start": a, "start": b, "n_words": size})
                for t in range(n if before else 0):
                    found[t] = {*found[t], *before["items"][part.first + t]}
                    texts[t] += before.get("matches", {part.first + t: []})[part.first + t]
                    for x in before["__hit"][part.first + t]:
                        part.hit[part.bounds[t] + x["start"] : part.bounds[t] + x["start"] + x["n"]] = True
                total = np.concatenate([[0], np.cumsum(part.hit)])[part.bounds]
                counts.append(np.diff(part.bounds))
                hits.append(np.diff(total))
                items += [sorted(x) for x in found]
                spans += texts
                if "__hit" in schema.names:
                    stretches += [_runs(part.hit[a:b]) for a, b in zip(part.bounds, part.bounds[1:])]
            made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, hits)]
            made += [items] + [spans] * with_matches + [stretches] * ("__hit" in schema.names)
            made = [pa.array(c, schema.field(len(kept) + i).type) for i, c in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in kept] + made, schema=_like(batch, kept, schema))

    return scan


def _like(batch: pa.RecordBatch, kept: list[str], schema: pa.Schema) -> pa.Schema:
    """The schema with the kept columns' types as they came."""
    fields = [pa.field(c, batch.schema.field(c).type) for c in kept]
    return pa.schema(fields + list(schema)[len(kept) :])


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes with an added one
    found = find_matches(docs.withColumnsRenamed(inner), benchmark, text=inner[text], matches=False, **options)
    return found.filter(~contaminated()).select(*inner.values()).withColumnsRenamed({v: k for k, v in inner.items()})
