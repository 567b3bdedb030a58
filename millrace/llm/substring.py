"""Removal of repeated passages: a count-min prefilter, then exact groups.

A window is ``width`` consecutive words of one document. A word goes if a
window over it also starts in a document with a smaller id.

The texts are written once as *parts* of bounded bytes, in a bucketed table,
so that later passes meet their answers without moving text. Parts are cut by
the running bytes of the rows that a task reads, however they are stored. Windows are
dealt out over *shards* by their hash; a shard is a bounded share of the hash
space, and there are more of them for more text.

1. Each part sketches its windows: for each shard, the cells of a two-row
   count-min sketch, as gaps of sorted cell numbers (about ten bits a cell), no cell more than twice. Merging adds the parts' cells up in each shard and
   answers one bit for each cell sent: met at least twice or not. Estimates
   never fall short, so no repeated window is lost.
2. Only windows whose cells were all met twice are sent with 128 bits of hash
   and their least document. A shard groups them exactly and answers one bit
   each: whether a smaller document has the window elsewhere.

A part sends a window once, however often it holds it, so a passage in a third
of all documents is one entry a part.

Null texts have no words. A document without id counts as larger than all
others; such documents do not make each other lose words. Equal ids never
make each other lose words. Order of input rows does not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.arrow import lean_cogroup, lean_group, table_of
from millrace.llm.words import NOT_SPACE, Words, join_words, mix, words_of
from millrace.session import settle

WIDTH = 13
PART_BYTES = 2 << 20  # of a part's rows; its last row may go beyond
ROW_BYTES = 64  # that a row counts besides its texts
SHARD_BYTES = 24 << 20  # of text to a shard: some four million windows
CELL_BITS = 24
NO_ID = np.iinfo(np.int64).max
TEXTS = (pa.string(), pa.large_string(), pa.binary(), pa.large_binary())
ASKED = "part long, shard int, first binary, second binary"
CANDIDATES = "part long, shard int, hashes binary, others binary, docs binary"
ANSWER = "part long, shard int, step int, first binary, second binary"


def pack(cells: np.ndarray) -> bytes:
    """Sorted numbers as gaps: low bytes as they are, the rest of a gap as that many 0 bits and a 1."""
    gaps = np.diff(cells, prepend=cells.dtype.type(0)).astype(np.int64)
    mean = int(cells[-1]) // len(gaps)
    low = 1 if mean < 1 << 11 else 2 if mean < 1 << 19 else 3
    ends = np.cumsum((gaps >> 8 * low) + 1)
    high = np.zeros(int(ends[-1]), np.uint8)
    high[ends - 1] = 1
    lows = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :low].T  # byte by byte
    return np.array([len(gaps), low], "<u4").tobytes() + lows.tobytes() + np.packbits(high).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, low = np.frombuffer(data, "<u4", 2).tolist()
    lows = np.frombuffer(data, np.uint8, n * low, 8).reshape(low, n).astype(np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + n * low)))
    gaps = np.diff(ends, prepend=-1) - 1
    for i in range(low - 1, -1, -1):
        gaps = (gaps << 8) | lows[i]
    return np.cumsum(gaps).astype(np.uint32)


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    """All arrays as one; the list is emptied, so that they do not stand beside it for longer than needed."""
    out = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    arrays.clear()
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Part:
    """The windows of a part: each distinct one with its least and greatest document."""

    def __init__(self, table: pa.Table, shard_bits: int, width: int, chains: int, places: bool = False) -> None:
        ids = table.column("__id").to_numpy().astype(np.int64)
        self.slices: list[Words] = []  # kept only where words are taken out
        self.width, self.n_words = width, 0
        docs, at, hashes, others = [], [], [], []
        for words in words_of(table.column("__text"), NOT_SPACE, False):
            found = words.windows(width, chains)
            docs.append(ids[found[0] + words.first])
            hashes.append(found[2])
            if places:
                at.append((found[1] + self.n_words).astype(np.int32 if self.n_words < 1 << 30 else np.int64))
                words.hashes = words.hashes[:0]
                self.slices.append(words)
            if chains == 2:
                others.append(found[3])
            self.n_words += len(words.starts)
        flat = _joined(hashes, np.uint64)
        kind = np.int32 if len(flat) < 1 << 31 else np.int64
        order = np.argsort(flat).astype(kind)
        ordered = flat[order]
        del flat
        self.new = np.ones(len(ordered), bool)
        self.new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(self.new).astype(kind)
        self.hashes = ordered[starts]
        del ordered
        doc = _joined(docs, np.int64)[order]
        self.least = np.minimum.reduceat(doc, starts) if len(starts) else doc
        self.most = np.maximum.reduceat(doc, starts) if len(starts) else doc
        self.others = _joined(others, np.uint64)[order[starts]] if chains == 2 else None
        self.at, self.doc = (_joined(at, np.int32)[order], doc) if places else (None, None)
        shard = (self.hashes >> np.uint64(64 - shard_bits)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange((1 << shard_bits) + 1))
        self.shards = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        self.shard_bits = shard_bits

    def cells(self, where: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells in both rows with a repeat for windows of several documents; the second row's order; places of first entries."""
        h = self.hashes[where]
        times = 1 + (self.least[where] != self.most[where])
        low = np.uint32((1 << CELL_BITS) - 1)
        first = ((h >> np.uint64(64 - self.shard_bits - CELL_BITS)).astype(np.uint32)) & low
        second = mix(h).astype(np.uint32) & low
        order = np.argsort(second, kind="stable")
        return np.repeat(first, times), np.repeat(second[order], times[order]), order, times

    def candidates(self, answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """Which distinct windows have cells met twice in both rows."""
        maybe = np.zeros(len(self.hashes), bool)
        for s, where in self.shards:
            _, _, order, times = self.cells(where)
            n = int(times.sum())
            one = from_bits(answers[s][0], n)[np.cumsum(times) - times]
            ordered = times[order]
            two = np.empty(len(order), bool)
            two[order] = from_bits(answers[s][1], n)[np.cumsum(ordered) - ordered]
            maybe[where] = one & two
        return maybe


def _sketch(shard_bits: int, width: int):
    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        part = Part(table, shard_bits, width, 1)
        rows = [(s, *map(pack, part.cells(where)[:2])) for s, where in part.shards]
        return table_of(ASKED, [[key[0].as_py()] * len(rows), *zip(*rows)] if rows else [[]] * 4)

    return sketch


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Add up the sketches of a shard; which of each part's cells were met twice or more."""
    out = []
    for name in ("first", "second"):
        rows = [unpack(x.as_py()) for x in table.column(name)]
        cells = np.sort(np.concatenate(rows))
        met = np.zeros(1 << CELL_BITS, bool)
        met[cells[1:][cells[1:] == cells[:-1]]] = True
        out.append([bits(met[r]) for r in rows])
    n = table.num_rows
    return table_of(ANSWER, [table.column("part").to_pylist(), table.column("shard").to_pylist(), [1] * n, *out])


def _answers(table: pa.Table, step: int) -> dict[int, tuple[bytes, bytes]]:
    names = ("shard", "step", "first", "second")
    return {s: (a, b) for s, k, a, b in zip(*(table.column(c).to_pylist() for c in names)) if k == step}


def _candidates(shard_bits: int, width: int):
    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left, shard_bits, width, 2)
        maybe = part.candidates(_answers(right, 1))
        rows = []
        for s, where in part.shards:
            m = maybe[where]
            if m.any():
                rows.append((s, *(x[where][m].tobytes() for x in (part.hashes, part.others, part.least))))
        return table_of(CANDIDATES, [[key[0].as_py()] * len(rows), *zip(*rows)] if rows else [[]] * 5)

    return send


def _exact(key: tuple, table: pa.Table) -> pa.Table:
    """Group a shard's candidates by all 128 bits; which of each part's have a smaller document elsewhere."""
    kinds = (("hashes", np.uint64), ("others", np.uint64), ("docs", np.int64))
    rows = [[np.frombuffer(x.as_py(), kind) for x in table.column(c)] for c, kind in kinds]
    h, g, d = (np.concatenate(x) for x in rows)
    order = np.lexsort((d, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    least = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.empty(len(h), bool)
    smaller[order] = least < d[order]
    ends = np.cumsum([len(x) for x in rows[0]])
    flags = [bits(f) for f in np.split(smaller, ends[:-1])]
    n = table.num_rows
    return table_of(ANSWER, [table.column("part").to_pylist(), table.column("shard").to_pylist(), [2] * n, flags, [b""] * n])


def _remove(shard_bits: int, width: int, schema: pa.Schema, keep_layout: bool):
    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left, shard_bits, width, 1, places=True)
        maybe = part.candidates(_answers(right, 1))
        elsewhere = np.zeros(len(maybe), bool)
        second = _answers(right, 2)
        for s, where in part.shards:
            m = np.flatnonzero(maybe[where]) + where.start
            if len(m):
                elsewhere[m] = from_bits(second[s][0], len(m))
        group = np.cumsum(part.new) - 1
        gone = maybe[group] & (elsewhere[group] | (part.doc > part.least[group]))
        starts = part.at[gone]
        cover = np.bincount(starts, minlength=part.n_words + 1)
        cover -= np.bincount(starts + width, minlength=part.n_words + 1)[: part.n_words + 1]
        kept = np.cumsum(cover, out=cover)[: part.n_words] == 0
        texts, n_words, n_removed, shift = [], [], [], 0
        for words in part.slices:
            k = kept[shift : shift + len(words.starts)]
            shift += len(words.starts)
            joined = join_words(words, k)
            lost = np.concatenate([[0], np.cumsum(~k)])[words.bounds]
            texts.append(joined)
            n_words.append(words.counts)
            n_removed.append(np.diff(lost))
        n_removed = np.concatenate(n_removed)
        text = pa.chunked_array(texts, pa.large_string()).combine_chunks()
        if keep_layout:
            old = left.column("__text").combine_chunks().cast(pa.large_string())
            text = pa.compute.if_else(pa.array(n_removed > 0), text, old)
        made = {"text": text, "n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(n_removed)}
        columns = [made[f.name.removeprefix("__made_")] if f.name.startswith("__made_") else left.column(f.name) for f in schema]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return remove


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, carry: list[str] | None = None,
    keep_layout: bool = False, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Documents without their repeated words, and how many they had and lost (n_words, n_removed).

    Kept words are joined by one blank; with ``keep_layout`` a text that loses
    nothing stays as it is. ``carry``: other columns to return (all by default).
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (text, "n_words", "n_removed")]
    table, shard_bits = _stage(docs, text, doc_id, carry, part_bytes, shard_bytes)
    parts = spark.table(table)
    read = parts.select("__part", "__id", "__text")
    asked = read.groupBy("__part").applyInArrow(lean_group(_sketch(shard_bits, width)), ASKED)
    met = settle(asked.groupBy("shard").applyInArrow(lean_group(_merge), ANSWER), "met-twice")
    sent = read.groupBy("__part").cogroup(met.groupBy("part")).applyInArrow(lean_cogroup(_candidates(shard_bits, width)), CANDIDATES)
    judged = settle(sent.groupBy("shard").applyInArrow(lean_group(_exact), ANSWER), "smaller-elsewhere")
    schema = T.StructType(
        [T.StructField("__made_text", T.StringType()) if c == text else docs.schema[c] for c in docs.columns if c in (text, *carry)]
        + [T.StructField(f"__made_{c}", T.LongType()) for c in ("n_words", "n_removed")]
    )
    out = parts.groupBy("__part").cogroup(met.unionAll(judged).groupBy("part"))
    out = out.applyInArrow(lean_cogroup(_remove(shard_bits, width, to_arrow_schema(schema), keep_layout)), schema)
    return out.withColumnsRenamed({"__made_text": text, "__made_n_words": "n_words", "__made_n_removed": "n_removed"})


def _number_parts(part_bytes: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = np.full(batch.num_rows, ROW_BYTES, np.int64)
            for column in batch.columns:
                if column.type in TEXTS:
                    size += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(size)
            part = pa.array(first + (ends - size) // part_bytes)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["__part", *batch.schema.names])

    return number


def _stage(docs: DataFrame, text: str, doc_id: str, carry: list[str], part_bytes: int, shard_bytes: int) -> tuple[str, int]:
    """Write the parts as a bucketed table; its name, and the number of shards as a power of two."""
    spark = docs.sparkSession
    size = Observation()
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("__id"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
        *carry,
    ).observe(size, F.sum(F.octet_length("__text")).alias("n"))
    rows = rows.mapInArrow(_number_parts(part_bytes), T.StructType([T.StructField("__part", T.LongType()), *rows.schema.fields]))
    name = f"millrace_parts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "__part").format("parquet").saveAsTable(name)
    shards = max(16, -(-(size.get["n"] or 0) // shard_bytes))
    return name, (shards - 1).bit_length()
