"""Packing of documents into sequences along a Hilbert curve.

A document's vector counts its hashed tokens; a fixed random projection takes
it to four dimensions, each cut into bins by its mean and spread over all
documents. The bins' place on the Hilbert curve is the document's key: near
keys mean like vectors. Documents are range-sorted by key, laid end to end,
and cut at every multiple of the sequence length, so neighbours on the curve
share sequences and only the last sequence has padding.

Order and lengths are worked out on narrow rows; the ids move once, to meet
their offsets. Each range of the order reports one token count.

Null texts are empty: they have the end id alone. Ties of the key go by id,
then by row. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import fields_of, lean, text_slices
from millrace.llm.tokens import encoder, packed_lists, with_end
from millrace.session import settle

LENGTH = 4096
DIMENSIONS, BIN_BITS = 4, 12
HASHED = 1 << 16
SLICE_BYTES = 4 << 20  # of texts at a time
CODED = "doc_id long, n_tokens long, x0 float, x1 float, x2 float, x3 float, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection() -> np.ndarray:
    """Random directions of the hashed tokens."""
    return np.asfortranarray(np.random.default_rng(17).standard_normal((HASHED, DIMENSIONS)).astype(np.float32))


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table, schema = encoder(path), projection(), fields_of(CODED)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                ids, bounds = with_end(*of.encode(part.column(1)), end_id)
                n = np.diff(bounds)
                sums = np.stack([np.add.reduceat(axis[ids & ids.dtype.type(HASHED - 1)], bounds[:-1]) for axis in table.T], axis=1)
                x = sums / np.sqrt(n)[:, None]  # of like spread at any length
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), *(pa.array(x[:, d], pa.float32()) for d in range(DIMENSIONS)), packed_lists(ids, bounds)],
                    schema=schema,
                )

    return encode


def hilbert_key(bins: np.ndarray, bits: int = BIN_BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates (one row each)."""
    x = [c.astype(np.int64).copy() for c in bins.T]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns of the cells, from the largest
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where(x[n - 1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    x = [c ^ turn for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keys(means: list[float], spreads: list[float]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = (1 << BIN_BITS) - 1
        for batch in batches:
            x = np.stack([batch.column(3 + d).to_numpy() for d in range(DIMENSIONS)], axis=1).astype(np.float64)
            z = (x - means) / spreads
            bins = np.clip((1 / (1 + np.exp(-1.7 * z))) * (top + 1), 0, top).astype(np.int64)  # about even bins
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(hilbert_key(bins))], names=["uid", "doc_id", "n_tokens", "key"]
            )

    return keys


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each document within its range of the order."""
    before = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - n)], names=["uid", "n", "place"])
        before = int(ends[-1]) if len(ends) else before


def _cut(length: int, kind: str, with_ids: bool):
    names = [c.split(" ")[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), kind).astype("<u4")
                start = 0
                while start < len(ids):
                    offset = (at + start) % length
                    n = min(length - offset, len(ids) - start)
                    piece = ids[start : start + n]
                    row = (doc, start, n, zlib.crc32(piece.tobytes()), len(ids), (at + start) // length, offset)
                    for column, value in zip(rows, row + ((piece.astype(np.int32),) if with_ids else ())):
                        column.append(value)
                    start += n
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return cut


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence, and its ids."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    coded = plain.mapInArrow(lean(_encode(vocabulary, end_id)), CODED).withColumn("uid", F.monotonically_increasing_id())
    coded = settle(coded, "coded")
    axes = [f"x{d}" for d in range(DIMENSIONS)]
    spread = coded.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.avg, F.stddev_pop) for c in axes]).first()
    means = [spread[f"avg_{c}"] or 0.0 for c in axes]
    spreads = [spread[f"stddev_pop_{c}"] or 1.0 for c in axes]
    keyed = coded.select("uid", "doc_id", "n_tokens", *axes).mapInArrow(
        _keys(means, spreads), "uid long, doc_id long, n_tokens long, key long"
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "uid"]
    placed = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("uid", "n_tokens")
    placed = placed.mapInArrow(lean(_places), "uid long, n long, place long").withColumn("part", F.spark_partition_id())
    placed = settle(placed, "places")
    totals = dict(placed.groupBy("part").agg(F.sum("n")).collect())  # one number for each range
    base, start = [], 0
    for part in sorted(totals):
        base.append((part, start))
        start += totals[part]
    bases = spark.createDataFrame(base, "part int, base long")
    at = placed.join(F.broadcast(bases), "part").select("uid", (F.col("base") + F.col("place")).alias("at"))
    kind = encoder(vocabulary).type.str
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return coded.select("uid", "doc_id", "ids").join(at, "uid").select("doc_id", "at", "ids").mapInArrow(lean(_cut(length, kind, with_ids)), schema)
