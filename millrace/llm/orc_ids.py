"""Token ids as ORC files: run-length coded integers, row indexes, Bloom filters on document ids.

Texts are range-partitioned by document id and sorted before they are encoded,
so file after file holds ascending ids, min/max statistics of stripes and row
groups are narrow, and a reader of some documents skips the rest by index and
Bloom filter. Each row has its document's id, the number of the range
(``part``), the place of its first token within the range and the ids
themselves. Readers take stripes in parallel; the only thing that all ranges
share is one token count for each.

Null texts are empty: they hold the end id alone. Equal document ids stand
together, ordered by a hash of their texts (equal texts are alike, so every run
gives the same rows); null ids come first. An empty table gives no rows; other
columns of the table are not read, whatever their names. A very long text is
one row, encoded in blocks of bounded bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import lean, text_slices
from millrace.llm.tokens import encoder, with_end
from millrace.session import new_path

STRIPE_BYTES = 64 << 20
ROW_STRIDE = 1_000
ROWS = "doc_id long, place long, n_tokens long, ids array<int>"
SLICE_BYTES = 4 << 20  # of texts at a time


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place = encoder(path), 0
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                flat, bounds = with_end(*of.encode(part.column(1)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bounds[:-1] + place), pa.array(np.diff(bounds)), lists],
                    names=["doc_id", "place", "n_tokens", "ids"],
                )
                place += int(bounds[-1])

    return encode


def write_ids(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id"
) -> str:
    """Encode all texts and write them in ascending order of id; returns the folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]  # texts of one id stand in a fixed order, and in several ranges if they are many
    ordered = plain.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = ordered.mapInArrow(lean(_encode(vocabulary, end_id)), ROWS).withColumn("part", F.spark_partition_id())
    options = {
        "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": ROW_STRIDE,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "lz4",
    }
    rows.write.options(**options).orc(folder)
    return folder


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat = ids.flatten().to_numpy().astype("<u4")
        ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        data = memoryview(flat).cast("B")
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        made = [pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), *made], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"]
        )


def read_ids(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, part, place, n_tokens, ids; given documents are found by the files' indexes."""
    rows = spark.read.schema(ROWS + ", part int").orc(folder)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = read_ids(spark, folder)
    totals = dict(rows.groupBy("part").agg(F.sum("n_tokens")).collect())  # one number for each range
    base, start = [], 0
    for part in sorted(totals):
        base.append((part, start))
        start += totals[part]
    bases = spark.createDataFrame(base, "part int, base long")
    read = rows.select("doc_id", "part", "place", "ids")
    checked = read.mapInArrow(lean(_check), "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return checked.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
