"""Connected components of a graph given as links, as shuffles and local union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import settle_with


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a batch of links: each node and the least node it reaches in the batch."""
    for batch in batches:
        names, flat = np.unique(
            np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True
        )
        parent = list(range(len(names)))
        half = batch.num_rows

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(flat[:half].tolist(), flat[half:].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)  # numbers follow the names' order
        top = np.array([root(x) for x in range(len(names))], np.int64)
        moved = top != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[top[moved]])], names=["u", "v"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    aside = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return aside.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Each node that has a link, and the least node it reaches: node, component (longs).

    Links within a task are first joined by union-find; then nodes are drawn to
    their least neighbours in turn from both sides until nothing changes, which
    takes about the logarithm of the longest path. A node with very many links is met by partial
    minima and a join that may be split. Null ends and links to oneself count for nothing.
    """
    ends = [F.col(c).cast("long") for c in (a, b)]
    links = links.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).filter(ends[0].isNotNull() & ends[1].isNotNull())
    links = links.filter("u <> v").mapInArrow(_forest, "u long, v long")
    seen = None
    while True:
        h = F.xxhash64("u", "v")
        links, now = settle_with(
            _small_star(_large_star(links)), "links", n=F.count(F.lit(1)), x=F.bit_xor(h), s=F.sum(h.cast("decimal(38,0)"))
        )
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
