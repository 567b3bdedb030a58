"""Near-duplicate documents: SuperMinHash signatures, banding, exact checks, union-find.

A document's set is its distinct shingles of ``shingle`` words; two documents
are linked if their sets' resemblance is ``least`` percent or more.

Equal sets meet first, by partial minima, so a group of copies of any size is
one *node* from then on. A signature of 128 places is made by correlated
ranks: each shingle gives place after place of its own random permutation the
values rank + fraction, and a document stops when no later rank can lower any
place. 32 bands of 4 places make buckets; a link of exactly 80 percent is
missed with a probability of 5e-8.

A bucket sends its members to one *hub*,
links are confirmed on the full sets, and members that are connected by then
need no more checks: first with the hubs of a few bands, then of all. Only
members of buckets that are still in pieces after that are compared once more,
all of them, by an exact prefix filter, so no link between documents that
share a bucket is lost, and no bucket is turned into all its pairs.

Documents without words (null or empty texts) are linked with nothing. A null
id is never linked; it has no component and is kept. Rows that share an id are
one document with all their texts' links, in whatever order they come. An empty
table gives no rows; other columns are not read, whatever their names. A very
long text is a slice of its own, and its set is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import fields_of, lean, table_of
from millrace.llm.components import components
from millrace.llm.tables import settle_with
from millrace.llm.words import GOLDEN, MASK, NOT_SPACE, mix, words_of
from millrace.session import settle

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
FIRST_BANDS = 4  # the first hubs come from these alone; the other bands meet what is still apart
HUB_ROUNDS = 2
CELLS, BLOCK = 1 << 20, 1 << 12  # of the counts that order shingles: 8 MB, whatever the input
MARKS = "doc_id long, t long, n_shingles long, d1 long, d2 long, bands array<long>"
HOT_SHARE = 1_000  # a set in more than one document of so many is sent to all tasks; there are fewer such sets than this
SETS = "node long, members binary"


def shingles(words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted by text and hash."""
    text, _, hashes = words.windows(width, short=True)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def signatures(text: np.ndarray, hashes: np.ndarray, n_texts: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each text's set: least (rank + fraction) at each place, as rank and fraction of 32 bits each.

    All shingles of all texts go through a rank together. A text is done when all its
    places hold less than the next rank, as later values are larger.
    """
    out = np.full(n_texts * places, np.uint64(MASK))
    live = np.arange(len(hashes))
    order = None
    for rank in range(places):
        x = mix(hashes[live] + np.uint64((rank + 1) * GOLDEN & MASK))
        other = rank + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        value = (x >> np.uint64(32)) | np.uint64(rank << 32)
        if order is None:
            place = other
        else:
            place = order[row, other].astype(np.int64)
            order[row, other] = order[row, rank]
        np.minimum.at(out, text[live] * places + place, value)
        open_ = out.reshape(n_texts, places).max(axis=1) >= np.uint64(rank + 1 << 32)
        stay = open_[text[live]]
        if not stay.any():
            break
        if order is None:  # from here on each shingle needs its permutation
            live, other = live[stay], other[stay]
            row = np.arange(len(live))
            order = np.tile(np.arange(places, dtype=np.uint8), (len(live), 1))
            order[row, other] = 0
            order[row, 0] = other
        elif not stay.all():
            live, row = live[stay], row[stay]
    return out.reshape(n_texts, places)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of a signature."""
    n, places = signature.shape
    parts = signature.reshape(n, places // rows, rows)
    key = np.tile(np.arange(1, places // rows + 1, dtype=np.uint64) * np.uint64(GOLDEN), (n, 1))
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def _marks(width: int):
    schema = fields_of(MARKS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(2), NOT_SPACE, True):
                text, hashes = shingles(words, width)
                n = np.bincount(text, minlength=words.n_texts)
                sums = [np.zeros(words.n_texts + 1, np.uint64) for _ in range(2)]
                digests = []
                for total, salt in zip(sums, (1, 2)):
                    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt * GOLDEN & MASK)))])
                    ends = np.cumsum(n)
                    digests.append((run[ends] - run[ends - n]).view(np.int64))
                keys = band_keys(signatures(text, hashes, words.n_texts))
                offsets = pa.array(np.arange(words.n_texts + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(words.first, words.n_texts) for i in (0, 1)),
                        pa.array(n),
                        *map(pa.array, digests),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    schema=schema,
                )

    return mark


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), NOT_SPACE, True):
                text, hashes = shingles(words, width)
                ends = np.cumsum(np.bincount(text, minlength=words.n_texts)) * 8
                offsets = np.concatenate([[0], ends]).astype(np.int64)
                packed = pa.Array.from_buffers(
                    pa.large_binary(), words.n_texts, [None, pa.py_buffer(offsets), pa.py_buffer(hashes.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.n_texts), packed.cast(pa.binary())], schema=fields_of(SETS)
                )

    return sets


def _linked(least: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep.append(100 * both >= least * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return linked


def confirm(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(lean(_linked(least)), "a long, b long")


def _hub_pairs(state: DataFrame) -> DataFrame:
    """Members of buckets that are in pieces, each with its bucket's hub (the set of the least document)."""
    hubs = state.groupBy("bucket").agg(
        F.min_by(F.struct("node", "n", "component"), F.struct("least_id", "node")).alias("hub"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).filter("low <> high").select("bucket", "hub")
    return state.join(hubs, "bucket").filter("component <> hub.component").select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), "n", F.col("hub.n").alias("m")
    )


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's shingles fall into each cell, in blocks of cells."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for members in batch.column(1):
            np.add.at(counts, (np.frombuffer(members.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
    blocks = np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1))
    rows = [counts[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks]
    yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(rows, pa.binary())], names=["block", "counts"])


def _add_blocks(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for counts in table.column("counts"):
        total += np.frombuffer(counts.as_buffer(), np.int64)
    return table_of("block long, counts binary", [[key[0].as_py()], [total.tobytes()]])


def _prefixes(sent, least: int):
    """The shingles of each set that come first in the order of cell counts, as many as a link must share one of."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            lengths, first, after = [], [], []
            for members in batch.column(1):
                members = np.frombuffer(members.as_buffer(), np.uint64)
                n = len(members)
                met = counts[(members % np.uint64(CELLS)).astype(np.int64)]
                order = np.lexsort((members, met))[: n - -(-least * n // 100) + 1]
                left = n - np.flatnonzero(met[order] > 1)  # no other set has the rest
                order = order[met[order] > 1]
                first.append(members[order].view(np.int64))
                after.append(left)
                lengths.append(len(order))
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            shingle = pa.array(np.concatenate(first)) if first else pa.array([], pa.int64())
            columns = [batch.column(c).take(at) for c in (0, 2, 3)]
            left = pa.array(np.concatenate(after)) if after else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([shingle, *columns, left], names=["shingle", "node", "n", "component", "left"])

    return prefixes


def _rest_pairs(state: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Pairs of members of buckets still in pieces that can be linked, by the prefixes of their sets.

    In any fixed order of shingles, two sets of resemblance t share one of their
    first n - ceil(t n) + 1, and from the first they share on both have enough
    left. The order puts shingles of rarely met cells first;
    the counts of cells have a fixed size. A wrong count costs time, no link.
    """
    pieces = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    pieces = pieces.filter("low <> high").select("bucket")
    rest = state.join(pieces, "bucket").select("node", "n", "component").distinct()
    rest = settle(sets.join(rest, "node").select("node", "members", "n", "component"), "rest")
    blocks = rest.mapInArrow(lean(_cell_counts), "block long, counts binary")
    counts = np.zeros(CELLS, np.int64)
    for block, part in blocks.groupBy("block").applyInArrow(_add_blocks, "block long, counts binary").collect():
        counts[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part, np.int64)
    sent = rest.sparkSession.sparkContext.broadcast(counts)
    first = rest.mapInArrow(lean(_prefixes(sent, least)), "shingle long, node long, n long, component long, left long")
    other = first.toDF("shingle", "other", "m", "part", "remain")
    enough = (100 + least) * F.least("left", "remain") >= least * (F.col("n") + F.col("m"))
    alike = 100 * F.least("n", "m") >= least * F.greatest("n", "m")
    pairs = first.join(other, "shingle").filter("node < other and component <> part").filter(enough & alike)
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b"), "n", "m")


def near_links(docs: DataFrame, marks: DataFrame, text: str, doc_id: str, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (one for each set, named by a row that has it) and, where near ones exist, their components."""
    some = marks.filter("n_shingles > 0 and doc_id is not null")
    nodes = settle(
        some.groupBy("n_shingles", "d1", "d2").agg(
            F.min(F.struct("uid", "doc_id", "t")).alias("first"), F.min("doc_id").alias("least_id"),
            F.count("*").alias("copies"), F.any_value("bands").alias("bands"),
        ).withColumn("node", F.col("first.uid")),
        "nodes",
    )
    spread = nodes.select("node", "least_id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    buckets = settle(spread.join(shared, "bucket").select("bucket", "band", "node", "least_id", "n"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.t")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("t", F.xxhash64("text"))
    texts = texts.join(wanted, ["doc_id", "t"]).select("node", "text")
    sets = settle(texts.mapInArrow(lean(_sets(width)), SETS).dropDuplicates(["node"]), "sets")
    spark = docs.sparkSession
    found = spark.createDataFrame([], "node long, component long")
    tested = spark.createDataFrame([], "a long, b long")
    for turn in range(HUB_ROUNDS + 1):
        state = (buckets if turn else buckets.filter(F.col("band") < FIRST_BANDS)).join(found, "node", "left")
        state = state.select("bucket", "node", "least_id", "n", F.coalesce("component", "node").alias("component"))
        pairs = _hub_pairs(state) if turn < HUB_ROUNDS else _rest_pairs(state, sets, least)
        pairs = pairs.filter((100 * F.least("n", "m") >= least * F.greatest("n", "m")) & (F.col("a") != F.col("b")))
        pairs = pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        pairs, count = settle_with(pairs, "pairs", n=F.count(F.lit(1)))
        if not count["n"]:
            continue
        tested = tested.unionAll(pairs)
        links, count = settle_with(confirm(pairs, sets, least), "confirmed", n=F.count(F.lit(1)))
        if count["n"]:
            found = components(found.toDF("a", "b").unionAll(links), "a", "b")
    same, count = settle_with(_same_id(some, nodes), "same-id", n=F.count(F.lit(1)))
    if count["n"]:
        found = components(found.toDF("a", "b").unionAll(same), "a", "b")
    return nodes, found


def _same_id(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the sets of documents that share an id."""
    own = F.struct("n_shingles", "d1", "d2")
    several = some.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low <> high").select("doc_id", "low")
    keys = ["n_shingles", "d1", "d2"]
    rows = some.join(several, "doc_id").select("low", *keys).distinct()
    named = nodes.select(*keys, "node")
    rows = rows.join(named, keys).select("low.*", F.col("node").alias("a"))
    return rows.join(named, keys).select("a", F.col("node").alias("b")).filter("a <> b")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, least: int = 80
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id it reaches) and kept."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    marked = plain.mapInArrow(lean(_marks(width)), MARKS).withColumn("uid", F.monotonically_increasing_id())
    marks, count = settle_with(marked, "marks", n=F.count(F.lit(1)))
    nodes, found = near_links(docs, marks, text, doc_id, width, least)
    both = found.unionAll(found.select(F.col("component").alias("node"), "component")).distinct()
    names = both.join(nodes.select("node", "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("name"))
    named = nodes.join(both.join(names, "component").select("node", "name"), "node", "left")
    keys = ["n_shingles", "d1", "d2"]
    named = named.select(*keys, F.coalesce("name", "least_id").alias("component"), (F.col("copies") * HOT_SHARE > F.lit(count["n"])).alias("hot"))
    hot = F.broadcast(named.filter("hot").drop("hot"))  # fewer than HOT_SHARE rows
    rows = marks.select("doc_id", *keys)
    out = rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(named.filter("not hot").drop("hot"), keys, "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, least: int = 80) -> DataFrame:
    """One document of each group, with the columns it came with."""
    groups = near_duplicates(docs, text, doc_id, width, least)
    gone = groups.filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
