"""Hard negatives: for each anchor and positive, the nearest rows of other labels below a share of the positive's score.

A threshold join in the manner of L2AP. Anchors are read in blocks of bounded
size, and each block travels to the rows. A task keeps its rows' numbers by
dimension (the inverted index), but for the leading dimensions of a row that
the bound on its norm there covers: what is left out is too little to reach
the threshold on its own, so a pair whose sum over the index is not above that
bound can be dropped unseen. Sums are accumulated over the index, pairs are
pruned by the norms of what remains, and only the rest is scored in full.

A high threshold leaves few pairs. It is lowered, step by step, only for
windows that have not filled: first until an anchor has its positives, then
until each of its windows has its negatives. The last step takes everything a
window may hold, so results are exact; a task never sends more than a window
can use. A row is scored against a stated set of anchors; no pair of rows is
listed, and nothing is shuffled but the best of each task.

Rows with a null label, a null vector or an element that is null or not finite
take no part. A row without id may be a positive or a negative, never an
anchor, and comes last among ties. Rows that share an id are rows of their
own: anchors of one id each have their negatives, and such ties look alike in
the result. Vectors are as long as the longest; shorter ones (empty ones too)
go on with zeros. An empty table, or one without
anchors, gives no rows. Other columns are not read, whatever their names.
Scores are exact as long as they stay below 2**53; longer sums are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import table_of
from millrace.session import new_path, settle

BLOCK_CELLS = 1 << 18  # numbers in a block of anchors (2 MB)
SCORES_AT_ONCE = 1 << 21
CHUNK = 8  # dimensions that are accumulated at a time
POSITIVE_STEPS = (0.5, 0.25)  # of the largest product of norms; then everything
NEGATIVE_STEPS = (0.9, 0.6)  # how far down the window a threshold stands; then its lower end
LARGEST = 1 << 53
FOUND = "ask long, score long, vec_id long, row long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NO_ID = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0) -> DataFrame:
    """Rows that take part: id, label and the floor of each scaled element, as doubles."""
    label = F.col(label) if isinstance(label, str) else label
    made = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    part = made.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    scaled = F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    return part.select("vec_id", "label", scaled.alias("vector"))


@dataclass
class Asked:
    """What a block of anchors looks for: each ask belongs to one anchor and takes scores between two bounds."""

    vectors: np.ndarray  # of the anchors
    rows: np.ndarray  # the anchors' own rows
    labels: np.ndarray
    anchor: np.ndarray  # of each ask
    low: np.ndarray  # least and greatest score of each ask
    high: np.ndarray
    same_label: bool
    k: int


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones go on with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == n * dim:
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def norms_before(vectors: np.ndarray) -> np.ndarray:
    """Norm of each vector's leading dimensions, for every number of them."""
    return np.sqrt(np.concatenate([np.zeros((len(vectors), 1)), np.cumsum(vectors * vectors, axis=1)], axis=1))


def close_pairs(anchors: np.ndarray, anchor_norms: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may score ``least`` of the anchor or more, by sums over the index and remaining norms."""
    norms, dim = norms_before(rows), rows.shape[1]
    # a row's leading dimensions are left out of the index as long as no anchor reaches its threshold on them alone
    with np.errstate(divide="ignore"):
        reach = np.where(least > 0, least / np.maximum(anchor_norms[:, -1], 1e-300), 0.0).min() if len(least) else 0.0
    left_out = np.minimum((norms[:, 1:] < reach).sum(axis=1), dim) // CHUNK * CHUNK
    order = np.argsort(left_out, kind="stable")
    left_out, ordered = left_out[order], np.ascontiguousarray(rows[order])
    total = np.zeros((len(anchors), len(rows)))
    for at in range(0, dim, CHUNK):  # a list of the index: the rows that have these dimensions in it
        n = int(np.searchsorted(left_out, at, "right"))
        if n:
            total[:, :n] += anchors[:, at : at + CHUNK] @ ordered[:n, at : at + CHUNK].T
    remaining = anchor_norms[:, left_out] * norms[order, left_out] * (1 + 1e-9)
    which, row = np.nonzero(total + remaining >= least[:, None])
    return which, order[row]


def _best(ask_of: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best k of each ask: higher scores first, then smaller ids, then rows."""
    order = np.lexsort((row, ids, -score, ask_of))
    ask = ask_of[order]
    order = order[np.arange(len(ask)) - np.searchsorted(ask, ask) < k]
    return tuple(x[order] for x in (ask_of, score, ids, row))


def _floors(asked: Asked, best: tuple[np.ndarray, ...]) -> np.ndarray:
    """Least score that can still enter for each anchor: its asks' lower bounds, raised where a task holds k hits already."""
    floors = asked.low.copy()
    asks = np.arange(len(floors))
    end = np.searchsorted(best[0], asks, "right")
    full = end - np.searchsorted(best[0], asks) >= asked.k
    floors[full] = np.maximum(floors[full], best[1][end[full] - 1])
    least = np.full(len(asked.vectors), np.inf)
    np.minimum.at(least, asked.anchor, floors)
    return least


def _look(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        dim, first = asked.vectors.shape[1], np.searchsorted(asked.anchor, np.arange(len(asked.vectors) + 1))
        width = int(np.diff(first).max())
        use = np.flatnonzero(np.diff(first))  # anchors that still ask
        norms = norms_before(asked.vectors[use])
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        step = max(1, SCORES_AT_ONCE // len(use))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, labels = part.column(0).to_numpy(), part.column(2).to_numpy()
                ids, vectors = part.column(1).fill_null(int(NO_ID)).to_numpy(), as_matrix(part.column(3), dim)
                which, r = close_pairs(asked.vectors[use], norms, vectors, _floors(asked, best)[use])
                which = use[which]
                fits = ((labels[r] == asked.labels[which]) == asked.same_label) & (row[r] != asked.rows[which])
                which, r = which[fits], r[fits]
                score = np.empty(len(r), np.int64)
                for i in range(0, len(r), 1 << 14):
                    s = slice(i, i + (1 << 14))
                    score[s] = (asked.vectors[which[s]] * vectors[r[s]]).sum(axis=1)
                hits = [best]
                for nth in range(width):  # the asks of an anchor stand together
                    ask = first[which] + nth
                    good = np.flatnonzero(ask < first[which + 1])
                    good = good[(score[good] >= asked.low[ask[good]]) & (score[good] <= asked.high[ask[good]])]
                    hits.append((ask[good], score[good], ids[r[good]], row[r[good]]))
                best = _best(*(np.concatenate(x) for x in zip(*hits)), asked.k)
        if len(best[0]):
            yield from table_of(FOUND, list(best)).to_batches()

    return look


def _search(rows: DataFrame, asked: Asked) -> list[np.ndarray]:
    """The best k of every ask over all rows, ordered; at most k rows of each come back."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "row")
    found = rows.mapInArrow(_look(shared), FOUND).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= asked.k).drop("n").toArrow()
    shared.destroy()
    return list(_best(*(found.column(c).to_numpy() for c in ("ask", "score", "vec_id", "row")), asked.k))


def _lowered(rows: DataFrame, asked: Asked, steps: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Search with falling thresholds; a window that has filled is not asked again."""
    done: list[list[np.ndarray]] = []
    open_asks = np.arange(len(asked.anchor))
    for i, step in enumerate(steps):
        if not len(open_asks):
            break
        now = Asked(asked.vectors, asked.rows, asked.labels, asked.anchor[open_asks], step[open_asks], asked.high[open_asks], asked.same_label, asked.k)
        found = _search(rows, now)
        full = np.bincount(found[0], minlength=len(open_asks)) >= asked.k
        full |= i == len(steps) - 1
        keep = full[found[0]]
        done.append([open_asks[found[0][keep]], *(x[keep] for x in found[1:])])
        open_asks = open_asks[~full]
    columns = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64) for _ in range(4)]
    return list(_best(*columns, asked.k))


def _mine_block(rows: DataFrame, anchors: pa.Table, dim: int, largest: float, n_positives: int, n_negatives: int, window: tuple[int, int]) -> pa.Table:
    vectors = as_matrix(anchors.column("vector"), dim)
    own, labels, ids = (anchors.column(c).to_numpy() for c in ("row", "label", "vec_id"))
    n = len(ids)
    bound = norms_before(vectors)[:, -1] * largest
    free = np.full(n, np.inf)
    asked = Asked(vectors, own, labels, np.arange(n), -free, free, True, n_positives)
    anchor, score, positive, row = _lowered(rows, asked, [*(bound * s for s in POSITIVE_STEPS), -free])
    # 100 * negative between window[0] and window[1] times the positive
    low, high = -(-window[0] * score // 100), window[1] * score // 100
    some = low <= high
    anchor, score, positive, low, high = anchor[some], score[some], positive[some], low[some].astype(float), high[some].astype(float)
    asked = Asked(vectors, own, labels, anchor, low, high, False, n_negatives)
    steps = [np.ceil(low + (high - low) * s) for s in NEGATIVE_STEPS]
    ask, negative_score, negative, _ = _lowered(rows, asked, [*steps, low])
    rank = np.arange(len(ask)) - np.searchsorted(ask, ask) + 1

    def named(x: np.ndarray) -> pa.Array:
        return pa.array(x, mask=x == NO_ID)

    return table_of(MINED, [ids[anchor[ask]], named(positive[ask]), rank, named(negative), score[ask], negative_score])


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """Hard negatives of the anchors among ``vectors`` (of ``whole_vectors``); see the module.

    For each anchor and each of its ``n_positives`` best rows of its label, the
    best ``n_negatives`` rows of other labels whose score is between the two
    hundredths of the positive's. ``block_cells`` bounds the numbers of a block
    of anchors and so what is broadcast or held by the driver at once.
    """
    spark = vectors.sparkSession
    rows = settle(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector"), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    size = rows.agg(F.max(F.size("vector")).alias("dim"), F.sqrt(F.max(squares)).alias("largest")).first()
    if size.largest is not None and size.largest**2 >= LARGEST:
        raise ValueError("a vector's norm is too large for exact scores")
    dim = max(size.dim or 0, 1)
    per_block = max(1, block_cells // dim)
    blocks, mined = new_path(spark, "anchor-blocks"), new_path(spark, "hard-negatives")
    anchors = rows.filter(is_anchor & F.col("vec_id").isNotNull())
    n = anchors.count()
    anchors.repartition(max(1, math.ceil(n / per_block))).write.option("maxRecordsPerFile", per_block).parquet(blocks)
    read = spark.read.schema(rows.schema)
    for file in read.parquet(blocks).inputFiles() if n else []:
        block = read.parquet(file).toArrow()  # at most ``block_cells`` numbers
        table = _mine_block(rows, block, dim, size.largest, n_positives, n_negatives, window)
        spark.createDataFrame(table).write.mode("append").parquet(mined)
    return spark.read.schema(MINED).parquet(mined) if n else spark.createDataFrame([], MINED)
