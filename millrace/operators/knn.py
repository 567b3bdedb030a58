"""Exact top-k stored vectors per question vector, by dot product.

Questions are cut into blocks of bounded size. Each block travels to the data:
every task keeps a running top k per question over its own rows, so only k
rows per question and task are shuffled, no pair is ever emitted, and stored
vectors stay where they are. One scan of the vectors serves a whole block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.vectors import dot, is_finite
from millrace.session import new_path, settle

MAX_CELLS = 16_000_000  # numbers in the question matrix a task holds (128 MB)
SCORES_AT_ONCE = 4_000_000
FOLD_AT = 100_000  # candidates that may wait, at least


def mean_vector(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Mean vector per group (or overall), merged map-side first."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(vector))


def is_score(score: Column) -> Column:
    """Whether a score is a finite number; finite vectors can still overflow."""
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(math.inf))


def top_k_single(
    vectors: DataFrame,
    question: Sequence[float],
    k: int = 3,
    id_col: str = "vec_id",
    vector: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Top k for one question vector: project and take. ``carry`` names columns to return with a hit.

    Runs in the JVM: each task keeps its best k, the driver merges those.
    What is left out is the same as in ``top_k``.
    """
    asked = F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in question) + ")")
    return (
        vectors.filter(is_finite(F.col(vector)) & F.col(id_col).isNotNull())
        .select(id_col, *carry, dot(F.col(vector), asked).alias("score"))
        .filter(is_score(F.col("score")))
        .orderBy(F.desc("score"), id_col)
        .limit(k)
    )


def top_k(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = 3,
    id_col: str = "vec_id",
    vector: str = "embedding",
    question_id: str = "question_id",
    question_vector: str = "question_vector",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Rows (question_id, id, score, rank) with the k best vectors per question.

    Ties go to the lower id. Vectors of another length than the question's
    are an error. Vectors and questions that are null or have a null, NaN or
    infinite element are left out, row by row, before anything is scored; so
    are vectors without an id, and scores that overflow. ``max_cells`` bounds
    the numbers of one question block and so the memory of driver and tasks.
    """
    spark = vectors.sparkSession
    asked = questions.select(question_id, F.col(question_vector).cast("array<double>").alias("v")).filter(is_finite(F.col("v")))
    stored = vectors.select(id_col, F.col(vector).alias("v")).filter(is_finite(F.col("v")) & F.col(id_col).isNotNull())
    schema = T.StructType(
        [
            T.StructField(question_id, questions.schema[question_id].dataType),
            T.StructField(id_col, vectors.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    asked = settle(asked, "questions")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    per_block = max(1, max_cells // max(1, size.dim or 1))
    blocks, found = new_path(spark, "question-blocks"), new_path(spark, "hits")
    even = asked.repartition(max(1, math.ceil(size.n / per_block)))
    even.write.option("maxRecordsPerFile", per_block).parquet(blocks)
    for file in spark.read.schema(asked.schema).parquet(blocks).inputFiles():
        block = spark.read.schema(asked.schema).parquet(file).toArrow()  # at most max_cells numbers
        _block_top(stored, block, k, schema).write.mode("append").parquet(found)
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), id_col)
    best = spark.read.schema(schema).parquet(found) if size.n else spark.createDataFrame([], schema)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_top(stored: DataFrame, block: pa.Table, k: int, schema: T.StructType) -> DataFrame:
    """The best k per question of a block and task, as rows of ``schema``."""
    block = block.combine_chunks()
    keys = pa.chunked_array(block.column(0)).combine_chunks()
    vectors = pa.chunked_array(block.column(1)).combine_chunks()
    dim = len(vectors[0]) if len(vectors) else 0
    shared = stored.sparkSession.sparkContext.broadcast((keys, _as_matrix(vectors, dim)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = shared.value
        best = None
        for batch in batches:
            if batch.num_rows and len(matrix):
                if best is None:
                    best = _Best(matrix, k, batch.column(0).slice(0, 0).to_numpy(zero_copy_only=False))
                best.add(batch.column(0), _as_matrix(batch.column(1), matrix.shape[1]))
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(best.asked)).cast(arrow.types[0]), pa.array(best.found, arrow.types[1]), pa.array(best.scores)], schema=arrow
            )

    return stored.mapInArrow(run, schema)


def _as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dim))
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths != {"min": dim, "max": dim}:
        raise ValueError(f"vectors of length {lengths['min']} to {lengths['max']}, questions of length {dim}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


class _Best:
    """Running hits of a block of questions: arrays of question number, score and id, the best first per question.

    Candidates are gathered and folded in when there are as many as hits, so
    sorting costs a small share of scoring however many questions a block has.
    """

    def __init__(self, matrix: np.ndarray, k: int, names: np.ndarray) -> None:
        self.matrix, self.k, self.lengths = matrix, k, np.sqrt((matrix * matrix).sum(axis=1))
        self.asked, self.scores, self.found = np.empty(0, np.int64), np.empty(0), names[:0]
        self.waiting: list[tuple] = []
        self.n_waiting = 0
        self.last = np.full(len(matrix), -np.inf)  # the last hit of a full question bounds what can still enter

    def fold(self) -> None:
        """Sort what waits into the hits."""
        asked, scores, found = (np.concatenate(x) for x in zip((self.asked, self.scores, self.found), *self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((found, -scores, asked))
        ordered = asked[order]
        order = order[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) < self.k]
        self.asked, self.scores, self.found = asked[order], scores[order], found[order]
        full = np.bincount(self.asked, minlength=len(self.matrix)) >= self.k
        least = np.full(len(self.matrix), np.inf)
        np.minimum.at(least, self.asked, self.scores)
        self.last = np.where(full, least, -np.inf)

    def add(self, ids: pa.Array, rows: np.ndarray) -> None:
        """Fold a batch of vectors into the hits.

        One matrix product finds candidates, with a margin above its rounding
        error; their scores are then summed row by row in a fixed order, so equal
        vectors get equal scores and ties are decided by id.
        """
        names = np.array(ids.to_pylist(), dtype=object) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)
        n, dim = self.matrix.shape
        step, pairs = max(1, SCORES_AT_ONCE // n), max(1, SCORES_AT_ONCE // max(1, dim))
        for at in range(0, len(rows), step):
            block, block_ids = rows[at : at + step], names[at : at + step]
            with np.errstate(all="ignore"):
                rough = self.matrix @ block.T
                rough[~np.isfinite(rough)] = -np.inf
                cut = np.partition(rough, -min(self.k, len(block)), axis=1)[:, -min(self.k, len(block))]
                cut = np.maximum(cut, self.last)
                margin = 8 * (dim + 1) * np.finfo(float).eps * self.lengths * np.sqrt((block * block).sum(axis=1).max())
                least = np.where(np.isfinite(margin), cut - margin, -np.inf)
                q, r = np.nonzero(rough >= least[:, None])
                for i in range(0, len(q), pairs):
                    qs, rs = q[i : i + pairs], r[i : i + pairs]
                    exact = (block[rs] * self.matrix[qs]).sum(axis=1)
                    good = np.isfinite(exact)
                    self.waiting.append((qs[good], exact[good], block_ids[rs[good]]))
                    self.n_waiting += int(good.sum())
                    if self.n_waiting >= max(len(self.asked), FOLD_AT):
                        self.fold()
        if self.waiting:
            self.fold()
