"""Trees fitted on cells: the training rows summed up by what a tree can see of them.

A tree learner cuts every feature into a few bins and splits between bins
only, so rows that share their bins are one to it. A cell is a combination of
bins; its number of rows and its sum of labels give a tree the same sums on
either side of every split as its rows do, whatever the labels. There are at
most as many cells as combinations, however many rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.ml import Model, Transformer
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from millrace.session import settle

BINS = 32  # of a feature, as Spark's tree learners have
MAX_CELLS = (BINS + 1) ** 4  # four features, each with a bin for nulls; sums of a task take 0.26 KB a cell
MAX_VALUES = 10_000  # values of a feature up to which its bins are cut by the exact count of every value
CHUNK = 1_000_000  # rows summed up at a time in a task
SLICE = 20_000  # cells that a task hands over at a time
TREES_AT_ONCE = 4  # of a forest; a tree is many small jobs, whose tasks leave cores idle


def edges_of_values(counts: Sequence[tuple[float, int]], bins: int = BINS) -> list[float]:
    """Where a feature is cut, from its values and how often each is met: between all values, or at even shares of the rows.

    This is the rule of Spark's tree learners, which apply it to a sample.
    """
    counts = sorted(counts)
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(middle) < bins:
        return middle
    stride = sum(n for _, n in counts) / bins
    found, target, now = [], stride, counts[0][1]
    for edge, (_, n) in zip(middle, counts[1:]):
        before, now = now, now + n
        if abs(before - target) < abs(now - target):
            found.append(edge)
            target += stride
    return found


def bin_edges(rows: DataFrame, feature: str) -> list[float]:
    """Where a feature is cut; nulls and NaN stay out, as they have a bin of their own. At least one edge, for ``Bucketizer``."""
    known = rows.filter(F.col(feature).isNotNull() & ~F.isnan(feature)).select(feature)
    counts = known.groupBy(feature).count().limit(MAX_VALUES + 1).collect()
    if len(counts) <= MAX_VALUES:
        edges = edges_of_values([(v, n) for v, n in counts])
    else:
        edges = known.approxQuantile(feature, [i / BINS for i in range(1, BINS)], 1 / (BINS * 64))
    return sorted({e + 0.0 for e in edges if math.isfinite(e)}) or [0.0]


@dataclass
class Bins:
    """The bins of some features, and cells as numbers."""

    features: list[str]
    edges: list[list[float]]

    @classmethod
    def of(cls, rows: DataFrame, features: Sequence[str]) -> Bins:
        return cls(list(features), [bin_edges(rows, f) for f in features])

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 2 for e in self.edges]  # one more than edges, and one for nulls

    @property
    def cells(self) -> int:
        return math.prod(self.sizes)

    def stages(self) -> list[Transformer]:
        """Features as the numbers of their bins, in a vector. A null is beyond all bins, as it is to a tree."""
        names = [f"{f}__bin" for f in self.features]
        ends = [[-math.inf, *e, math.inf] for e in self.edges]
        cut = Bucketizer(splitsArray=ends, inputCols=self.features, outputCols=names, handleInvalid="keep")
        return [cut, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")]

    def numbered(self, rows: DataFrame) -> DataFrame:
        """Rows (cell, label)."""
        cell, step = F.lit(0).cast("long"), 1
        for f, size in zip(self.features, self.sizes):
            cell, step = cell + F.coalesce(F.col(f"{f}__bin"), F.lit(size - 1.0)).cast("long") * step, step * size
        return self.stages()[0].transform(rows.select(*self.features, "label")).select(cell.alias("cell"), "label")

    def seen(self, cells: DataFrame) -> DataFrame:
        """Cells with their features, as ``stages`` makes them for rows."""
        step, bins = 1, []
        for f, size in zip(self.features, self.sizes):
            bins.append((F.floor(F.col("cell") / step) % size).cast("double").alias(f"{f}__bin"))
            step *= size
        return self.stages()[1].transform(cells.select("*", *bins)).drop(*[f"{f}__bin" for f in self.features])


def cell_sums(numbered: DataFrame, cells: int, trees: int, seed: int) -> DataFrame:
    """Number of rows and sum of labels of every cell (n, s), and the same in the rows drawn for each tree (n0, s0, n1, …).

    Every row is drawn for every tree by a Poisson number of its own, with
    mean 1, as Spark's forests draw. A task adds up its rows cell by cell and
    hands over one line for each cell it met.
    """
    names = ["n", "s", *[f"{k}{t}" for t in range(trees) for k in "ns"]]
    chunk, piece = CHUNK, SLICE

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield columns_of(held)
                held = []
        if held:
            yield columns_of(held)

    def columns_of(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        counts = sums = None
        for cell, label in chunks(batches):
            if counts is None:  # a task without rows needs none
                counts, sums = np.zeros((trees + 1, cells), np.uint32), np.zeros((trees + 1, cells))
            for t in range(trees + 1):
                drawn = random.poisson(1.0, len(cell)) if t else np.ones(len(cell))
                counts[t] += np.bincount(cell, drawn, cells).astype(np.uint32)
                sums[t] += np.bincount(cell, drawn * label, cells)
        met = np.flatnonzero(counts[0]) if counts is not None else []
        for i in range(0, len(met), piece):
            some = met[i : i + piece]
            columns = [part for t in range(trees + 1) for part in (counts[t][some].astype(np.float64), sums[t][some])]
            yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, columns)], ["cell", *names])

    found = numbered.mapInArrow(work, ", ".join(["cell long", *[f"{c} double" for c in names]]))
    return found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names])


def forest_of(estimator: RandomForestRegressor, trees: Sequence[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """One forest of forests of a single tree."""
    context = SparkContext.getOrCreate()
    made = context._jvm.org.apache.spark.ml.regression
    array = context._gateway.new_array(made.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree._java_obj.trees()[0]
    model = estimator._copyValues(RandomForestRegressionModel(made.RandomForestRegressionModel(estimator.uid, array, trees[0].numFeatures)))
    model._transfer_params_to_java()  # the number of trees, among others, which a stored forest is read by
    return model


class CellLearner:
    """Fits forests and boosted trees on the cells of training rows, and judges them on those of other rows."""

    def __init__(self, bins: Bins, train: DataFrame, check: DataFrame, trees: int, seed: int) -> None:
        self.bins = bins
        self.train = bins.seen(settle(cell_sums(bins.numbered(train), bins.cells, trees, seed), "train-cells"))
        spread = (F.var_pop("label") * F.count("*")).alias("css")
        moments = bins.numbered(check).groupBy("cell").agg(F.count("*").alias("n"), F.avg("label").alias("mean"), spread)
        self.check = bins.seen(settle(moments, "check-cells"))

    def _rows(self, number: Column, total: Column) -> DataFrame:
        return self.train.filter(number > 0).select("features", (total / number).alias("label"), number.alias("weight"))

    def fit(self, learner: RandomForestRegressor | GBTRegressor) -> Model:
        """The learner's model. All cells are looked at to find the bins they have, so that none of them is lost."""
        learner = learner.copy().setWeightCol("weight").setMaxBins(math.isqrt(MAX_CELLS) + 1)
        if not isinstance(learner, RandomForestRegressor):
            return learner.fit(self._rows(F.col("n"), F.col("s")))

        def grown(t: int) -> RandomForestRegressionModel:
            one = learner.copy().setNumTrees(1).setBootstrap(False).setSeed(learner.getSeed() + t)
            if learner.getFeatureSubsetStrategy() == "auto" and learner.getNumTrees() > 1:
                one = one.setFeatureSubsetStrategy("onethird")  # what auto means in a forest
            return one.fit(self._rows(F.col(f"n{t}"), F.col(f"s{t}")))

        with ThreadPool(TREES_AT_ONCE) as pool:
            return forest_of(learner, pool.map(inheritable_thread_target(self.train.sparkSession)(grown), range(learner.getNumTrees()), chunksize=1))

    def rmse(self, model: Model) -> float:
        """Error on the rows of the cells to check, exactly: their spread, and the squared distance of their mean from what is predicted."""
        judged = model.transform(self.check)
        away = F.col("mean") - F.col("prediction")
        found = judged.agg(F.sqrt(F.sum(F.col("css") + F.col("n") * away * away) / F.sum("n"))).first()[0]
        return math.nan if found is None else found
