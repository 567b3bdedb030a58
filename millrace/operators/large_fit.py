"""Least squares on class effects with any number of levels.

The effect with the most levels is *absorbed*: its levels' means are taken out
of everything else, level by level, as a Spark job, and what is left are the
normal equations of the other effects. While those have at most ``DENSE``
levels together, they are solved at once and every figure is exact, standard
errors too: what the driver holds is bounded by ``DENSE`` squared, whatever
the absorbed effect has.

Beyond, the reduced equations are solved by conjugate gradients, scaled by
their diagonal. The matrix stays in Spark as two sparse tables (counts of pairs
of levels, and each absorbed level's counts); an iteration is a job, and the
driver sees two sums of it. The rank is that of each effect's graph with the
absorbed one: its levels less the connected components. That is exact for two
effects; with more it holds unless effects determine each other only in
combination. Standard errors are null there.

Estimates come as a table in the usual coding: the last level of an effect, in
sorted order, is the reference with estimate 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.levels import number_rows, unpivot
from millrace.session import settle

DENSE = 500  # levels of the effects beside the absorbed one that are solved at once
TOLERANCE = 1e-9  # of a pivot beside its diagonal, and of the residual
MAX_ITERATIONS = 500  # a bound on rounding errors alone; as many steps as there are free levels are enough
PROFILE = "level string, n double, s double, places array<int>, counts array<double>"
ESTIMATE = "effect string, level string, df int, estimate double, factor double"


def solve(a: np.ndarray, b: np.ndarray, scale: np.ndarray, tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares by sweeping columns in order: estimates, generalised inverse, estimable.

    A column whose pivot is nothing beside ``scale`` depends on those before it: estimate 0.
    """
    p = len(b)
    work, inverse = np.column_stack([a, b]).astype(float), np.eye(p)
    estimable = np.zeros(p, bool)
    for k in range(p):
        if work[k, k] <= tol * max(scale[k], 1.0):
            continue
        estimable[k] = True
        pivot = work[k, k]
        work[k] /= pivot
        inverse[k] /= pivot
        others = work[:, k].copy()
        others[k] = 0.0
        work -= np.outer(others, work[k])
        inverse -= np.outer(others, inverse[k])
    inverse = np.where(np.outer(estimable, estimable), inverse, 0.0)
    return np.where(estimable, work[:, p], 0.0), inverse, estimable


@dataclass
class LargeFit:
    """Figures of a fit, and its estimates as a table (effect, level, df, estimate, factor of the error variance)."""

    effects: list[str]
    absorbed: str
    estimates: DataFrame
    n_read: int
    n: int
    p: int
    sse: float
    tss: float
    iterations: int = 0
    steps: list[dict] = field(default_factory=list)

    @property
    def sbc(self) -> float:
        return self.n * math.log(self.sse / self.n) + self.p * math.log(self.n) if self.sse > 0 else -math.inf

    @property
    def mse(self) -> float:
        return self.sse / (self.n - self.p) if self.n > self.p else math.nan


@dataclass
class Cells:
    """Settled cells of the rows that a fit uses, with the response less its mean."""

    table: DataFrame  # effects, w (rows), y (mean response)
    n_read: int
    n: int
    mean: float
    tss: float


def used_cells(cells: DataFrame, effects: Sequence[str], response: str) -> Cells:
    """Cells with a response and a level of every effect; one job settles them."""
    complete = F.col(f"{response}__n") > 0
    for e in effects:
        complete = complete & F.col(e).isNotNull()
    w, mean = F.col(f"{response}__n").cast("double"), F.col(f"{response}__mean")
    n_read = cells.agg(F.sum("n")).first()[0] or 0
    kept = settle(cells.filter(complete).select(*effects, w.alias("w"), mean.alias("y"), F.col(f"{response}__css").alias("css")), "fit-cells")
    total = kept.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")).first()
    if not total.n:
        raise ValueError("no rows with a response")
    mean = total.s / total.n
    centred = kept.withColumn("y", F.col("y") - F.lit(mean))
    tss = centred.agg(F.sum(F.col("css") + F.col("w") * F.col("y") * F.col("y"))).first()[0]
    return Cells(centred.drop("css"), int(n_read), int(total.n), float(mean), float(tss))


def level_sums(cells: Cells, effects: Sequence[str]) -> DataFrame:
    """Rows and response sum of every level: effect, level, n, s."""
    rows = unpivot(cells.table.withColumn("wy", F.col("w") * F.col("y")), effects, "w", "wy")
    return rows.groupBy("effect", "level").agg(F.sum("w").alias("n"), F.sum("wy").alias("s"))


def fit_cells(cells: Cells, effects: Sequence[str], dense: int = DENSE) -> LargeFit:
    """A fit of some of the effects; see the module."""
    effects = list(effects)
    spark = cells.table.sparkSession
    if not effects:
        only = spark.createDataFrame([("Intercept", "", 1, cells.mean, 1.0 / cells.n)], ESTIMATE)
        return LargeFit([], "", only, cells.n_read, cells.n, 1, cells.tss, cells.tss)
    sums = settle(level_sums(cells, effects), "level-sums")
    sizes = dict(sums.groupBy("effect").agg(F.count("*")).collect())  # a number for each effect
    absorbed = max(effects, key=lambda e: sizes[e])
    others = [e for e in effects if e != absorbed]
    small = sum(sizes[e] for e in others) <= dense
    return (_direct if small else _iterated)(cells, effects, absorbed, others, sums, sizes)


# -- solved at once ----------------------------------------------------------------


def _terms(others: list[str], sums: DataFrame) -> list[tuple[str, str, float, float]]:
    """Levels of the effects that are not absorbed, in order, with rows and response sums (at most ``DENSE``)."""
    rank = {e: i for i, e in enumerate(others)}
    rows = [tuple(r) for r in sums.filter(F.col("effect").isin(others)).select("effect", "level", "n", "s").collect()] if others else []
    return sorted(rows, key=lambda r: (rank[r[0]], r[1]))


def _profiles(cells: Cells, absorbed: str, others: list[str], sums: DataFrame, places: DataFrame | None) -> DataFrame:
    """Each absorbed level with its rows, response sum, and counts by place of the other levels (one for each at most)."""
    own = sums.filter(F.col("effect") == absorbed).select("level", "n", "s")
    if places is None:
        return own.select("level", "n", "s", F.array().cast("array<int>").alias("places"), F.array().cast("array<double>").alias("counts"))
    pairs = unpivot(cells.table.withColumn("__c", F.col(absorbed)), others, "__c", "w").groupBy("__c", "effect", "level").agg(F.sum("w").alias("w"))
    listed = pairs.join(places, ["effect", "level"]).groupBy("__c").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("x"))
    return own.join(listed, own.level == listed["__c"]).select("level", "n", "s", F.col("x.place").cast("array<int>").alias("places"), F.col("x.w").alias("counts"))


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row by row: its number, the places and the counts."""
    places, counts = batch.column(3), batch.column(4)
    bounds = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))])
    at, x = places.flatten().to_numpy(), counts.flatten().to_numpy()
    for i in range(batch.num_rows):
        s = slice(int(bounds[i]), int(bounds[i + 1]))
        yield i, at[s], x[s]


def _absorb(p: int):
    """Sums over a task's absorbed levels: what they take out of the cross products, and their own sum of squares."""

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, right, own = np.zeros((p, p)), np.zeros(p), 0.0
        for batch in batches:
            n, s = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            own += float((s * s / n).sum())
            for i, at, x in _lists(batch):
                matrix[np.ix_(at, at)] += np.outer(x, x / n[i])
                right[at] += x * (s[i] / n[i])
        i, j = np.nonzero(np.triu(matrix))
        rows = [np.concatenate([i, np.arange(p), [-1]]), np.concatenate([j, np.full(p, -1), [-1]]), np.concatenate([matrix[i, j], right, [own]])]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2])], names=["i", "j", "v"])

    return absorb


def _direct(cells: Cells, effects: list[str], absorbed: str, others: list[str], sums: DataFrame, sizes: dict[str, int]) -> LargeFit:
    spark = cells.table.sparkSession
    terms = _terms(others, sums)
    p = len(terms)
    at = {(e, level): i for i, (e, level, _, _) in enumerate(terms)}
    places = None
    if p:
        places = F.broadcast(spark.createDataFrame([(e, level, i) for (e, level), i in at.items()], "effect string, level string, place int"))
    profiles = settle(_profiles(cells, absorbed, others, sums, places), "level-profiles")
    taken = profiles.mapInArrow(_absorb(p), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()  # at most p squared
    a, b, own = np.zeros((p, p)), np.zeros(p), 0.0
    for i, j, v in taken:
        if i < 0:
            own = v
        elif j < 0:
            b[i] -= v
        else:
            a[i, j] -= v
            a[j, i] = a[i, j]
    for i, (_, _, n, s) in enumerate(terms):
        a[i, i] += n
        b[i] += s
    for n, e in enumerate(others):
        for f in others[n + 1 :]:
            for r in cells.table.groupBy(F.col(e).alias("x"), F.col(f).alias("y")).agg(F.sum("w").alias("w")).collect():  # at most p squared
                i, j = at[(e, r.x)], at[(f, r.y)]
                a[i, j] += r.w
                a[j, i] = a[i, j]
    beta, inverse, estimable = solve(a, b, np.array([n for _, _, n, _ in terms]))
    sse = max(cells.tss - own - float(beta @ b), 0.0)
    rank = sizes[absorbed] + int(estimable.sum())

    last = profiles.orderBy(F.desc("level")).first()  # the reference
    mean = np.zeros(p)
    mean[np.array(last.places, int)] = np.array(last.counts) / last.n
    base = last.s / last.n - float(mean @ beta)
    rows = profiles.mapInArrow(_absorbed_rows(absorbed, last.level, beta, inverse, mean, base, 1.0 / last.n), ESTIMATE)
    known = [("Intercept", "", 1, cells.mean + base, 1.0 / last.n + float(mean @ inverse @ mean))]
    known += [(e, level, int(ok), float(x), float(v)) for (e, level, _, _), ok, x, v in zip(terms, estimable, beta, np.diag(inverse))]
    return LargeFit(effects, absorbed, rows.unionAll(spark.createDataFrame(known, ESTIMATE)), cells.n_read, cells.n, rank, sse, cells.tss)


def _absorbed_rows(effect: str, last: str, beta: np.ndarray, inverse: np.ndarray, mean: np.ndarray, base: float, share: float):
    """Estimates of absorbed levels beside the last one's, with the factor of their variance."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s, level = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0)
            value, factor = s / n - base, 1.0 / n + share
            for i, at, x in _lists(batch):
                off = -mean
                off[at] += x / n[i]
                value[i] -= float(beta[at] @ x) / n[i]
                factor[i] += float(off @ inverse @ off)
            own = np.array(level.to_pylist(), dtype=object) == last
            columns = [[effect] * len(n), level, np.where(own, 0, 1), np.where(own, 0.0, value), np.where(own, 0.0, factor)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["effect", "level", "df", "estimate", "factor"])

    return rows


# -- solved by conjugate gradients -----------------------------------------------------


def _iterated(cells: Cells, effects: list[str], absorbed: str, others: list[str], sums: DataFrame, sizes: dict[str, int]) -> LargeFit:
    levels = settle(number_rows(sums, ["effect", "level"], "id"), "levels")
    numbered = cells.table
    for e in effects:
        own = levels.filter(F.col("effect") == e).select(F.col("level").alias(e), F.col("id").alias(f"__{e}"))
        numbered = numbered.join(own, e)
    ids = settle(numbered.select(*[F.col(f"__{e}").alias(e) for e in effects], "w", "y"), "numbered-cells")

    def pairs(e: str, f: str) -> DataFrame:
        return ids.groupBy(F.col(e).alias("i"), F.col(f).alias("j")).agg(F.sum("w").alias("w"))

    # counts of pairs of levels of different effects, both ways, and of the absorbed effect's with the others'
    cross = [pairs(e, f) for e in others for f in others if e != f]
    between = None
    for c in cross:
        between = c if between is None else between.unionAll(c)
    between = settle(between, "level-pairs") if between is not None else None
    profile = pairs(absorbed, others[0])
    for e in others[1:]:
        profile = profile.unionAll(pairs(absorbed, e))
    own = levels.filter(F.col("effect") == absorbed).select(F.col("id").alias("i"), "n", "s")
    profile = settle(profile.join(own, "i"), "profile")  # i absorbed, j other, w, and n, s of i
    taken = profile.groupBy("j").agg(F.sum(F.col("w") * F.col("w") / F.col("n")).alias("d"), F.sum(F.col("w") * F.col("s") / F.col("n")).alias("t"))
    start = levels.filter(F.col("effect") != absorbed).join(taken, F.col("id") == F.col("j"))
    diagonal, right = F.col("n") - F.col("d"), F.col("s") - F.col("t")
    diagonal = F.when(diagonal > F.lit(TOLERANCE) * F.greatest("n", F.lit(1.0)), diagonal)  # null: the absorbed effect determines the level
    start = start.select("id", "n", diagonal.alias("d"), right.alias("b")).select(
        "id", "n", "d", "b", F.lit(0.0).alias("x"), F.when(F.col("d").isNotNull(), F.col("b")).otherwise(0.0).alias("r"),
        F.when(F.col("d").isNotNull(), F.col("b") / F.col("d")).otherwise(0.0).alias("p"),
    )
    state = settle(start, "gradients")
    first = now = state.agg(F.sum(F.col("r") * F.col("p"))).first()[0] or 0.0
    steps = 0
    while now > TOLERANCE**2 * first and steps < MAX_ITERATIONS:
        moved = settle(_times(state, between, profile), "gradients")
        along = moved.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not along or along <= 0:
            break
        alpha = now / along
        r = F.col("r") - F.lit(alpha) * F.col("q")
        later = moved.agg(F.sum(r * r / F.col("d"))).first()[0] or 0.0
        state = moved.select(
            "id", "n", "d", "b", (F.col("x") + F.lit(alpha) * F.col("p")).alias("x"), r.alias("r"),
            F.when(F.col("d").isNotNull(), r / F.col("d") + F.lit(later / now) * F.col("p")).otherwise(0.0).alias("p"),
        )
        now, steps = later, steps + 1
    state = settle(state, "solution")
    explained = state.agg(F.sum(F.col("b") * F.col("x"))).first()[0]
    squares = own.agg(F.sum(F.col("s") * F.col("s") / F.col("n"))).first()[0]
    rank = sizes[absorbed] + sum(sizes[e] - n_components(ids.select(F.col(absorbed).alias("a"), F.col(e).alias("b")).distinct()) for e in others)
    estimates = _coded(cells, levels, state, profile, absorbed)
    return LargeFit(effects, absorbed, estimates, cells.n_read, cells.n, rank, max(cells.tss - squares - explained, 0.0), cells.tss, steps)


def _times(state: DataFrame, between: DataFrame | None, profile: DataFrame) -> DataFrame:
    """The reduced matrix times the direction ``p``, as a column ``q``."""
    p = state.select(F.col("id").alias("j"), "p")
    through = profile.join(p, "j").groupBy("i").agg((F.sum(F.col("w") * F.col("p")) / F.first("n")).alias("m"))
    out = profile.join(through, "i").groupBy(F.col("j").alias("id")).agg((-F.sum(F.col("w") * F.col("m"))).alias("v"))
    if between is not None:
        out = out.unionAll(between.join(p, "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("v")))
    q = out.groupBy("id").agg(F.sum("v").alias("v"))
    moved = state.join(q, "id", "left")
    return moved.withColumn("q", F.when(F.col("d").isNotNull(), F.col("n") * F.col("p") + F.coalesce("v", F.lit(0.0))).otherwise(0.0)).drop("v")


def _coded(cells: Cells, levels: DataFrame, state: DataFrame, profile: DataFrame, absorbed: str) -> DataFrame:
    """The solution in the usual coding, the last level of each effect at 0."""
    lasts = F.max_by("id", "level").alias("id")
    last = {r.effect: r.id for r in levels.groupBy("effect").agg(lasts).collect()}  # a row for each effect
    values = state.select("id", "x")
    part = profile.join(values, profile.j == values.id).groupBy("i").agg((F.sum(F.col("w") * F.col("x")) / F.first("n")).alias("m"))
    own = levels.join(part, levels.id == part.i, "left").filter(F.col("effect") == absorbed)
    own = own.select("id", (F.col("s") / F.col("n") - F.coalesce("m", F.lit(0.0))).alias("x"))
    everything = settle(own.unionAll(values), "values")
    at = {r.id: r.x for r in everything.filter(F.col("id").isin(list(last.values()))).collect()}
    shift = F.lit(None).cast("double")
    for e, i in last.items():
        shift = F.when(F.col("effect") == e, F.lit(at[i])).otherwise(shift)
    rows = levels.join(everything, "id").select(
        "effect", "level", F.when(F.col("id").isin(list(last.values())), 0).otherwise(1).alias("df"), (F.col("x") - shift).alias("estimate"), F.lit(None).cast("double").alias("factor")
    )
    first = cells.mean + sum(at.values())
    return rows.unionAll(levels.sparkSession.createDataFrame([("Intercept", "", 1, float(first), None)], ESTIMATE))


def n_components(edges: DataFrame) -> int:
    """Connected components of the graph between levels of two effects (a, b, distinct numbers of both).

    Every level takes the least number around it, and then that of the level
    it took it from, so labels travel in steps that double.
    """
    edges = settle(edges, "level-graph")
    label = edges.groupBy(F.col("a").alias("i")).agg(F.min("b").alias("m")).select("i", F.least("i", "m").alias("m"))
    label = label.unionAll(edges.groupBy(F.col("b").alias("i")).agg(F.min("a").alias("m")).select("i", F.least("i", "m").alias("m")))
    label, before = settle(label, "labels"), None
    while True:
        total = label.agg(F.sum(F.col("m").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return label.filter("i = m").count()
        before = total
        own = label.select(F.col("i").alias("a"), F.col("m").alias("ma"))
        other = label.select(F.col("i").alias("b"), F.col("m").alias("mb"))
        both = edges.join(own, "a").join(other, "b").select("a", "b", F.least("ma", "mb").alias("m"))
        near = both.select(F.col("a").alias("i"), "m").unionAll(both.select(F.col("b").alias("i"), "m")).groupBy("i").agg(F.min("m").alias("m"))
        onward = label.select(F.col("i").alias("m"), F.col("m").alias("mm"))
        label = settle(near.join(onward, "m", "left").select("i", F.least("m", F.coalesce("mm", "m")).alias("m")), "labels")
