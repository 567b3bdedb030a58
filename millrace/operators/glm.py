"""Least squares on class effects, from one pass over the data.

Spark reduces the table to one row per combination of class levels (count,
mean, corrected sum of squares). Up to ``MAX_PARAMETERS`` levels, the cross
products of the effects are all that a fit, and each step of an effect
selection, needs; the driver solves them. With more levels the fit stays in
Spark, whatever their number (``operators.large_fit``); the result tables are
the same.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import large_fit
from millrace.operators.encode import moments
from millrace.operators.large_fit import LargeFit
from millrace.operators.levels import number_rows
from millrace.session import settle

INTERCEPT = "Intercept"
MAX_PARAMETERS = 500
STOP_HORIZON = 3


def level_cells(df: DataFrame, effects: Sequence[str], response: str) -> DataFrame:
    """One row per combination of levels: rows read, rows used, mean and css of the response.

    The only pass over the table, aggregated map-side first.
    """
    return moments(df, effects, [response])


def class_levels(cells: DataFrame, effects: Sequence[str], response: str) -> DataFrame:
    """Levels of every class effect in sorted order, with rows read and used.

    Levels are numbered by range, so an effect may have any number of them.
    """
    pairs = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("level")) for e in effects])
    levels = (
        cells.select(F.explode(pairs).alias("p"), "n", F.col(f"{response}__n").alias("used"))
        .filter("p.level is not null")
        .groupBy("p.effect", "p.level")
        .agg(F.sum("n").alias("n_read"), F.sum("used").alias("n_used"))
    )
    numbered = number_rows(levels, ["effect", "level"], "place")
    sizes = numbered.groupBy("effect").agg(F.min("place").alias("first"), F.count("*").alias("n_levels"))  # a row for each effect
    return numbered.join(F.broadcast(sizes), "effect").select(
        "effect", "level", "n_read", "n_used", (F.col("place") - F.col("first") + 1).cast("int").alias("level_no"), "n_levels"
    )


def cross_products(cells: DataFrame, effects: Sequence[str], response: str) -> DataFrame:
    """Counts and response sums overall, per level, and per pair of levels.

    ``set_id`` is the grouping id: bit set = effect not in the grouping, which
    tells a missing level from an effect that was summed over. Rows without a
    response or without a class level are read but not used.
    """
    sets = [s for size in (0, 1, 2) for s in itertools.combinations(effects, size)]
    used_n, mean, css = F.col("used"), F.col("mean"), F.col("css")
    return (
        _used(cells, effects, response)
        .groupingSets([list(s) for s in sets], *effects)
        .agg(
            F.grouping_id().alias("set_id"),
            F.sum("n").alias("n_read"),
            F.sum(used_n).alias("n"),
            F.sum(used_n * mean).alias("sum_y"),
            F.sum(css + used_n * mean * mean).alias("sum_yy"),
        )
    )


def _used(cells: DataFrame, effects: Sequence[str], response: str) -> DataFrame:
    """Cells with the rows a fit uses: a response, and a level for every effect."""
    complete = F.lit(True)
    for e in effects:
        complete = complete & F.col(e).isNotNull()
    used = F.when(complete, F.col(f"{response}__n")).otherwise(0)
    stats = [F.when(used > 0, F.col(f"{response}__{part}")).otherwise(0.0).alias(part) for part in ("mean", "css")]
    return cells.select(*effects, "n", used.alias("used"), *stats)


@dataclass
class CrossProducts:
    """X'X and X'y of the full model (response centred), held on the driver."""

    effects: list[str]
    terms: list[tuple[str, str]]  # (effect, level), intercept first
    xtx: np.ndarray
    xty: np.ndarray
    n_read: int
    n: int
    mean: float
    tss: float

    def columns(self, effects: Sequence[str]) -> list[int]:
        """Columns of a model, effects in the order given."""
        out = [0]
        for e in effects:
            out += [i for i, (effect, _) in enumerate(self.terms) if effect == e]
        return out


def collect_cross_products(cells: DataFrame, effects: Sequence[str], response: str) -> CrossProducts | None:
    """Cross products of settled cells; None if there are more than ``MAX_PARAMETERS`` levels."""
    effects = list(effects)
    bound = 1 + MAX_PARAMETERS + MAX_PARAMETERS * MAX_PARAMETERS // 2
    rows = cross_products(cells, effects, response).limit(bound + 1).collect()
    bits = {e: 1 << (len(effects) - 1 - i) for i, e in enumerate(effects)}
    present = {r.set_id: [e for e in effects if not r.set_id & bits[e]] for r in rows}
    if len(rows) > bound:
        return None
    total = [r for r in rows if not present[r.set_id]]
    n_read = sum(r.n_read for r in total)
    n = sum(r.n for r in total)
    rows = [r for r in rows if r.n]
    levels: dict[str, list[str]] = {e: [] for e in effects}
    for r in rows:
        if len(present[r.set_id]) == 1:
            e = present[r.set_id][0]
            levels[e].append(r[e])
    terms = [(INTERCEPT, "")] + [(e, lv) for e in effects for lv in sorted(levels[e])]
    if len(terms) > MAX_PARAMETERS + 1:
        return None
    if n == 0:
        raise ValueError("no rows with a response")
    mean = total[0].sum_y / n
    off = F.col("mean") - F.lit(mean)
    tss = _used(cells, effects, response).agg(F.sum(F.col("css") + F.col("used") * off * off)).first()[0]
    at = {t: i for i, t in enumerate(terms)}
    xtx, xty = np.zeros((len(terms), len(terms))), np.zeros(len(terms))
    for r in rows:
        where = [at[(e, r[e])] for e in present[r.set_id]]
        if not where:
            xtx[0, 0] = r.n
        elif len(where) == 1:
            i = where[0]
            xtx[i, i] = xtx[0, i] = xtx[i, 0] = r.n
            xty[i] = r.sum_y - r.n * mean
        else:
            i, j = where
            xtx[i, j] = xtx[j, i] = r.n
    return CrossProducts(effects, terms, xtx, xty, int(n_read), n, float(mean), float(tss))


@dataclass
class Fit:
    effects: list[str]
    terms: list[tuple[str, str]]
    estimate: np.ndarray
    std_err: np.ndarray  # NaN where the term has no degree of freedom
    estimable: np.ndarray
    n_read: int
    n: int
    p: int
    sse: float
    tss: float
    steps: list[dict] = field(default_factory=list)

    @property
    def sbc(self) -> float:
        return sbc(self.sse, self.n, self.p)

    @property
    def mse(self) -> float:
        return self.sse / (self.n - self.p) if self.n > self.p else math.nan


def sbc(sse: float, n: int, p: int) -> float:
    return n * math.log(sse / n) + p * math.log(n) if sse > 0 else -math.inf


def fit_statistics(sse: float, tss: float, n: int, p: int) -> dict[str, float | None]:
    """Figures of a fit; null where a figure is undefined (a perfect or saturated fit, a constant target)."""
    model_df, error_df = p - 1, n - p
    mse = sse / error_df if error_df > 0 else None
    r2 = 1 - sse / tss if tss > 0 else None
    log = n * math.log(sse / n) if sse > 0 else None
    return {
        "root_mse": None if mse is None else math.sqrt(mse),
        "r_square": r2,
        "adj_r_square": None if r2 is None or error_df <= 0 else 1 - (n - 1) / error_df * (1 - r2),
        "aic": None if log is None else log + 2 * p + n + 2,
        "aicc": None if log is None or n - p - 2 <= 0 else log + n * (n + p) / (n - p - 2),
        "sbc": None if log is None else log + p * math.log(n),
        "ase": sse / n,
        "f_value": ((tss - sse) / model_df) / mse if model_df and mse else None if model_df else math.nan,
    }


def fit_effects(cp: CrossProducts, effects: Sequence[str]) -> Fit:
    cols = cp.columns(effects)
    xtx = cp.xtx[np.ix_(cols, cols)]
    beta, inverse, estimable = large_fit.solve(xtx, cp.xty[cols], np.diag(xtx))
    inverse = np.where(estimable, np.diag(inverse), np.nan)
    sse = max(cp.tss - float(beta @ cp.xty[cols]), 0.0)
    p = int(estimable.sum())
    mse = sse / (cp.n - p) if cp.n > p else math.nan
    estimate = beta.copy()
    estimate[0] += cp.mean
    return Fit(
        list(effects),
        [cp.terms[i] for i in cols],
        estimate,
        np.sqrt(inverse * mse),
        estimable,
        cp.n_read,
        cp.n,
        p,
        sse,
        cp.tss,
    )


@dataclass
class Step:
    """A model on the way of a selection, as far as choosing needs it."""

    effects: list[str]
    n: int
    p: int
    sse: float
    state: tuple | None = None

    @property
    def sbc(self) -> float:
        return sbc(self.sse, self.n, self.p)


class Swept:
    """Models that differ by one effect, by sweeping its columns in or out of one matrix.

    The matrix holds X'X, X'y and y'y; sweeping a column once takes it into
    the model, twice out again, each at the cost of one pass over the matrix.
    A column without a pivot depends on those in the model and stays out; it
    is tried again when others have left.
    """

    def __init__(self, cp: CrossProducts, tol: float = large_fit.TOLERANCE) -> None:
        self.cp = cp
        self.least = tol * np.maximum(np.diag(cp.xtx), 1.0)
        whole = np.zeros((len(cp.terms) + 1,) * 2)
        whole[:-1, :-1], whole[:-1, -1], whole[-1, :-1], whole[-1, -1] = cp.xtx, cp.xty, cp.xty, cp.tss
        self.whole = whole

    def _columns(self, effect: str) -> list[int]:
        return self.cp.columns([effect])[1:]

    def _enter(self, matrix: np.ndarray, inside: np.ndarray, columns: Sequence[int]) -> None:
        for k in columns:
            if not inside[k] and matrix[k, k] > self.least[k]:
                sweep(matrix, k)
                inside[k] = True

    def start(self, effects: Sequence[str]) -> Step:
        matrix, inside = self.whole.copy(), np.zeros(len(self.cp.terms), bool)
        self._enter(matrix, inside, self.cp.columns(effects))
        return self._step(list(effects), matrix, inside)

    def with_effect(self, step: Step, effect: str) -> Step:
        matrix, inside = (x.copy() for x in step.state)
        self._enter(matrix, inside, self._columns(effect))
        return self._step([*step.effects, effect], matrix, inside)

    def without_effect(self, step: Step, effect: str) -> Step:
        matrix, inside = (x.copy() for x in step.state)
        for k in self._columns(effect):
            if inside[k]:
                sweep(matrix, k)
                inside[k] = False
        rest = [e for e in step.effects if e != effect]
        self._enter(matrix, inside, self.cp.columns(rest))
        return self._step(rest, matrix, inside)

    def _step(self, effects: list[str], matrix: np.ndarray, inside: np.ndarray) -> Step:
        return Step(effects, self.cp.n, int(inside.sum()), max(float(matrix[-1, -1]), 0.0), (matrix, inside))


def sweep(matrix: np.ndarray, k: int) -> None:
    """Sweep a symmetric matrix on its ``k``-th diagonal element, in place; a second sweep undoes it."""
    pivot = matrix[k, k]
    row, column = matrix[k] / pivot, matrix[:, k].copy()
    matrix -= np.outer(column, row)
    matrix[k], matrix[:, k] = row, -column / pivot
    matrix[k, k] = 1.0 / pivot


class Refitted:
    """The same for fits that stay in Spark: each model is fitted from the settled cells."""

    def __init__(self, cells: large_fit.Cells) -> None:
        self.cells, self.fits = cells, {}

    def start(self, effects: Sequence[str]) -> Step:
        f = large_fit.fit_cells(self.cells, effects)
        self.fits[tuple(effects)] = f
        return Step(list(effects), f.n, f.p, f.sse)

    def with_effect(self, step: Step, effect: str) -> Step:
        return self.start([*step.effects, effect])

    def without_effect(self, step: Step, effect: str) -> Step:
        return self.start([e for e in step.effects if e != effect])


def select_steps(models: Swept | Refitted, effects: Sequence[str], method: str, horizon: int = STOP_HORIZON) -> tuple[list[Step], list[dict]]:
    """BACKWARD or FORWARD selection of whole effects by SBC: the models on the way, and a line for each.

    Each step takes the effect whose removal (entry) gives the lowest SBC; it
    ends when ``horizon`` steps in a row did not improve, or nothing is left.
    The step with the lowest SBC wins. No step reads the table again.
    """
    backward = method.upper() == "BACKWARD"
    if not backward and method.upper() != "FORWARD":
        raise ValueError("method must be BACKWARD or FORWARD")
    current = models.start(effects if backward else [])
    steps, moved, best, stale = [current], [""], current, 0
    while stale < horizon:
        options = current.effects if backward else [e for e in effects if e not in current.effects]
        if not options:
            break
        move = models.without_effect if backward else models.with_effect
        current, effect = min(((move(current, e), e) for e in options), key=lambda t: t[0].sbc)
        steps.append(current)
        moved.append(effect)
        if current.sbc < best.sbc:
            best, stale = current, 0
        else:
            stale += 1
    lines = [
        {
            "step": i,
            "effect": effect,
            "n_effects": len(s.effects) + 1,
            "n_parameters": s.p,
            "sbc": s.sbc,
            "is_optimal": s is best,
            "effects": s.effects,
        }
        for i, (s, effect) in enumerate(zip(steps, moved))
    ]
    return steps, lines


def select_effects(cp: CrossProducts, method: str, horizon: int = STOP_HORIZON) -> Fit:
    """The model that a selection ends with, by sweeping effects in and out of one matrix."""
    _, lines = select_steps(Swept(cp), cp.effects, method, horizon)
    best = fit_effects(cp, next(x["effects"] for x in lines if x["is_optimal"]))
    best.steps = lines
    return best


def fit(df: DataFrame, effects: Sequence[str], response: str, selection: str | None = None) -> Fit | LargeFit:
    """Fit a model with class effects; ``selection`` is None, BACKWARD or FORWARD. The table is read once."""
    cells = settle(level_cells(df, effects, response), "glm-cells")
    cp = collect_cross_products(cells, effects, response)
    if cp is not None:
        return select_effects(cp, selection) if selection else fit_effects(cp, effects)
    used = large_fit.used_cells(cells, effects, response)
    if not selection:
        return large_fit.fit_cells(used, effects)
    models = Refitted(used)
    _, lines = select_steps(models, list(effects), selection)
    best = models.fits[tuple(next(x["effects"] for x in lines if x["is_optimal"]))]
    best.steps = lines
    return best


# -- result tables ------------------------------------------------------------------


def _number(x: float) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


ESTIMATES = "effect string, level string, df int, estimate double, std_err double, t_value double, p_value double"


def _tests(error_df: int):
    """t values and their probabilities of estimates, row by row."""

    def tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            estimate, se = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            t = [x / s if s else None for x, s in zip(estimate, se)]
            p = [None if x is None or error_df <= 0 else t_p_value(x, error_df) for x in t]
            columns = [*batch.columns, pa.array(t, pa.float64()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "t_value", "p_value"])

    return tests


def parameter_estimates(spark: SparkSession, f: Fit | LargeFit) -> DataFrame:
    """A row for each level: df (0 for a reference), estimate, standard error, t value and probability."""
    if isinstance(f, LargeFit):
        mse = None if math.isnan(f.mse) else f.mse
        error = F.when(F.col("df") == 1, F.sqrt(F.col("factor") * F.lit(mse).cast("double"))).alias("std_err")
        return f.estimates.select("effect", "level", "df", "estimate", error).mapInArrow(_tests(f.n - f.p), ESTIMATES)
    lines = []
    for (effect, level), estimate, se, ok in zip(f.terms, f.estimate, f.std_err, f.estimable):
        t = estimate / se if ok and se and not math.isnan(se) else math.nan
        p = t_p_value(t, f.n - f.p) if not math.isnan(t) else math.nan
        lines.append(
            (effect, level, int(ok), float(estimate), _number(se if ok else math.nan), _number(t), _number(p))
        )
    return spark.createDataFrame(lines, ESTIMATES)


def selection_summary(spark: SparkSession, f: Fit | LargeFit) -> DataFrame:
    names = ["step", "effect", "n_effects", "n_parameters", "sbc", "is_optimal"]
    schema = "step int, effect string, n_effects int, n_parameters int, sbc double, is_optimal boolean"
    return spark.createDataFrame([tuple(s[c] for c in names) for s in f.steps], schema)


def simple_steps(spark: SparkSession, f: Fit | LargeFit) -> DataFrame:
    """The models with one effect or none on the way of a selection: their effect, parameters and SBC."""
    lines = [(",".join(s["effects"]), s["n_parameters"], s["sbc"]) for s in f.steps if len(s["effects"]) < 2]
    return spark.createDataFrame(lines, "effects string, n_parameters int, sbc double")


def anova(spark: SparkSession, f: Fit | LargeFit) -> DataFrame:
    model_df, error_df = f.p - 1, f.n - f.p
    ssm = f.tss - f.sse
    msm = ssm / model_df if model_df else math.nan
    value = msm / f.mse if model_df and f.mse else math.nan
    p = f_p_value(value, model_df, error_df) if not math.isnan(value) else math.nan
    lines = [
        ("Model", model_df, ssm, _number(msm), _number(value), _number(p)),
        ("Error", error_df, f.sse, _number(f.mse), None, None),
        ("Corrected Total", f.n - 1, f.tss, None, None, None),
    ]
    schema = "source string, df long, ss double, ms double, f_value double, p_value double"
    return spark.createDataFrame(lines, schema)


def fit_table(spark: SparkSession, f: Fit | LargeFit) -> DataFrame:
    stats = {"n_read": float(f.n_read), "n_used": float(f.n), "n_parameters": float(f.p)}
    stats |= fit_statistics(f.sse, f.tss, f.n, f.p)
    return spark.createDataFrame([(k, _number(v)) for k, v in stats.items()], "statistic string, value double")


# -- scoring -------------------------------------------------------------------------


def score(df: DataFrame, coefficients: DataFrame, effects: Sequence[str], out: str = "predicted") -> DataFrame:
    """Sum of the coefficients that apply to a row; a level without one gives null.

    Levels are joined as their size asks: small tables by broadcast, large ones
    by shuffle. The intercept is one number, so the same plan serves streams.
    """
    if not effects:
        raise ValueError("a model without effects predicts its intercept; nothing to join")
    intercept = coefficients.filter(F.col("effect") == INTERCEPT).agg(F.max("estimate")).first()[0]
    scored, total = df, F.lit(intercept).cast("double")
    for i, e in enumerate(effects):
        levels = coefficients.filter(F.col("effect") == e).select(F.col("level").alias(f"__level{i}"), F.col("estimate").alias(f"__term{i}"))
        scored = scored.join(levels, F.col(e) == F.col(f"__level{i}"), "left")
        total = total + F.col(f"__term{i}")
    extra = [c for i in range(len(effects)) for c in (f"__level{i}", f"__term{i}")]
    return scored.withColumn(out, total).drop(*extra)


# -- tail probabilities ----------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 1e-15
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (continued fraction)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: int) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, df1: int, df2: int) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))
