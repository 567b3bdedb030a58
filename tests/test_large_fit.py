"""Fits with many levels against direct least squares and against the fit on the driver."""

import math

import numpy as np
import pytest

from millrace.operators import glm, large_fit
from millrace.operators.levels import number_rows


def table(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c string, y double").repartition(4)


def make(kind, n=500):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a, b, c = int(rng.integers(0, 40)), int(rng.integers(0, 5)), int(rng.integers(0, 3))
        if kind == "nested":  # a determines b
            b = a % 5
        if kind == "two graphs":  # levels of a and c fall apart into groups that never meet
            c = c * 2 + a % 2
        if kind == "rare" and i % 50 == 0:
            a = 1000 + i
        rows.append((f"a{a:04d}", f"b{b}", f"c{c}", float(a % 7 + 2 * b - c + rng.normal())))
    return rows + [("a0001", None, "c0", 5.0), ("a0001", "b1", "c0", None), (None, "b1", "c1", 2.0)]


def direct(rows, effects):
    used = [r for r in rows if None not in r]
    at, y = {"a": 0, "b": 1, "c": 2}, np.array([r[3] for r in used])
    names = [("Intercept", "")] + [(e, lv) for e in effects for lv in sorted({r[at[e]] for r in used})]
    x = np.array([[1.0 if e == "Intercept" else float(r[at[e]] == lv) for e, lv in names] for r in used])
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return names, x, y, x @ beta, int(rank)


def cells(df, effects=("a", "b", "c")):
    return large_fit.used_cells(glm.level_cells(df, list(effects), "y"), list(effects), "y")


@pytest.mark.parametrize("kind", ["nested", "two graphs", "rare"])
@pytest.mark.parametrize("effects", [["a", "b", "c"], ["c", "a"]])
def test_absorbing_one_effect_gives_the_least_squares_fit(spark, kind, effects):
    rows = make(kind)
    df = table(spark, rows)
    f = large_fit.fit_cells(cells(df), effects)
    names, x, y, fitted, rank = direct(rows, effects)
    assert (f.n_read, f.n, f.p) == (503, 500, rank)
    assert f.sse == pytest.approx(float(((y - fitted) ** 2).sum()), rel=1e-9)
    got = {(r.effect, r.level): r for r in glm.parameter_estimates(spark, f).collect()}
    assert set(got) == set(names)
    assert np.allclose(x @ np.array([got[t].estimate for t in names]), fitted)
    free = [i for i, t in enumerate(names) if got[t].df == 1]
    assert len(free) == rank
    covariance = np.linalg.inv(x[:, free].T @ x[:, free]) * f.mse
    assert np.allclose([got[names[i]].std_err for i in free], np.sqrt(np.diag(covariance)))
    for t in names:
        if got[t].df == 0:
            assert got[t].estimate == 0 and got[t].std_err is None and got[t].p_value is None
    i = free[-1]
    t = got[names[i]].estimate / math.sqrt(covariance[-1, -1])
    assert got[names[i]].t_value == pytest.approx(t) and got[names[i]].p_value == pytest.approx(glm.t_p_value(t, f.n - f.p))


@pytest.mark.parametrize("kind, effects", [("plain", ["a", "b", "c"]), ("nested", ["a", "b"]), ("two graphs", ["a", "c"])])
def test_gradients_find_the_same_fit(spark, kind, effects):
    rows = make(kind)
    f = large_fit.fit_cells(cells(table(spark, rows)), effects, dense=0)
    names, x, y, fitted, rank = direct(rows, effects)
    assert f.p == rank and f.iterations < 60
    assert f.sse == pytest.approx(float(((y - fitted) ** 2).sum()), rel=1e-9)
    got = {(r.effect, r.level): r.estimate for r in f.estimates.collect()}
    assert np.allclose(x @ np.array([got[t] for t in names]), fitted, atol=1e-6)
    assert all(got[(e, max(lv for o, lv in names if o == e))] == 0 for e in effects)


def test_a_fit_beyond_the_driver_is_the_fit_on_it(spark, monkeypatch):
    df = table(spark, make("plain"))
    for selection in (None, "BACKWARD", "FORWARD"):
        monkeypatch.setattr(glm, "MAX_PARAMETERS", 500)
        small = glm.fit(df, ["a", "b", "c"], "y", selection)
        monkeypatch.setattr(glm, "MAX_PARAMETERS", 20)
        large = glm.fit(df, ["a", "b", "c"], "y", selection)
        assert isinstance(small, glm.Fit) and isinstance(large, glm.LargeFit)
        assert [(s["effect"], s["n_parameters"], s["is_optimal"], round(s["sbc"], 7)) for s in small.steps] == [
            (s["effect"], s["n_parameters"], s["is_optimal"], round(s["sbc"], 7)) for s in large.steps
        ]
        rows = [sorted((r.effect, r.level, r.df, round(r.estimate, 7), r.std_err and round(r.std_err, 7)) for r in glm.parameter_estimates(spark, f).collect()) for f in (small, large)]
        assert rows[0] == rows[1]
        for made in (glm.fit_table, glm.anova, glm.simple_steps):
            figures = [[tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in made(spark, f).collect()] for f in (small, large)]
            assert figures[0] == figures[1]


def test_odd_inputs(spark):
    one = [("a", "b", "c", float(i)) for i in range(5)]
    f = large_fit.fit_cells(cells(table(spark, one)), ["a", "b"])
    assert f.p == 1 and f.sse == pytest.approx(10.0)
    assert large_fit.fit_cells(cells(table(spark, one)), ["a", "b"], dense=0).sse == pytest.approx(10.0)
    nothing = table(spark, [("a", "b", None, None)])
    with pytest.raises(ValueError):
        cells(nothing)


@pytest.mark.parametrize("edges, n", [([(1, 10), (2, 10), (3, 11)], 2), ([(i, 100 + i) for i in range(30)] + [(i + 1, 100 + i) for i in range(29)], 1), ([(i, 100 + i) for i in range(9)], 9)])
def test_components_of_the_level_graph(spark, edges, n):
    assert large_fit.n_components(spark.createDataFrame(edges, "a long, b long")) == n


def test_numbers_follow_the_order(spark):
    rows = [(k, v) for k in "ab" for v in range(50)]
    got = number_rows(spark.createDataFrame(rows[::-1], "k string, v int").repartition(7), ["k", "v"], "no").collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.no)] == rows and [r.no for r in sorted(got, key=lambda r: r.no)] == list(range(100))
    assert number_rows(spark.createDataFrame([], "k string"), ["k"], "no").count() == 0


def test_sweeping_twice_changes_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 5))
    a = x.T @ x
    b = a.copy()
    for k in (2, 0, 4, 0, 2, 4):
        glm.sweep(b, k)
    assert np.allclose(a, b)
    for k in range(5):
        glm.sweep(b, k)
    assert np.allclose(b, np.linalg.inv(a))
