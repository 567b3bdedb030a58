import math

import numpy as np
import pytest

from millrace.operators import glm

# Figures of a published run: 9678 rows used, 34 parameters.
SSE, SST, N, P = 5.022091e15, 5.217414e15, 9678, 34


def test_fit_statistics_reproduce_published_figures():
    s = glm.fit_statistics(SSE, SST, N, P)
    assert s["sbc"] == pytest.approx(261376.2, abs=0.1)
    assert s["aic"] == pytest.approx(270812.2, abs=0.1)
    assert s["aicc"] == pytest.approx(270812.4, abs=0.1)
    assert s["root_mse"] == pytest.approx(721629, abs=1)
    assert s["r_square"] == pytest.approx(0.03744, abs=1e-5)
    assert s["adj_r_square"] == pytest.approx(0.03414, abs=1e-5)
    assert s["ase"] == pytest.approx(5.189183e11, rel=1e-6)
    assert s["f_value"] == pytest.approx(11.37, abs=0.01)
    assert glm.sbc(SST, N, 1) == pytest.approx(261442.6, abs=0.1)


def test_tail_probabilities():
    assert glm.t_p_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert glm.t_p_value(0.0, 5) == pytest.approx(1.0)
    assert glm.f_p_value(4.0, 2, 20) == pytest.approx((20 / 28) ** 10, rel=1e-9)
    assert glm.f_p_value(4.0, 1, 10) == pytest.approx(glm.t_p_value(2.0, 10), rel=1e-9)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(600):
        a, b, c = rng.integers(0, 3), rng.integers(0, 4), rng.integers(0, 2)
        rows.append((f"a{a}", f"b{b}", f"c{c}", float(5 + 3 * a + 0.2 * (b == 1) + rng.normal())))
    rows += [("a0", "b0", None, 1.0), ("a0", "b0", "c0", None)]
    return rows, spark.createDataFrame(rows, "a string, b string, c string, y double").repartition(4)


def direct(rows, effects):
    used = [r for r in rows if None not in r]
    y = np.array([r[3] for r in used])
    at = {"a": 0, "b": 1, "c": 2}
    x = [np.ones(len(used))]
    for e in effects:
        for level in sorted({r[at[e]] for r in used}):
            x.append(np.array([float(r[at[e]] == level) for r in used]))
    x = np.array(x).T
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum()), int(rank), x, y


def test_full_fit_matches_direct_least_squares(spark, data):
    rows, df = data
    f = glm.fit(df, ["a", "b", "c"], "y")
    sse, rank, x, y = direct(rows, ["a", "b", "c"])
    assert (f.n_read, f.n, f.p) == (602, 600, rank)
    assert f.sse == pytest.approx(sse, rel=1e-9)
    assert np.allclose(x @ f.estimate, x @ np.linalg.lstsq(x, y, rcond=None)[0])
    last = {t: ok for t, ok in zip(f.terms, f.estimable)}
    assert not last[("a", "a2")] and not last[("b", "b3")] and not last[("c", "c1")]
    keep = f.estimable
    covariance = np.linalg.inv(x[:, keep].T @ x[:, keep]) * f.mse
    assert np.allclose(f.std_err[keep], np.sqrt(np.diag(covariance)))


def test_selection(spark, data):
    rows, df = data
    cp = glm.collect_cross_products(glm.level_cells(df, ["a", "b", "c"], "y"), ["a", "b", "c"], "y")
    back, forth = glm.select_effects(cp, "BACKWARD"), glm.select_effects(cp, "FORWARD")
    assert back.effects == forth.effects == ["a"]
    assert [s["n_effects"] for s in back.steps] == [4, 3, 2, 1]
    assert forth.steps[1]["effect"] == "a"
    sse, rank, _, y = direct(rows, ["a"])
    assert back.sbc == pytest.approx(600 * math.log(sse / 600) + rank * math.log(600), rel=1e-9)
    assert sum(s["is_optimal"] for s in back.steps) == 1
    with pytest.raises(ValueError):
        glm.select_effects(cp, "STEPWISE")


def test_tables(spark, data):
    _, df = data
    f = glm.fit(df, ["a", "b", "c"], "y", "BACKWARD")
    source = {r.source: r for r in glm.anova(spark, f).collect()}
    assert source["Model"].ss + source["Error"].ss == pytest.approx(source["Corrected Total"].ss)
    assert source["Model"].df + source["Error"].df == source["Corrected Total"].df
    assert source["Model"].p_value < 1e-6
    assert glm.parameter_estimates(spark, f).filter("df = 0 and estimate = 0").count() == 1


def test_nested_effects_lose_rank(spark):
    rows = [(g, f"{g}{h}", float(i % 7 + ord(g))) for i, (g, h) in enumerate([(g, h) for g in "xyz" for h in "pq"] * 9)]
    df = spark.createDataFrame(rows, "g string, h string, y double")
    assert glm.fit(df, ["g", "h"], "y").p == 6


def test_score_of_several_effects_and_unseen_level(spark, data):
    _, df = data
    f = glm.fit(df, ["a", "b"], "y")
    coefficients = glm.parameter_estimates(spark, f)
    new = spark.createDataFrame([("a1", "b2"), ("a9", "b2")], "a string, b string")
    got = {r.a: r.predicted for r in glm.score(new, coefficients, ["a", "b"]).collect()}
    value = dict(zip(f.terms, f.estimate))
    assert got["a1"] == pytest.approx(value[("Intercept", "")] + value[("a", "a1")] + value[("b", "b2")])
    assert got["a9"] is None


def test_selected_model_of_emissions(spark):
    from millrace.plans.queries import _year_fit

    f = _year_fit(spark, "/root/testdata/sf0.01", selection="BACKWARD")
    assert [round(s["sbc"], 3) for s in f.steps] == [67607.947, 67412.928, 67220.012, 67965.574]
    assert f.effects == ["activity_desc"] and (f.n, f.p) == (7487, 6)
    assert f.sse == pytest.approx(58938488.774, abs=0.01)
    assert f.estimate[0] == pytest.approx(205.13588, abs=1e-5)
    at = f.terms.index(("activity_desc", "ECONOMY"))
    assert f.estimate[at] == pytest.approx(-24.331888, abs=1e-6)
    assert f.std_err[at] == pytest.approx(3.584277, abs=1e-6)
