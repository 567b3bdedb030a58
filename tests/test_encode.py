import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import encode
from millrace.operators.percentile import exact_percentile


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("small", [20_000, 10])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile_matches_numpy(spark, q, small):
    values = np.random.default_rng(5).lognormal(size=3000)
    df = table(spark, [(float(v),) for v in values] + [(None,)], "x double")
    assert exact_percentile(df, "x", q, small) == pytest.approx(np.percentile(values, q * 100), rel=1e-12)


@pytest.mark.parametrize("share", [0.2, 0.94, 0.95, 0.951, 0.99])
def test_percentile_with_a_hot_value(spark, share):
    n = 2000
    values = [1.0] * int(n * share) + [2.0 + i for i in range(n - int(n * share))]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    assert exact_percentile(df, "x", 0.95, small=10) == pytest.approx(np.percentile(values, 95), rel=1e-12)


def test_percentile_of_nothing(spark):
    assert exact_percentile(table(spark, [(None,)], "x double"), "x", 0.95) is None


def test_year_standard_uses_sample_deviation(spark):
    df = table(spark, [(2000, 1.0), (2000, 3.0), (2001, 5.0), (2002, 4.0), (2002, 4.0)], "YearOfAccident int, c double")
    by_year = encode.moments(df, ["YearOfAccident"], ["c"])
    got = {(r.YearOfAccident, r.c): r.z for r in encode.apply_year_standard(df, by_year, "c", "z").collect()}
    assert got[(2000, 3.0)] == pytest.approx(1 / math.sqrt(2))
    assert got[(2001, 5.0)] is None and got[(2002, 4.0)] is None


def test_centring_uses_population_deviation(spark):
    df = table(spark, [(1.0, 7), (3.0, 7), (None, 7)], "x double, k int")
    centred = encode.centred_columns(encode.moments(df, [], ["x", "k"]), ["x", "k"])
    rows = df.select(*[c.alias(n) for n, c in centred.items()]).collect()
    assert sorted((r.x for r in rows if r.x is not None)) == [-1.0, 1.0]
    assert all(r.k is None for r in rows)


def test_moments_roll_up_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(1e6 + v)) for a, b, v in zip(rng.integers(0, 3, 500), rng.integers(0, 5, 500), rng.normal(size=500))]
    df = table(spark, rows, "a int, b int, x double")
    cells = encode.moments(df, ["a", "b"], ["x"])
    for keys in (["a"], []):
        fine = {tuple(r[k] for k in keys): r for r in encode.moments(df, keys, ["x"]).collect()}
        for r in encode.roll_up(cells, keys, ["x"]).collect():
            want = fine[tuple(r[k] for k in keys)]
            assert (r.n, r.x__n) == (want.n, want.x__n)
            assert r.x__mean == pytest.approx(want.x__mean, rel=1e-12)
            assert r.x__css == pytest.approx(want.x__css, rel=1e-6)


def test_rare_levels(spark):
    df = table(spark, [("a",)] * 3 + [("b",)] + [("Unknown",)] * 5, "c string")
    kept = encode.fit_rare_levels(df.groupBy("c").agg(F.count("*").alias("n")), "c", 3)
    new = table(spark, [("a",), ("b",), ("Unknown",), ("z",)], "c string")
    assert sorted(r.c for r in encode.apply_rare_levels(new, kept, "c").collect()) == ["Others", "Others", "Others", "a"]


def test_target_encoding_formula(spark):
    train = table(spark, [("a", 1.0), ("a", 3.0), ("b", 8.0)], "c string, y double")
    levels = encode.moments(train, ["c"], ["y"])
    prior = encode.target_prior(levels, "y")
    fitted = encode.fit_target_encoding(levels, "c", "y", prior, min_samples_leaf=1, smoothing=1)
    got = {r.c: r.e for r in encode.apply_target_encoding(table(spark, [("a",), ("b",), ("z",)], "c string"), fitted, "c", "e", prior).collect()}
    w = 1 / (1 + math.exp(-1))
    assert got["a"] == pytest.approx(4 * (1 - w) + 2 * w)
    assert got["b"] == pytest.approx(4 * 0.5 + 8 * 0.5)
    assert got["z"] == 4.0


def test_noise_is_normal_and_repeatable(spark):
    df = spark.range(4000).select("id", F.lit(10.0).alias("x"))

    def noisy(rows, seed):
        return rows.select("id", encode.add_noise(F.col("x"), 0.01, F.col("id"), seed).alias("y"))

    row = noisy(df, 3).agg(F.avg("y").alias("m"), F.stddev("y").alias("s"), F.kurtosis("y").alias("k")).first()
    assert row.m == pytest.approx(10, abs=0.01) and row.s == pytest.approx(0.1, rel=0.05) and abs(row.k) < 0.5
    assert noisy(df, 3).exceptAll(noisy(df.repartition(7), 3)).count() == 0
    assert noisy(df, 3).join(noisy(df, 4), ["id", "y"]).count() == 0


def test_frequency_of_unseen_level(spark):
    levels = table(spark, [("a", 4)], "c string, n long")
    got = encode.apply_frequency_encoding(table(spark, [("a",), ("z",)], "c string"), levels, "c", "k")
    assert {r.c: r.k for r in got.collect()} == {"a": 4, "z": 1}


def test_severity_includes_the_threshold(spark):
    df = table(spark, [(1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(encode.severity_flag(F.col("x"), 2.0)).collect()] == [0, 1, 0]
