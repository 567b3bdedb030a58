"""Fit and apply: level statistics, encodings, standardising, severity.

All fits start from *moments*: count, mean and corrected sum of squares per
group. Moments of fine groups combine exactly into moments of coarser ones,
so one pass over the data can feed every fit (see ``plans.abt``). Grouping
aggregates map-side first; a group that holds a third of all rows arrives at
its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTRED = [
    "Age",
    "WeeklyWages",
    "HoursWorkedPerWeek",
    "HourlyWages",
    "DaysReportDelay",
    "ClaimNumberInt",
    "DailyWages",
    "AnnualWages",
]


def moments(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per group: ``n`` rows, and for each measure its count, mean and corrected sum of squares."""
    aggs = [F.count("*").alias("n")]
    for m in measures:
        x = F.col(m).cast("double")
        aggs += [
            F.count(m).alias(f"{m}__n"),
            F.avg(x).alias(f"{m}__mean"),
            (F.var_pop(x) * F.count(m)).alias(f"{m}__css"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def roll_up(cells: DataFrame, keys: Sequence[str], measures: Sequence[str], spread: bool = True) -> DataFrame:
    """Moments of coarser groups from moments of finer ones; ``spread`` asks for the css too.

    The corrected sum of squares is the part within the fine groups plus the
    part between them, both sums of squares of deviations, so nothing cancels.
    It takes the coarse means first: numbers when there is one group, else a
    broadcast of one row per coarse group (years, levels of a word list).
    """

    def part(m: str, name: str) -> Column:
        return F.col(f"{m}__{name}")

    counts = [F.sum("n").alias("n"), *[F.sum(part(m, "n")).alias(f"{m}__n") for m in measures]]
    means = [
        F.try_divide(F.sum(part(m, "n") * part(m, "mean")), F.sum(part(m, "n"))).alias(f"{m}__mean") for m in measures
    ]
    sums = cells.groupBy(*keys).agg(*counts, *means)
    if not spread or not measures:
        return sums
    if keys:
        coarse = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], *[part(m, "mean").alias(f"{m}__all") for m in measures])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        based = cells.join(F.broadcast(coarse), same)
    else:
        overall = sums.first()
        based = cells.withColumns({f"{m}__all": F.lit(overall[f"{m}__mean"]).cast("double") for m in measures})
    aggs = list(counts)
    for m in measures:
        off = part(m, "mean") - part(m, "all")
        aggs += [F.max(part(m, "all")).alias(f"{m}__mean"), F.sum(part(m, "css") + part(m, "n") * off * off).alias(f"{m}__css")]
    return based.groupBy(*keys).agg(*aggs)


def std_pop(measure: str) -> Column:
    return F.sqrt(F.try_divide(F.col(f"{measure}__css"), F.col(f"{measure}__n")))


def std_samp(measure: str) -> Column:
    """Sample deviation; null for a single row."""
    n = F.col(f"{measure}__n")
    return F.when(n > 1, F.sqrt(F.try_divide(F.col(f"{measure}__css"), n - 1)))


# -- rare levels and encodings -------------------------------------------------


def fit_rare_levels(levels: DataFrame, column: str, min_count: int = 100) -> DataFrame:
    """Levels to keep, from a table (column, n): often enough, and not ``Unknown``."""
    return levels.filter((F.col("n") >= min_count) & (F.col(column) != "Unknown")).select(column)


def apply_rare_levels(df: DataFrame, kept: DataFrame, column: str, other: str = "Others") -> DataFrame:
    marked = kept.select(F.col(column).alias("__level"))
    value = F.when(F.col("__level").isNotNull(), F.col(column)).otherwise(other)
    return (
        df.join(marked, F.col(column) == F.col("__level"), "left")
        .withColumn(column, value)
        .drop("__level")
    )


def target_prior(levels: DataFrame, target: str) -> float | None:
    """Overall mean of the target, from the moments of its levels."""
    n = F.col(f"{target}__n")
    return levels.agg(F.try_divide(F.sum(n * F.col(f"{target}__mean")), F.sum(n))).first()[0]


def smoothed(target: str, prior: float | None, min_samples_leaf: float = 100, smoothing: float = 10) -> Column:
    """Level mean drawn to the prior, the more so the fewer rows a level has."""
    n, mean = F.col(f"{target}__n"), F.col(f"{target}__mean")
    weight = 1 / (1 + F.exp(-(n - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    return F.lit(prior).cast("double") * (1 - weight) + mean * weight


def fit_target_encoding(
    levels: DataFrame,
    column: str,
    target: str,
    prior: float | None,
    min_samples_leaf: float = 100,
    smoothing: float = 10,
) -> DataFrame:
    """Encoding (level, average) from the moments of the target per level."""
    return levels.select(column, smoothed(target, prior, min_samples_leaf, smoothing).alias("average"))


def apply_target_encoding(
    df: DataFrame,
    fitted: DataFrame,
    column: str,
    out: str,
    prior: float | None,
    noise_level: float = 0.0,
    seed: int = 0,
    key: str | None = None,
) -> DataFrame:
    """Left join to the fitted levels; a level that was not fitted gets the prior.

    Noise, if any, is drawn by the row's ``key``.
    """
    pairs = fitted.select(F.col(column).alias("__level"), F.col("average").alias("__average"))
    value = F.coalesce(F.col("__average"), F.lit(prior).cast("double"))
    if noise_level:
        value = add_noise(value, noise_level, F.col(key), seed)
    return (
        df.join(pairs, F.col(column) == F.col("__level"), "left")
        .withColumn(out, value)
        .drop("__level", "__average")
    )


def gaussian(key: Column, seed: int = 0) -> Column:
    """A standard normal number per key and seed (Box-Muller on two hashes).

    Unlike ``randn`` it does not depend on how rows are spread or ordered, so
    a task that runs again gives the same numbers. The 52 bits of a draw come
    from md5, which other engines have too.
    """
    span = 1 << 52

    def uniform(n: int) -> Column:
        digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(str(n))))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(span + 1))

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))


def add_noise(value: Column, noise_level: float, key: Column, seed: int = 0) -> Column:
    """Multiply by 1 + level * N(0, 1)."""
    return value * (1 + F.lit(noise_level) * gaussian(key, seed))


def apply_frequency_encoding(df: DataFrame, levels: DataFrame, column: str, out: str) -> DataFrame:
    """Count of each level in the fitted table (column, n); an unseen level gives 1."""
    pairs = levels.select(F.col(column).alias("__level"), F.col("n").alias("__n"))
    return (
        df.join(pairs, F.col(column) == F.col("__level"), "left")
        .withColumn(out, F.coalesce(F.col("__n"), F.lit(1).cast("long")))
        .drop("__level", "__n")
    )


# -- standardising ---------------------------------------------------------------


def apply_year_standard(
    df: DataFrame, by_year: DataFrame, measure: str, out: str, year: str = "YearOfAccident"
) -> DataFrame:
    """z-score within the year; a single row or no spread gives null.

    ``by_year`` has one row per calendar year, which bounds the broadcast.
    """
    stats = by_year.select(
        F.col(year).alias("__year"), F.col(f"{measure}__mean").alias("__mean"), std_samp(measure).alias("__std")
    )
    return (
        df.join(F.broadcast(stats), F.col(year) == F.col("__year"), "left")
        .withColumn(out, F.try_divide(F.col(measure) - F.col("__mean"), F.col("__std")))
        .drop("__year", "__mean", "__std")
    )


def centred_columns(overall: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """(x - mean) / population deviation for each column; no spread gives null.

    ``overall`` is one row of moments, read here: two numbers per column.
    """
    parts = [x.alias(f"{c}__{name}") for c in columns for name, x in (("m", F.col(f"{c}__mean")), ("s", std_pop(c)))]
    stats = overall.select(*parts).first()

    def number(name: str) -> Column:
        return F.lit(stats[name]).cast("double")

    return {c: F.try_divide(F.col(c) - number(f"{c}__m"), number(f"{c}__s")) for c in columns}


def severity_flag(value: Column, threshold: float | None) -> Column:
    return F.coalesce(value >= F.lit(threshold).cast("double"), F.lit(False)).cast("int")
