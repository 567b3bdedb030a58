"""Exact percentile with linear interpolation, for columns of any size.

The built-in exact ``percentile`` merges all distinct values into one task.
Here each round asks a sketch for two values close to the wanted rank and
*counts* the rows below, at, between and at them, so the answer is proven and
never estimated. A round shrinks the rows in question by a factor of some
thousand, ties included: rows equal to either value are settled by their
count. Once few rows are left they are sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_percentile(df: DataFrame, column: str | Column, q: float, small: int = 20_000) -> float | None:
    """The ``q`` quantile (0 to 1) of the non-null values, None without values."""
    value = F.col(column) if isinstance(column, str) else column
    values = df.select(value.cast("double").alias("v")).filter("v is not null")
    first = values.agg(F.count("*").alias("n"), _around(q).alias("near")).first()
    if first.n == 0:
        return None
    position = q * (first.n - 1)
    rank = math.floor(position)
    low, high = value_at_rank(values, rank, first.n, first.near, small)
    if position == rank:
        return low
    if high is None:
        high = values.filter(F.col("v") > low).agg(F.min("v")).first()[0]
    return low + (high - low) * (position - rank)


def _around(share: float, slack: float = 2.0) -> Column:
    """Two values of the sketch, a little below and above a share of the ranks."""
    points = [max(0.0, share - slack / ACCURACY), min(1.0, share + slack / ACCURACY)]
    return F.percentile_approx("v", points, ACCURACY)


def value_at_rank(
    values: DataFrame, rank: int, total: int, near: list[float], small: int = 20_000
) -> tuple[float, float | None]:
    """The value at a 0-based rank of ``v``, and the next one in order where it was met on the way."""
    v = F.col("v")
    band, below, inside, slack, end = values, 0, total, 2.0, None
    while inside > small:
        low, high = near
        n = band.agg(
            F.count_if(v < low).alias("less"),
            F.count_if(v == low).alias("at_low"),
            F.count_if((v > low) & (v < high)).alias("between"),
            F.count_if((v == high) & F.lit(high > low)).alias("at_high"),
        ).first()
        place = rank - below - n.less
        if place < 0 or place >= n.at_low + n.between + n.at_high:
            slack *= 2  # the sketch missed the rank: look wider
        elif place < n.at_low:
            return low, low if place + 1 < n.at_low else None
        elif place >= n.at_low + n.between:
            return high, high if place + 1 < n.at_low + n.between + n.at_high else None
        else:
            band, end = band.filter((v > low) & (v < high)), high
            below, inside = below + n.less + n.at_low, n.between
        if inside > small:
            near = band.agg(_around((rank - below) / inside, slack).alias("near")).first().near
    found = None
    for row in band.groupBy("v").count().orderBy("v").collect():  # at most ``small`` rows
        if found is not None:
            return found, row.v
        below += row["count"]
        if below > rank:
            found = row.v
            if below > rank + 1:
                return found, found
    if found is None:
        raise ValueError("the values changed between passes")
    return found, end
