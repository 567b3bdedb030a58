"""Top rows, overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, condition: Column, order: Sequence[Column | str], k: int = 5) -> DataFrame:
    """First ``k`` rows that meet a condition: each task keeps k, nothing is sorted as a whole."""
    return df.filter(condition).orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column | str], k: int = 5) -> DataFrame:
    """First ``k`` rows of every group, with their rank.

    Spark limits each group to k rows before the shuffle, so a hot group sends
    k rows per task and no more.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
