"""Which keys are common enough to be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_common(counts: DataFrame, column: str, start: int, most: int) -> int:
    """The count from which keys are common: ``start``, doubled until at most ``most`` keys are left; one pass over the keys."""
    start = max(start, 1)
    turn = F.length(F.bin(F.floor(F.col(column) / start)))
    keys = counts.filter(F.col(column) >= start).groupBy(turn.alias("turn")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    turn = 1
    while sum(r.n for r in keys if r.turn >= turn) > most:
        turn += 1
    return start * 2 ** (turn - 1)
