"""Interim tables that report on themselves while they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from millrace.session import settle


def settle_with(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``settle``, and aggregates over the rows, taken in the same pass."""
    seen = Observation()
    table = settle(df.observe(seen, *[c.alias(name) for name, c in figures.items()]), label)
    return table, seen.get
