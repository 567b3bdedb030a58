"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors of unequal length give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def is_finite(v: Column) -> Column:
    """Whether a vector is there and has only finite numbers; false for null, NaN and infinite elements."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def pack(json_text: Column) -> Column:
    """JSON text of a number list to a vector."""
    return F.from_json(json_text, "array<float>")
