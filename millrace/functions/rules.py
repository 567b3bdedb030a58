"""Row rules: fills, recodes, guarded ratios, clips, code maps, column roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes used for the interaction columns.
GENDER_CODES = {"M": 1, "F": 2, "S": 3}
MARITAL_CODES = {"S": 1, "M": 2, "U": 3}
PART_FULL_CODES = {"F": 1, "P": 2}

COST_CAP = 1_000_000.0
MAX_WEEKS = 55


def fill_missing(df: DataFrame, value: str = "S") -> DataFrame:
    """Put ``value`` where text is missing (numbers and dates are left alone)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(value, subset=texts)


def recode(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.na.replace({old: new}, subset=[column])


def guarded_ratio(top: Column, bottom: Column, valid: Column, otherwise: float = -1.0) -> Column:
    """``top / bottom`` where ``valid`` holds, else a sentinel."""
    return F.when(valid, F.try_divide(top, bottom)).otherwise(F.lit(otherwise))


def wage_columns() -> dict[str, Column]:
    weekly, hours, days = (F.col(c) for c in ("WeeklyWages", "HoursWorkedPerWeek", "DaysWorkedPerWeek"))
    return {
        "HourlyWages": guarded_ratio(weekly, hours, hours.between(5.0, 100.0)),
        "DailyWages": guarded_ratio(weekly, days, days > 0),
        "AnnualWages": weekly * 52,
    }


def total_dependents() -> Column:
    return F.col("DependentChildren") + F.col("DependentsOther")


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]. ``least``/``greatest`` skip nulls, so null is kept by hand."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def claim_number_int(column: str = "ClaimNumber") -> Column:
    """Digits after the two-letter prefix; null if they are not a number."""
    return F.expr(f"try_cast(substring({column}, 3) as bigint)")


def code(column: str, codes: Mapping[str, int]) -> Column:
    """Map values to numbers; a value without a code gives null."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def interaction_columns() -> dict[str, Column]:
    marital = code("MaritalStatus", MARITAL_CODES)
    return {
        "GenderMarital_int": code("Gender", GENDER_CODES) * marital,
        "PartFullMarital_int": code("PartTimeFullTime", PART_FULL_CODES) * marital,
    }


def replace_with_min(df: DataFrame, column: str, marker: float = 1.0, source: DataFrame | None = None) -> DataFrame:
    """Where ``column`` equals ``marker``, put the minimum of the other rows.

    The minimum is a scalar subquery: one aggregate, then a plain projection.
    ``source`` may name a cheaper table with the same minimum, such as the
    rows before duplicates were dropped.
    """
    value = F.col(column)
    least = (source or df).agg(F.min(F.when(value != marker, value)).alias("m")).select("m").scalar()
    return df.withColumn(column, F.when(value == marker, least).otherwise(value))


def drop_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix) and c not in keep])


def column_roles(df: DataFrame, not_binned: Sequence[str], max_levels: int = 25) -> DataFrame:
    """Which columns are numeric, numeric without binning, or categorical.

    Categorical means text with at most ``max_levels`` distinct values. A
    sketch first rules out columns with clearly more: with ``n`` distinct
    values at most ``n`` sketch registers are set, so an estimate above four
    times the limit proves the column is over it. Only the rest is counted
    exactly, and those few values vanish in the map-side aggregation.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    levels: dict[str, int] = {}
    if texts:
        rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first()
        few = [c for c in texts if rough[c] <= 4 * max_levels]
        if few:
            levels = df.agg(*[F.count_distinct(c).alias(c) for c in few]).first().asDict()
    lines = []
    for pos, field in enumerate(df.schema.fields, 1):
        name = field.name
        numeric = isinstance(field.dataType, T.NumericType) and "Cost" not in name
        categorical = name in levels and levels[name] <= max_levels
        lines.append(
            (
                pos,
                name,
                numeric,
                numeric and name not in not_binned,
                categorical,
                levels[name] if categorical else None,
            )
        )
    schema = "position int, column_name string, is_num boolean, is_num_nobins boolean, is_cat boolean, n_levels long"
    return df.sparkSession.createDataFrame(lines, schema)
