"""Date parts and reporting delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.rules import MAX_WEEKS, clip


def date_parts(accident: str = "DateTimeOfAccident", reported: str = "DateReported") -> dict[str, Column]:
    return {
        "YearOfAccident": F.year(accident),
        "MonthOfAccident": F.month(accident),
        "DayOfAccident": F.dayofmonth(accident),
        "WeekdayOfAccident": F.date_format(accident, "EEEE"),
        "HourOfAccident": F.hour(accident),
        "QuarterOfAccident": F.quarter(accident),
        "YearReported": F.year(reported),
    }


def report_delay(accident: str = "DateTimeOfAccident", reported: str = "DateReported") -> dict[str, Column]:
    """Whole days between the two dates (time of day dropped), and weeks up to a maximum."""
    days = F.datediff(F.to_date(reported), F.to_date(accident))
    weeks = F.floor(days / F.lit(7.0)).cast("int")
    return {"DaysReportDelay": days, "WeeksReportDelay": clip(weeks, high=MAX_WEEKS)}


def year_report_delay() -> Column:
    return clip(F.col("YearReported") - F.col("YearOfAccident"), 0, 1)
