"""Claims and emissions tables derived from the order tables.

The input data holds no claims and no emissions, so two projections stand in
for them. Both keep every row of the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table

# One description for each remainder of the order key, 0 to 15.
DESCRIPTIONS = [
    "STRESS",
    "STRUCK LEFT KNEE WITH HAMMER",
    "LIFTING BOX LOWER BACK STRAIN",
    "FOREIGN BODY REMOVED",
    "FELL FROM LADDER NECK BACK ANKLE FOOT",
    "LACERATED RIGHT FINGER",
    "PSYCHOLOGICAL TRAUMA",
    "CARPEL TUNNEL",
    "STRUCK BY TRUCK",
    "WORKPLACE STRESS",
    "SOFT TISSUE SHOULDER  WRIST",
    "BURNT HAND DRIVING",
    "BENT KNEE",
    "FOREIGN BODY IN EYE",
    "ACUTE WORK STRESS",
    "UNSPECIFIED",
]

CLAIM_SCHEMA = """ClaimNumber string, DateTimeOfAccident timestamp_ntz, DateReported date, Age int,
    Gender string, MaritalStatus string, DependentChildren int, DependentsOther int,
    WeeklyWages double, PartTimeFullTime string, HoursWorkedPerWeek double,
    DaysWorkedPerWeek int, ClaimDescription string, InitialIncurredCalimsCost double,
    UltimateIncurredClaimCost double, split string"""


def _by_remainder(key: str, modulus: int, values: dict[int, str | None], other: str) -> Column:
    rest = F.col(key) % modulus
    out = None
    for remainder, value in values.items():
        branch = (rest == remainder, F.lit(value).cast("string"))
        out = F.when(*branch) if out is None else out.when(*branch)
    return out.otherwise(other)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Insurance claims, one per order; ``split`` marks train and test rows."""
    cust, order, price = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        # pads to seven digits, and never cuts a longer key
        F.expr(
            "concat('WC', lpad(cast(o_orderkey as string), greatest(7, length(cast(o_orderkey as string))), '0'))"
        ).alias("ClaimNumber"),
        F.make_timestamp_ntz(
            F.year(day), F.month(day), F.dayofmonth(day), (order % 24).cast("int"), F.lit(0), F.lit(0)
        ).alias("DateTimeOfAccident"),
        F.date_add(day, (cust % 500).cast("int")).alias("DateReported"),
        (18 + cust % 48).cast("int").alias("Age"),
        _by_remainder("o_custkey", 7, {0: "U", 1: "F", 2: "F", 3: "F"}, "M").alias("Gender"),
        _by_remainder("o_custkey", 11, {0: None, 1: "U", 2: "S", 3: "S"}, "M").alias("MaritalStatus"),
        (cust % 4).cast("int").alias("DependentChildren"),
        (cust % 3).cast("int").alias("DependentsOther"),
        (200 + cust % 1800).cast("double").alias("WeeklyWages"),
        _by_remainder("o_custkey", 5, {0: "P"}, "F").alias("PartTimeFullTime"),
        (order % 121).cast("double").alias("HoursWorkedPerWeek"),
        (cust % 8).cast("int").alias("DaysWorkedPerWeek"),
        F.element_at(
            F.array(*map(F.lit, DESCRIPTIONS)), (order % len(DESCRIPTIONS)).cast("int") + 1
        ).alias("ClaimDescription"),
        F.when(order % 37 == 0, F.lit(1.0)).otherwise(price / 50).alias("InitialIncurredCalimsCost"),
        F.when(order % 97 == 0, price * 20).otherwise(price / 10).alias("UltimateIncurredClaimCost"),
        F.when(order % 5 == 0, "test").otherwise("train").alias("split"),
    )


def train_claims(spark: SparkSession, folder: str) -> DataFrame:
    return claims(spark, folder).filter("split = 'train'").drop("split")


def test_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The test set has no target column."""
    return claims(spark, folder).filter("split = 'test'").drop("split", "UltimateIncurredClaimCost")


def emissions_from(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Emission records from (static or arriving) line items and their dimensions."""
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(
            "l_orderkey",
            "l_linenumber",
            F.col("n_name").alias("country_id"),
            F.col("p_brand").alias("nace_desc"),
            F.col("p_type").alias("activity_desc"),
            F.col("s_name").alias("city"),
            F.year("l_shipdate").alias("year_comp"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * F.length("p_type")).alias("verified"),
        )
    )


def emissions(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Emission records, one per line item; ``year`` keeps one compliance year.

    The year is applied as a range of the ship date, which the parquet reader
    can use to skip row groups; ``year(l_shipdate) = …`` could not be pushed.
    """
    lines = table(spark, folder, "lineitem")
    if year is not None:
        lines = lines.filter(
            (F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
            & (F.col("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))
        )
    return emissions_from(
        lines, *(table(spark, folder, t) for t in ("part", "supplier", "nation"))
    )
