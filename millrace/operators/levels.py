"""Levels of classes as numbers, however many there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

PLACE_BITS = 33  # of a row's number within its partition, as Spark gives it


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place, from 0, in the order of the given columns.

    Rows are range-partitioned and sorted; a row's place is that within its
    partition plus the rows of all partitions before it. The driver gets one
    count for each partition, and no task holds more than its range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = settle(rows.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", PLACE_BITS)
    counts = dict(rows.groupBy(part.alias("part")).agg(F.count("*")).collect())
    before, bases = 0, []
    for p in sorted(counts):
        bases.append((p, before))
        before += counts[p]
    starts = spark.createDataFrame(bases, "__part long, __before long")  # a row for each partition
    place = F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1) + F.col("__before")
    return rows.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, place).drop("__place", "__part", "__before")


def unpivot(df: DataFrame, effects: Sequence[str], *carry: str) -> DataFrame:
    """A row for each effect's level of each row: effect, level, and the carried columns."""
    pairs = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("level")) for e in effects])
    return df.select(F.explode(pairs).alias("__p"), *carry).select("__p.effect", "__p.level", *carry)
