"""Reading, registering and describing named tables (scans and catalog)."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.commit_log import CommitLog
from millrace.session import durable_path

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with a header and a declared schema; nothing is inferred.

    ``multi_line`` is for quoted texts with line breaks; such files cannot be split.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet tables (files or folders) below ``folder``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def name_problem(name: str, max_len: int | None) -> str | None:
    """Why a table name cannot be mapped; None when it can."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        return "not a valid name"
    if max_len is not None and len(name) > max_len:
        return f"longer than {max_len} characters"
    return None


def register_tables(spark: SparkSession, folder: str, max_len: int | None = None) -> DataFrame:
    """Map every table of a library folder to an upper-case view.

    Names that are not valid are reported, not mapped. One row per table:
    name, mapped, reason, n_rows (null when not mapped).
    """
    report = None
    for name in list_tables(spark, folder):
        problem = name_problem(name, max_len)
        if problem is None:
            rows = table(spark, folder, name)
            rows.createOrReplaceTempView(name.upper())
            counted = rows.agg(F.count("*").alias("n_rows"))
        else:
            counted = spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        line = counted.select(
            F.lit(name.upper()).alias("name"),
            F.lit(problem is None).alias("mapped"),
            F.lit(problem).cast("string").alias("reason"),
            "n_rows",
        )
        report = line if report is None else report.unionAll(line)
    if report is None:
        return spark.createDataFrame([], "name string, mapped boolean, reason string, n_rows long")
    return report


def _raw_length(field: T.StructField) -> Column:
    """Widest value of a column: characters of text, items of an array, else bytes of the type."""
    fixed = {"int": 4, "float": 4, "date": 4, "boolean": 1}
    if isinstance(field.dataType, T.StringType):
        return F.max(F.length(field.name)).cast("long")
    if isinstance(field.dataType, T.ArrayType):
        return F.max(F.size(field.name)).cast("long")
    return F.lit(fixed.get(field.dataType.simpleString(), 8)).cast("long")


def column_info(df: DataFrame, name: str) -> DataFrame:
    """Describe the columns: table, position, column, type, raw_length.

    All widths come from one aggregate over the table, turned into rows.
    """
    lines = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(pos).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            _raw_length(f).alias("raw_length"),
        )
        for pos, f in enumerate(df.schema.fields, 1)
    ]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def table_shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by a stated order (the source order of a table is undefined)."""
    return df.orderBy(*order).limit(n)


def run_sql(
    spark: SparkSession, text: str, args: Mapping | None = None, **tables: DataFrame
) -> DataFrame:
    """SQL text with named parameters (``:p``) and tables (``{t}``)."""
    return spark.sql(text, args=dict(args or {}), **tables)


def create_table_as(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a table from a query, and return the stored table.

    The rows are written in full to a fresh folder of the warehouse before the
    name is turned to them, so the query may read the table that it replaces,
    and a run that fails leaves the old table. With the same columns the name
    never goes away in between.
    """
    spark = df.sparkSession
    path = path or durable_path(spark, name)
    df.write.parquet(path)
    if spark.catalog.tableExists(name) and spark.table(name).dtypes == df.dtypes:
        spark.sql(f"alter table {name} set location '{path}'")
        spark.catalog.refreshTable(name)
        return spark.table(name)
    spark.sql(f"drop table if exists {name}")
    return spark.catalog.createTable(name, path=path, source="parquet", schema=df.schema)


def _promotions(spark: SparkSession) -> CommitLog:
    return CommitLog(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/promoted")


def promote_folder(spark: SparkSession, name: str, path: str, schema: T.StructType) -> DataFrame:
    """Make a stored parquet folder visible under a name to every session and every later application on the warehouse."""
    _promotions(spark).append(lambda _: {"name": name, "path": path, "schema": schema.json()})
    return promoted(spark, name)


def promote(df: DataFrame, name: str) -> DataFrame:
    """Store a table in the warehouse and promote it; of several promotions under a name the last one holds."""
    path = durable_path(df.sparkSession, name)
    df.write.parquet(path)
    return promote_folder(df.sparkSession, name, path, df.schema)


def promoted(spark: SparkSession, name: str) -> DataFrame:
    """The table that was promoted last under a name, by whichever application; it is a global view here from now on."""
    entries = [e for e in _promotions(spark).entries() if e["name"] == name]
    if not entries or entries[-1]["path"] is None:
        raise ValueError(f"nothing was promoted as {name}")
    schema = T.StructType.fromJson(json.loads(entries[-1]["schema"]))
    spark.read.schema(schema).parquet(entries[-1]["path"]).createOrReplaceGlobalTempView(name)
    return spark.table(f"global_temp.{name}")


def drop_promotion(spark: SparkSession, name: str) -> None:
    """Forget what was promoted under a name; stored rows stay."""
    _promotions(spark).append(lambda entries: {"name": name, "path": None} if any(e["name"] == name for e in entries) else None)
    spark.catalog.dropGlobalTempView(name)
