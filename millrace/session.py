"""Session defaults, and the one place that decides where interim tables go."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles a method above 8000 bytes; wide projections run faster split up
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with our defaults. Cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship(spark)
    return spark


def package_zip() -> bytes:
    """This package as a zip file that Python imports from."""
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    return out.getvalue()


def ship(spark: SparkSession) -> str:
    """Send the package to the executors, by way of the shared folder; for sessions not made by ``build``, where it is not installed."""
    data = package_zip()
    path = f"{shared_dir(spark)}/millrace/package-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(data))
        out.close()
        fs.rename(part, where)
    spark.sparkContext.addPyFile(path)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session (tests) may fall back to a folder of its own; on a
    cluster an unset ``spark.checkpoint.dir`` is an error, because a
    machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def durable_path(spark: SparkSession, label: str) -> str:
    """A path in the warehouse that no other table uses; for tables that outlive the run."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several passes. The written table survives
    the loss of executors, later passes read only the columns they need, and
    its known size lets Catalyst choose between broadcast and shuffle joins.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
