"""Score arriving rows with a fitted model.

Stateless: a stream-static join per batch, so there is no watermark and no
state to grow. The checkpoint and the sink lie in the shared folder; a batch
that is run again after a failure is not written twice.

``score_published`` follows a registry: each batch is scored by the version
that is published when it begins, so a new version takes effect without a
restart and leaves earlier batches as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.glm import INTERCEPT, score
from millrace.operators.registry import Registry
from millrace.sources.batches import BatchTable


def parquet_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int = 1_000) -> DataFrame:
    """Files of one table as they arrive (a folder of parts, or a single file)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def score_stream(
    arriving: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    coefficients: DataFrame,
    effects: Sequence[str],
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
):
    """Start a query that appends scored rows to ``sink`` (parquet)."""
    scored = score(prepare(arriving), coefficients, effects)
    return (
        scored.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def score_published(
    arriving: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    registry: Registry,
    project: str,
    name: str,
    sink: BatchTable,
    checkpoint: str,
    trigger: dict | None = None,
):
    """Start a query that scores each batch by the newest published coefficients.

    The sink takes a batch by its number, so a batch that is run again after a
    failure adds nothing, even if another version was published meanwhile. Rows
    carry ``predicted`` and ``model_version``; columns are those of the sink.
    """

    def run(batch: DataFrame, number: int) -> None:
        if f"{number}" in sink.batches():
            return
        version = registry.published_version(project, name)
        coefficients = registry.published_table(project, name, version)
        effects = [r.effect for r in coefficients.filter(F.col("effect") != INTERCEPT).select("effect").distinct().orderBy("effect").collect()]
        scored = score(prepare(batch), coefficients, effects).withColumn("model_version", F.lit(version))
        sink.append(scored.select(*sink.schema.names), f"{number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
