"""A table that grows by batches, each of which is there wholly and once, or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.operators.commit_log import CommitLog, file_system


class BatchTable:
    """Rows in a folder of their own for each batch; a batch counts from the moment its name is in the log.

    A task that fails is run again by Spark and leaves no rows twice; a job
    that fails leaves a folder that no entry names, which is taken away. A
    batch that is sent again, by the same writer or another at the same time,
    adds nothing. Readers see the batches that the log had when they asked.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.log = CommitLog(spark, f"{self.root}/log")

    def batches(self) -> list[str]:
        return [e["batch"] for e in self.log.entries()]

    def append(self, df: DataFrame, batch: str) -> bool:
        """Add the rows of a batch; False if it was there already."""
        if batch in self.batches():
            return False
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        entry = None
        try:
            df.write.parquet(path)
            entry = self.log.append(lambda entries: None if batch in [e["batch"] for e in entries] else {"batch": batch, "path": path})
        finally:
            if entry is None:  # failed, or another writer was first
                fs, where = file_system(self.spark, path)
                fs.delete(where, True)
        return entry is not None

    def read(self) -> DataFrame:
        paths = [e["path"] for e in self.log.entries()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
