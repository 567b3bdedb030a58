"""A log that several writers can append to: numbered entries, each made by whoever is first.

An entry is a small JSON file named by its number and created only if no file
has that name, which the file system decides (an exclusive create on HDFS and
local disks; stores need conditional writes). A writer that comes second reads
what came first and decides anew, so what an entry says can rest on all entries
before it: version numbers have no gaps and no twins. Entries never change;
a reader keeps those it has seen and lists only what is new. An entry whose
writer died half-way says nothing and is passed over.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

PATIENCE = 5.0  # seconds that a half-written entry is waited for


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own kind of object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if there is one of that name already."""
    fs, where = file_system(spark, path)
    data = bytearray(text.encode())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local files are looked for, then made: two steps
            jvm, gateway = spark._jvm, spark.sparkContext._gateway
            options = gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(jvm.java.io.File(where.toUri().getPath()).toPath(), data, options)
        else:
            out = fs.create(where, False)
            out.write(data)
            out.close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._seen: dict[int, dict | None] = {}

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def _numbers(self) -> list[int]:
        fs, where = file_system(self.spark, self.folder)
        if not fs.exists(where):
            fs.mkdirs(where)
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> dict | None:
        fs, where = file_system(self.spark, self._path(number))
        until = time.monotonic() + PATIENCE
        while True:
            stream = fs.open(where)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            if time.monotonic() > until:
                return None
            time.sleep(0.05)

    def _now(self) -> tuple[int, list[dict]]:
        """The last number, and all entries up to it in order."""
        numbers = self._numbers()
        for n in numbers:
            if n not in self._seen:
                self._seen[n] = self._read(n)
        return numbers[-1] if numbers else 0, [self._seen[n] for n in numbers if self._seen[n] is not None]

    def entries(self) -> list[dict]:
        """All entries in order."""
        return self._now()[1]

    def append(self, make: Callable[[list[dict]], dict | None]) -> dict | None:
        """Add what ``make`` says, given all entries before it; asked again whenever someone else was first. None adds nothing."""
        while True:
            last, entries = self._now()
            entry = make(entries)
            if entry is None:
                return None
            if put_if_absent(self.spark, self._path(last + 1), json.dumps(entry) + "\n"):
                return entry
