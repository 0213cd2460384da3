"""A record of finished fits, so that an interrupted training job goes on where it stopped.

Each entry is a small JSON file below the job's folder, written under another name and renamed, so
that an entry is there whole or not at all. Threads and later calls never touch one file twice.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp(df: DataFrame) -> str:
    """A digest of a table's columns and rows that does not depend on their order."""
    marks = df.select(F.xxhash64(*df.columns).alias("mark"))
    row = marks.agg(F.count("*"), F.sum(F.col("mark").cast("decimal(38,0)")), F.bit_xor("mark")).first()
    return hashlib.sha256(repr((df.dtypes, tuple(row))).encode()).hexdigest()[:16]


class Ledger:
    """Values by key, kept in files of a folder; ``known`` holds what earlier calls have written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)
        self.known: dict[str, object] = {}
        rows = spark.read.schema("key string, value string").json(posixpath.join(folder, "*.json")) if self._any(path) else None
        for row in rows.collect() if rows is not None else []:
            self.known[row["key"]] = json.loads(row["value"])

    def _any(self, path) -> bool:
        listed = self.files.listStatus(path)
        return any(s.getPath().getName().endswith(".json") for s in listed)

    @staticmethod
    def key(*parts: object) -> str:
        return json.dumps(parts, sort_keys=True, default=str)

    def add(self, key: str, value: object) -> None:
        name = hashlib.sha256(key.encode()).hexdigest()[:32]
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        draft = place(posixpath.join(self.folder, f"_{name}.{uuid.uuid4().hex}"))
        final = place(posixpath.join(self.folder, f"{name}.json"))
        out = self.files.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"key": key, "value": json.dumps(value)}).encode()))
        finally:
            out.close()
        self.files.rename(draft, final)
        self.known[key] = value
