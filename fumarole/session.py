"""Session set-up, stage tables and size-checked small tables."""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a table may have and still be held on the driver and broadcast.
SMALL_ROWS = 100_000
SMALL_BYTES = 32 << 20

#: Scopes that own the stage tables written while they are open, innermost last.
_scopes: list[list[str]] = []


def build_session(app: str = "fumarole", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Master, memory and partition counts stay with ``spark-submit``. Only ``cpus`` asks for a
    local master with as many threads, for tests and benchmarks.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", "8")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's stage tables, which all executors can reach.

    It lies in ``spark.checkpoint.dir``, or in the warehouse where that is unset; both are
    shared on a cluster. The driver removes it when its JVM ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    base = named or spark.conf.get("spark.sql.warehouse.dir")
    folder = posixpath.join(base, f"stages-{context.applicationId}")
    _file_system(spark, folder, lambda fs, path: fs.deleteOnExit(path))
    return folder


def _file_system(spark: SparkSession, folder: str, use) -> object:
    """Calls ``use`` with the Hadoop file system and path of a folder (classic sessions)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return use(path.getFileSystem(spark._jsc.hadoopConfiguration()), path)


def stage_path(spark: SparkSession, name: str) -> str:
    path = posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def owned_stages(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside are removed at the end; for jobs whose results do not read
    them any more."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _file_system(spark, path, lambda fs, place: fs.delete(place, True))


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet stage table in the shared folder and scan it back.

    Several passes over one stage then read only the columns they need, and a lost executor
    costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Evaluate an aggregated table once and hint a broadcast if it proves small.

    At most ``max_rows + 1`` rows reach the driver. A larger table is written as a stage
    table from the shuffled rows at hand, and joined without a hint.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        rows = held.limit(max_rows + 1).toArrow()
        if rows.num_rows > max_rows or rows.nbytes > max_bytes:
            return materialise(held, "lookup")
    finally:
        held.unpersist()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
