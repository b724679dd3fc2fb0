"""Session defaults used by tests, the benchmark and scripts.

A cluster brings its own master, memory and shuffle settings; only settings that
results depend on (time zone, ANSI off is not assumed) or that every plan here
profits from (adaptive execution, Arrow) are fixed.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "veriloom", **conf: str) -> SparkSession:
    """A session on this machine with the library's defaults."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir; only where that is unset on a local
    master (tests, local runs) is a temporary folder made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-veriloom-"))
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and its class of paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def signature(spark: SparkSession, path: str) -> str:
    """What tells a table's state: its files' names, lengths and times."""
    fs, at = file_system(spark, path)
    told = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at(path)))
    return hashlib.sha256(repr((path, told)).encode()).hexdigest()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/veriloom-{name}-{uuid.uuid4().hex}"


_collecting: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("collecting", default=None)


@contextmanager
def collecting(owned: list[tuple[SparkSession, str]]):
    """Tables written meanwhile are noted in owned, for whoever clears them."""
    token = _collecting.set(owned)
    try:
        yield
    finally:
        _collecting.reset(token)


def cleared(owned: list[tuple[SparkSession, str]]) -> None:
    """Delete the tables noted in owned: no plan reads them any more."""
    while owned:
        spark, path = owned.pop()
        fs, at = file_system(spark, path)
        fs.delete(at(path), True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows in what runs meanwhile: rows that are whole texts make large ones."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read from there."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    if (owned := _collecting.get()) is not None:
        owned.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys that go to every task; more meet in a shuffle.
SENT_ROWS = 500_000


def sent(keys: DataFrame) -> DataFrame:
    """keys, at every task if they are at most SENT_ROWS (they are counted), whatever the join threshold."""
    return F.broadcast(keys) if keys.limit(SENT_ROWS + 1).count() <= SENT_ROWS else keys


def among(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in few: picked where they are read, so that the others (whole texts) are not moved."""
    return rows.join(sent(written(few.select(key).distinct(), "keys")), key, "left_semi")
