"""What several of the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space of the word and line rules: ASCII only.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

MASK = (1 << 64) - 1


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it from there.

    It cuts lineage, survives lost executors, and unlike checkpoint() computes its input only
    once and stores it as compressed columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veriloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A hot group holds more than 1/HOT_SHARE of all rows: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: And this many rows, below which its partition takes it like any other.
HOT_LEAST = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with their group (one row per key, with its number of rows in column size).

    Hot groups, fewer than HOT_SHARE rows, are broadcast; the others meet in an equi-join.
    """
    hot = (F.col(size) * HOT_SHARE > total) & (F.col(size) > HOT_LEAST)
    few = F.broadcast(groups.filter(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(groups.filter(~hot), key))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: dict[str, object] = {}


def let_go() -> None:
    """Drop what earlier tasks left in this worker and return free memory to the machine.

    Spark reuses workers: without it, the memories of all operators that one has served add up.
    """
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def hold[V](name: str, make: Callable[[], V]) -> V:
    """What a worker keeps from task to task: one thing at a time."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() for small iterative state that follows a shuffle."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def ascii_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(ASCII_SPACE))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on uint64 (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """How many shards hold per_part rows each: grows with the input."""
    return max(least, -(-rows // per_part))
