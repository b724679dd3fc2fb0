"""Readers and writers: JSON lines, chunk files, vector tables, reports, synthetic vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import RetrievalFilters
from .snapshots import KeyedTable

CHUNK = "chunk_id STRING, document_id STRING, manual_id STRING, manual_key STRING, manual_name STRING, manual_version STRING, snapshot_id STRING, vehicle_model STRING, topic_id STRING, title STRING, text STRING, section_path ARRAY<STRING>, source_url STRING, content_hash STRING, metadata MAP<STRING, STRING>"


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; the committer makes the result appear as a whole."""
    df.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, glob: str) -> DataFrame:
    """Chunk files by glob, the first row of each chunk_id in file order."""
    rows = spark.read.schema(CHUNK).json(glob).withColumn("_f", F.col("_metadata.file_path")).withColumn("_o", F.monotonically_increasing_id())
    held = F.struct(*(c.split(" ")[0] for c in CHUNK.split(", ") if c.split(" ")[0].islower()))
    return rows.groupBy("chunk_id").agg(F.min_by(held, F.struct("_f", "_o")).alias("r")).select("r.*")


class VectorTable:
    """A vector collection on a folder: one embedder's vectors by chunk_id, with snapshots.

    Upserts and deletions write what they change and are merged when read (KeyedTable).
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.rows, self.dimension = KeyedTable(spark, path, "chunk_id"), dimension

    def generation(self) -> int:
        """The newest snapshot's version, 0 before the first."""
        held = self.rows.manifest()
        return held.version if held else 0

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows.read(version)

    def _checked(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.assert_true(F.size("embedding") == self.dimension, F.lit("vector size does not match the collection")).isNull())

    def replace(self, rows: DataFrame) -> None:
        self.rows.replace(self._checked(rows))

    def upsert(self, rows: DataFrame) -> None:
        self.rows.upsert(self._checked(rows))

    def delete(self, ids: DataFrame) -> None:
        self.rows.delete(ids)

    def apply(self, rows: DataFrame, ids: DataFrame) -> None:
        """Upserts and deletions as one snapshot."""
        self.rows.apply(self._checked(rows), ids)

    def retrieve(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("chunk_id"), "chunk_id", "left_semi")

    def scroll(self, filters: RetrievalFilters = RetrievalFilters()) -> DataFrame:
        """All rows that a filter lets through, without vectors: they are not read."""
        rows = self.read()
        return rows.filter(filters.predicate()).select([c for c in rows.columns if c != "embedding"])

    def search(self, queries: DataFrame, k: int = 10, filters: RetrievalFilters = RetrievalFilters()) -> DataFrame:
        """The k nearest rows per query (query_id, embedding); the filter reaches the scan."""
        from ..operators.dense import dense

        return dense(self.read().filter(filters.predicate()), queries, k)

    def count(self) -> int:
        return self.read().count() if self.generation() else 0

    def health(self) -> bool:
        try:
            self.generation()
            return True
        except Exception:  # an unreachable store is what is asked for
            return False


def synthetic_vectors(spark: SparkSession, n: int, dimension: int = 64, seed: int = 20_250_816, name: str = "synthetic_vectors") -> DataFrame:
    """n chunks with vectors in (-1, 1) from a hash: equal however the range is partitioned."""
    if not name.startswith("synthetic_"):
        raise ValueError("synthetic collections are named synthetic_*")
    unit = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), i), 11).cast("double") / float(1 << 53)
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (unit(i) * 2 - 1).cast("float"))
    from ..functions.ids import uuid5

    return spark.range(n).select(uuid5(F.concat(F.lit(f"{name}:"), F.col("id").cast("string"))).alias("chunk_id"), F.col("id").alias("ordinal"), F.concat(F.lit("topic-"), (F.col("id") % 1000).cast("string")).alias("topic_id"), vector.alias("embedding"))


def markdown(rows: DataFrame, title: str) -> str:
    """A small report as a markdown table (for summaries, not data)."""
    held = rows.collect()
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in held)])
