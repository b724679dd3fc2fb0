"""A stored cell index for cosine search: coarse cells as file partitions, probed per query.

Centroids are fitted by spherical k-means to a bounded sample (the SAMPLE_VALUES / dimension rows
of smallest id hash); then every row is assigned to its nearest centroid and written under its
cell, with all its columns. Per cell the smallest cosine to its centroid is kept: by the triangle inequality on
the sphere, no row of the cell is nearer to a query than the angle to the centroid less the cell's.

A search probes the cells nearest to each query. How many it takes for a wanted recall is measured
when the index is built, on sample rows against the whole sample, as that depends on the data: rows in
clusters need few, rows without structure more than half of all cells. With exact=True a second
pass reads the cells that could still hold a better row than the k-th found, so that the result is that
of comparing all.

Scale: rows are shuffled once, by cell, balanced by size, so that a cell that holds a third of all rows
is many files and tasks. A search reads only probed cells; queries beyond BROADCAST_VALUES values are
taken in groups of that size. Centroids are at most CELLS_MOST rows.

Defined results: vectors of length zero (score 0 with any query) lie in cell 0 and widen it to
everything; null vectors are not indexed; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import file_system, written
from .dense import BROADCAST_VALUES, best_rows, check_dimension, in_groups
from .lexical import ranked

SAMPLE_VALUES = 2_000_000
CELLS_MOST = 4096
#: Sample rows that ask when probes are measured.
ASKED = 200
SLACK = 1e-6


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 20_250_816) -> np.ndarray:
    """Unit centroids (cells, dimension) of a sample."""
    x = _units(sample)
    chosen = np.random.default_rng(seed).choice(len(x), cells, replace=False)
    centroids = x[np.sort(chosen)]
    for _ in range(rounds):
        own = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _units(sums), centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((x[at : at + 4096] @ centroids.T).argmax(1) for at in range(0, len(x), 4096))])


def probes_by_recall(sample: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """Recall of the k nearest among the sample by number of probed cells (from 1)."""
    x = _units(sample)
    own, asked = _nearest(x, centroids), x[: min(ASKED, len(x))]
    k = min(k, len(x))
    near = np.argpartition(-(asked @ x.T), k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), 1)
    met = np.take_along_axis(place, own[near], 1)
    return np.cumsum(np.bincount(met.ravel(), minlength=len(centroids))) / met.size


@dataclass
class Found:
    """hits: query_id, chunk_id, ordinal, score, rank. report: query_id, cells and rows read for it."""

    hits: DataFrame
    report: DataFrame


class CellIndex:
    """Vectors by cell under a folder; `cells` holds a row per cell, written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, k: int = 10) -> CellIndex:
        """vectors: chunk_id, ordinal, embedding and any columns that searches filter by."""
        index = cls(vectors.sparkSession, path)
        rows = vectors.filter(F.col("embedding").isNotNull())
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != high:
            raise ValueError("vectors differ in size")
        taken = max(1, SAMPLE_VALUES // max(low or 1, 1))
        sample = np.array([r.embedding for r in rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(taken).select("embedding").collect()], float).reshape(-1, low or 1)
        count = min(cells or round(n**0.5), CELLS_MOST, len(sample)) if n else 0
        centroids = fit(sample, count) if count else np.zeros((0, low or 1))
        recalls = probes_by_recall(sample, centroids, k) if count else np.zeros(0)
        told = index._assigned(rows, centroids) if count else rows.withColumn("cell", F.lit(0)).withColumn("nearness", F.lit(0.0))
        told.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "ordinal").write.partitionBy("cell").parquet(f"{index.path}/rows")
        schema = "cell int, centroid array<double>, recall double"
        named = index.spark.createDataFrame([(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(centroids, recalls, strict=True))], schema)
        if count:
            held = index.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("nearness").alias("least"))
            named = named.join(F.broadcast(held), "cell", "left")  # a row per cell on either side
        else:
            named = named.withColumn("n", F.lit(0).cast("long")).withColumn("least", F.lit(1.0))
        named.select("cell", "centroid", "recall", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", F.lit(1.0)).alias("least")).coalesce(1).write.parquet(f"{index.path}/cells")
        return index

    def _assigned(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        at = rows.columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                x = _units(values)
                near = x @ centroids.T
                own = near.argmax(1)
                least = np.where((values != 0).any(1), near[np.arange(len(own)), own], -1.0)
                own = np.where(least == -1.0, 0, own).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(least)], [*batch.schema.names, "cell", "nearness"])

        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("nearness", T.DoubleType())])
        return rows.mapInArrow(run, schema)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def cells(self) -> list:
        """cell, centroid, recall (with as many probes as the cell's number + 1), n, least."""
        return sorted(self.spark.read.parquet(f"{self.path}/cells").collect(), key=lambda r: r.cell)

    def drop(self) -> None:
        fs, at = file_system(self.spark, self.path)
        fs.delete(at(self.path), True)

    def probes_for(self, recall: float) -> int:
        """The fewest probes whose measured recall is that much; all cells if none has it."""
        held = self.cells()
        return next((r.cell + 1 for r in held if r.recall >= recall), len(held))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, recall: float = 0.95, exact: bool = False, digits: int | None = None, where: Column | None = None) -> Found:
        """queries: query_id, embedding. where filters rows on their columns and reaches the scan."""
        cells = self.cells()
        size = queries.agg(F.max(F.size("embedding"))).first()[0]
        if not cells or not size:
            none = queries.select("query_id").limit(0).select("query_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("ordinal"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
            return Found(none, queries.select("query_id", F.lit(0).alias("cells"), F.lit(0).cast("long").alias("rows")).limit(0))
        count = min(probes or self.probes_for(recall), len(cells))
        pairs = written(self._pairs(check_dimension(queries.select("query_id", "embedding"), size), cells), "cell-pairs")
        first = pairs.filter(F.col("place") <= count)
        hits = written(self._hits(queries, first, k, digits, where), "cell-hits")
        used = first
        if exact:
            threshold = hits.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("threshold"))
            more = pairs.filter(F.col("place") > count).join(threshold, "query_id", "left")
            more = written(more.filter(F.col("threshold").isNull() | (F.col("most") >= F.col("threshold") - SLACK)).select(*pairs.columns), "cell-more")
            hits = ranked(hits.drop("rank").unionByName(self._hits(queries, more, k, digits, where).drop("rank")), k, F.col("score").desc(), F.col("ordinal"))
            used = first.unionByName(more)
        return Found(hits, used.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")))

    def _pairs(self, queries: DataFrame, cells: list) -> DataFrame:
        """query_id, cell, n, place (of the cell by nearness, from 1), most: a bound of its rows' scores."""
        centroids, least, n = np.array([c.centroid for c in cells]), np.array([c.least for c in cells]), np.array([c.n for c in cells])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _units(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
                near = x @ centroids.T
                angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(least, -1, 1))[None, :]
                most = np.where(least[None, :] <= -1, 1.0, np.cos(np.maximum(angle, 0)))
                place = np.argsort(np.argsort(-near, 1, kind="stable"), 1) + 1
                row, cell = np.nonzero(np.broadcast_to(n > 0, near.shape))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(n[cell]), pa.array(place[row, cell]), pa.array(most[row, cell])], ["query_id", "cell", "n", "place", "most"])

        kind = queries.schema["query_id"].dataType
        schema = T.StructType([T.StructField("query_id", kind), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("place", T.LongType()), T.StructField("most", T.DoubleType())])
        return queries.mapInArrow(run, schema)

    def _hits(self, queries: DataFrame, pairs: DataFrame, k: int, digits: int | None, where: Column | None) -> DataFrame:
        """The k best rows per query among the cells it is paired with."""
        rows = self.rows()
        rows = rows.filter(where) if where is not None else rows
        kind = to_arrow_type(queries.schema["query_id"].dataType)
        schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType())])
        asked = queries.select("query_id", "embedding").join(pairs.groupBy("query_id").agg(F.collect_set("cell").alias("cells")), "query_id")

        def search(held: list) -> DataFrame:
            ids, matrix = [r.query_id for r in held], np.array([r.embedding for r in held], float)
            of = {c: np.flatnonzero([c in r.cells for r in held]) for c in {c for r in held for c in r.cells}}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = best_rows(ids, kind, matrix, k, digits)
                for batch in batches:
                    cell = batch.column(3).to_numpy(zero_copy_only=False)
                    for c in np.unique(cell):
                        best.add(batch.filter(pa.array(cell == c)), of[int(c)])
                yield from best.out()

            some = rows.filter(F.col("cell").isin(sorted(of))).select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "embedding", "cell")
            return some.mapInArrow(run, schema)

        return ranked(in_groups(asked, search, schema, BROADCAST_VALUES), k, F.col("score").desc(), F.col("ordinal"))

