"""Exact cosine top-k for a batch of query vectors.

A stated set of queries is compared against all vectors. Queries go to the tasks (their number is
checked: at most BROADCAST_VALUES values at once, more in groups of that size), and each task keeps its
own k best per query over all its batches, so that only k rows per query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written
from .lexical import ranked

#: 32 MB of doubles.
BROADCAST_VALUES = 4_000_000


def check_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """vectors, raising where one has another size."""
    return vectors.filter(F.assert_true(F.size(column) == dimension, F.lit(f"vector size is not {dimension}")).isNull())


class best_rows:
    """The k best rows per query, kept over a task's batches of (chunk_id, ordinal, embedding)."""

    def __init__(self, ids: list, id_type: pa.DataType, matrix: np.ndarray, k: int | None, digits: int | None):
        self.ids, self.id_type, self.matrix, self.k, self.digits = ids, id_type, matrix, k, digits
        self.lengths = np.linalg.norm(matrix, axis=1)
        self.held: list[list[pa.RecordBatch]] = [[] for _ in ids]
        self.waiting = np.zeros(len(ids), np.int64)

    def add(self, batch: pa.RecordBatch, which: np.ndarray | None = None) -> None:
        """Compare a batch with all queries, or with those at the places which."""
        if not batch.num_rows:
            return
        which = np.arange(len(self.ids)) if which is None else which
        values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        scale = np.linalg.norm(values, axis=1)[:, None] * self.lengths[None, which]
        scores = np.divide(values @ self.matrix[which].T, scale, out=np.zeros_like(scale), where=scale != 0)
        if self.digits is not None:
            scores = np.round(scores, self.digits)
        ordinal = batch.column(1).to_numpy()
        for i, q in enumerate(which):
            s = scores[:, i]
            pick = np.arange(len(s))
            if self.k and len(s) > self.k:  # ties with the k-th stay for the order by ordinal
                pick = np.flatnonzero(s >= np.partition(s, -self.k)[-self.k])
            pick = pick[np.lexsort((ordinal[pick], -s[pick]))[: self.k or len(s)]]
            self.held[q].append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick)), pa.array(ordinal[pick]), pa.array(s[pick])], ["chunk_id", "ordinal", "score"]))
            self.waiting[q] += 1
            if self.k and self.waiting[q] > 8:
                self.held[q], self.waiting[q] = [self._first(q)], 1

    def _first(self, q: int) -> pa.RecordBatch:
        told = pa.Table.from_batches(self.held[q]).combine_chunks().to_batches()[0]
        pick = np.lexsort((told.column(1).to_numpy(), -told.column(2).to_numpy()))
        return told.take(pa.array(pick[: self.k or len(pick)]))

    def out(self) -> Iterator[pa.RecordBatch]:
        for q, parts in enumerate(self.held):
            if parts:
                told = self._first(q)
                yield pa.RecordBatch.from_arrays([pa.array([self.ids[q]] * told.num_rows, self.id_type), *told.columns], ["query_id", "chunk_id", "ordinal", "score"])


def in_groups(queries: DataFrame, search: Callable[[list], DataFrame], schema: T.StructType, values: int) -> DataFrame:
    """search() over rows of queries (query_id, embedding, ...), in groups of at most so many values, by
    hash of the id. Beyond one group each group's result is written before the next is asked."""
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    groups = max(1, -(-n * (size or 1) // values))
    if groups == 1:
        held = queries.collect() if n else []
        return search(held) if held else queries.sparkSession.createDataFrame([], schema)
    # hashes fill groups unevenly: twice as many keep all but astronomically rare ones within the bound
    told = written(queries.withColumn("_g", F.pmod(F.xxhash64("query_id"), F.lit(2 * groups))), "query-groups")
    out = None
    for g in range(2 * groups):
        held = told.filter(F.col("_g") == g).collect()
        if held:
            part = written(search(held), "group-hits")
            out = part if out is None else out.unionByName(part)
    return out


def dense(vectors: DataFrame, queries: DataFrame, k: int | None = 10, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, ordinal, score, rank): of equal scores the lower ordinal first.

    vectors: chunk_id, ordinal, embedding. queries: query_id, embedding. A query vector of another
    size raises. Negative scores are returned too.
    """
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType())])
    n, size, largest = queries.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n and size != largest:
        raise ValueError("query vectors differ in size")
    rows = vectors.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "embedding")
    if n:
        rows = check_dimension(rows, size)
    kind = to_arrow_type(schema["query_id"].dataType)

    def search(held: list) -> DataFrame:
        ids, matrix = [r["query_id"] for r in held], np.array([r["embedding"] for r in held], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = best_rows(ids, kind, matrix, k, digits)
            for batch in batches:
                best.add(batch)
            yield from best.out()

        return rows.mapInArrow(run, schema)

    hits = in_groups(queries.select("query_id", "embedding"), search, schema, BROADCAST_VALUES)
    return ranked(hits, k, F.col("score").desc(), F.col("ordinal"))
