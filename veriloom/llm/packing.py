"""Best-fit packing of token pieces into sequences of at most `capacity` tokens.

Documents become token ids plus one end id; only longer ones are cut. Pieces are range-sorted by
length, longest first, and ranked within their length. Gaps are kept sorted too, as runs: a run is
a number of consecutive sequences with equal free space. Matching is bulk-synchronous: in each
superstep all pieces of one length ask for the successor gap (the smallest that holds them); where
several want the same run, rank decides (the k-th piece takes the k-th sequence of the run); the
run's gap shrinks by the length, the rest of it stays, and pieces left over ask for the next
larger gap, or open sequences. That is best-fit decreasing, for all pieces of a length at once.

There are at most `capacity` lengths and gaps however many documents there are, so the sweep's
state is a small table and so is its outcome (rank ranges to runs). What grows with the corpus is
distributed: tokenising, the range sort, the ranks, and applying the matches to single pieces.

Scale: one range shuffle of piece rows without texts or ids. A length that a third of all pieces
share is spread over many range partitions, as the sort key ends with the document's key. What is
broadcast is one row per range partition and length met there, and the matches.

Defined results: null text counts as empty; an empty text is the end id alone; equal rows are
packed as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, whole
from .tokens import encoder, vocabulary

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and the ids if wanted."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(body.as_py()) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=False)]
            names = PIECES.fieldNames()
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else PIECES
    return docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).cast("binary").alias("body")).mapInArrow(run, schema)


def match(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Supersteps over lengths. counts: pieces by length.

    Rows of the outcome: length, rank from (inclusive), first sequence, pieces of this length per
    sequence, offset of the first of them; the range ends where the next row of the length begins.
    """
    runs: dict[int, deque[tuple[int, int]]] = {}  # free space -> (first sequence, sequences)
    gaps: list[int] = []  # its keys, sorted
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                runs[gap] = deque()
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            first, n = runs[gap].popleft()
            take = min(n, left)
            if take < n:
                runs[gap].appendleft((first + take, n - take))
            elif not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            rows.append((length, rank, first, 1, capacity - gap))
            put(gap - length, first, take)
            rank, left = rank + take, left - take
        each = capacity // length
        full, rest = divmod(left, each)
        if full:
            rows.append((length, rank, opened, each, 0))
            put(capacity - each * length, opened, full)
            rank, opened = rank + full * each, opened + full
        if rest:
            rows.append((length, rank, opened, rest, 0))
            put(capacity - rest * length, opened, 1)
            opened += 1
    return np.array(rows, np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Pieces range-sorted by length, with their range partition and rank within (partition, length)."""
    schema = T.StructType([*PIECES.fields, T.StructField("range_part", T.IntegerType()), T.StructField("near_rank", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            if not len(lengths):
                continue
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            rank = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.r_[starts, len(lengths)]))
            if lengths[0] == last:
                rank[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = lengths[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank.astype(np.int64))], schema.fieldNames())

    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    return pieces.select(PIECES.fieldNames()).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. pieces: columns of PIECES, lengths of 1 to capacity."""
    ranked = materialise(_ranked(pieces), "ranked-pieces")
    met = ranked.groupBy("range_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition and length in it: at most partitions + capacity rows
    offsets = met.select("range_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    counts = {r["length"]: r["n"] for r in met.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = match(counts, capacity)
    # length and rank as one sorted key
    width = int(max(counts.values(), default=0)) + 1
    keys = plan[:, 0] * width + plan[:, 1] if len(plan) else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, plan = keys[order], plan[order]
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = plan[np.searchsorted(keys, length * width + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], schema.fieldNames())

    return (
        ranked.join(F.broadcast(offsets), ["range_part", "length"])
        .select(*PIECES.fieldNames(), (F.col("ahead") + F.col("near_rank")).alias("rank"))
        .mapInArrow(place, schema)
    )


def sequences(pieces_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and where each document's piece lies."""
    parts = packed.join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return (
        parts.groupBy("sequence_id")
        .agg(held.alias("held"))
        .select("sequence_id", F.flatten(F.col("held.ids")).alias("ids"), F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("spans"))
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents."""
    return pack(materialise(pieces_of(docs, path or vocabulary(VOCABULARY), capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
