"""Vector code compression: product codes whose entries are found by a VA-file.

Components become integers, vectors are cut into equal parts, and each part position has a codebook.
A part's nearest entry is found in two steps. Entry coordinates are bit-quantised: per part position and
dimension, BITS bits name the cell between the codebook's smallest and largest coordinate. A part
then has a lookup table per dimension, with the squared distance to the near and to the far edge
of every cell; summed over an entry's cells these bound its distance from below and above. Only
entries whose lower bound does not exceed the smallest upper bound are refined, with exact integer
distances; ties go to the lower index. No true nearest entry is lost by that.

A round assigns all parts, sums them by (part, entry, dimension) within each task, and aggregates the
sums; the new codebooks (parts x entries x dimensions numbers, whatever the number of vectors) go
through the driver to the next round.

Scale: rounds read vectors as packed integers and shuffle only sums, one row per task and codebook
number. Errors by label are summed before their shuffle; labels that more than a thousandth of all
rows share come back by broadcast (fewer than a thousand rows).

Defined results: rows without vector, or with a null or non-finite component, are dropped. So are
rows that can't be cut with the others: those of a length that is zero, no multiple of the
number of parts, or not that of the first kept row in the order of vec_id. Components beyond
+-LIMIT (x beyond 32,767) are held at LIMIT, so that every distance is a long. Equal vec_ids are
ordered by their components, null vec_ids come last; with fewer kept rows than ENTRIES a codebook
has as many entries. An error sum that is no long is null. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, with_group

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BITS = 3
LIMIT = (1 << 27) - 1
#: Parts that are looked up at once.
BLOCK = 4096

Codebooks = np.ndarray  # (parts, entries, dimensions) int64


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, components as packed 32-bit integers; without rows that have a component amiss."""
    for batch in batches:
        vectors = batch.column(2)
        lengths = np.diff(np.asarray(vectors.offsets))
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths[~vectors.is_valid().to_numpy(zero_copy_only=False)] = 0
        ends = np.cumsum(lengths)
        amiss = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = (lengths > 0) & (lengths % PARTS == 0) & (amiss[ends] == amiss[ends - lengths])
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.nan_to_num(np.clip(np.floor(values * SCALE), -LIMIT, LIMIT)).astype("<i4")
        raw = [whole[e - n : e].tobytes() for e, n in zip(ends[good], lengths[good], strict=True)]
        kept = batch.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "v"])


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The kept rows: vec_id, label, v (packed components)."""
    given = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return given.mapInArrow(_integers, given.select("vec_id", "label", F.lit(b"").alias("v")).schema)


def _parts(column: pa.Array, dimensions: int) -> np.ndarray:
    """(rows, parts, dimensions) of packed vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, PARTS, dimensions).astype(np.int64)


class VaFile:
    """A codebook's entries (entries, dimensions) behind their cells."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        low, width = entries.min(0), np.ptp(entries, 0) + 1
        cells = 1 << BITS
        edges = low[:, None] + -(-np.arange(cells + 1)[None, :] * width[:, None] // cells)
        #: Smallest and largest integer of each cell, by dimension.
        self.near, self.far = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        #: Places of the entries' cells in a flattened table of (dimension, cell).
        self.cell = (entries - low) * cells // width + np.arange(len(low)) * cells

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each asked part to each entry."""
        below, above = self.near - asked[:, :, None], asked[:, :, None] - self.far
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(-below, -above) ** 2
        both = (t.reshape(len(asked), -1)[:, self.cell].sum(2) for t in (least, most))
        return tuple(both)  # type: ignore[return-value]

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per asked part the nearest entry and its squared distance; and the number of refined pairs."""
        which, error, refined = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), 0
        for at in range(0, len(asked), BLOCK):
            some = asked[at : at + BLOCK]
            lower, upper = self.bounds(some)
            row, entry = np.nonzero(lower <= upper.min(1)[:, None])
            exact = ((some[row] - self.entries[entry]) ** 2).sum(1)
            order = np.lexsort((entry, exact, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            which[at : at + BLOCK], error[at : at + BLOCK] = entry[first], exact[first]
            refined += len(row)
        return which, error, refined


def _sums(codebooks: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(c) for c in codebooks]
        parts, entries, dimensions = codebooks.shape
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            given = _parts(batch.column(0), dimensions)
            for p, file in enumerate(files):
                which, _, _ = file.nearest(given[:, p])
                np.add.at(total[p], which, given[:, p])
                count[p] += np.bincount(which, minlength=entries)
        p, e, d = np.unravel_index(np.arange(total.size), total.shape)
        met = count[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (p.astype(np.int32), e.astype(np.int32), d.astype(np.int32), total.ravel(), count[p, e])], ["part", "entry", "dimension", "total", "count"])

    return run


def start(kept: DataFrame) -> Codebooks | None:
    """Codebooks of the first ENTRIES kept rows, None if there is none."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = [r.v for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    if not first:
        return None
    if len({len(v) for v in first}) > 1:
        first = [r.v for r in kept.filter(F.length("v") == len(first[0])).orderBy(*order).limit(ENTRIES).collect()]
    return np.stack([np.frombuffer(v, "<i4").reshape(PARTS, -1) for v in first], 1).astype(np.int64)


def refine(kept: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: entries become the floors of their parts' means; unused ones stay."""
    sums = kept.select("v").mapInArrow(_sums(codebooks), "part int, entry int, dimension int, total long, count long")
    new = codebooks.copy()
    for p, e, d, total, count in sums.groupBy("part", "entry", "dimension").agg(F.sum("total"), F.sum("count")).collect():
        new[p, e, d] = total // count
    return new


def codes(kept: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (an array of entry indexes), error, refined (pairs with an exact distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(c) for c in codebooks]
        for batch in batches:
            given = _parts(batch.column(2), codebooks.shape[2])
            which, errors = np.zeros((len(given), PARTS), np.int32), np.zeros(len(given), np.int64)
            for p, file in enumerate(files):
                which[:, p], error, _ = file.nearest(given[:, p])
                errors += error
            code = pa.ListArray.from_arrays(np.arange(len(given) + 1, dtype=np.int32) * PARTS, pa.array(which.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(errors)], ["vec_id", "label", "code", "error"])

    schema = kept.select("vec_id", "label", F.array(F.lit(0)).alias("code"), F.lit(0).cast("long").alias("error")).schema
    return kept.mapInArrow(run, schema)


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error of the kept rows, and the codebooks (None without a kept row)."""
    kept = materialise(integers(rows, key, vector, label), "vector-integers")
    codebooks = start(kept)
    if codebooks is None:
        empty = kept.select("vec_id", "label", F.array(F.lit(0)).alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0), None
    fitting = kept.filter(F.length("v") == codebooks.shape[0] * codebooks.shape[2] * 4)
    for _ in range(rounds):
        codebooks = refine(fitting, codebooks)
    told = materialise(codes(fitting, codebooks), "vector-codes")
    discard(kept)
    return told, codebooks


def codebooks_text(codebooks: Codebooks | None) -> str:
    """All entries' components by part, entry and place, comma-joined."""
    return "" if codebooks is None else ",".join(map(str, codebooks.ravel().tolist()))


def with_label_error(told: DataFrame) -> DataFrame:
    """told with label_error: errors summed over equal labels, nulls together."""
    by = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = told.withColumn("by", by)
    sums = rows.groupBy("by").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    return with_group(rows, materialise(sums, "label-errors"), "by", "size", told.count()).drop("by", "size")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    told, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return with_label_error(told).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as one pair of tables each: assignments and codebooks."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT id, part, any_value(q) AS q, (min(far * 16 + entry) % 16)::INT AS entry, (min(far * 16 + entry) // 16)::BIGINT AS far
  FROM (SELECT id, p.part, q, entry, list_sum(list_transform(list_zip(q, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::HUGEINT AS far FROM p JOIN c{r} c ON c.part = p.part)
  GROUP BY id, part)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT part, entry, list(floor_mean ORDER BY i) AS m FROM (
      SELECT part, entry, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM (SELECT part, entry, unnest(q) AS x, unnest(range(1, len(q) + 1)) AS i FROM a{r}) GROUP BY part, entry, i)
    GROUP BY part, entry) USING (part, entry))"""
    tables = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS q FROM v CROSS JOIN (SELECT unnest(range(0, 8)) AS part))",
        "c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, q AS c FROM p WHERE id <= 16)",
    ]
    for r in range(ROUNDS):
        tables += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    tables.append(nearest.format(r=ROUNDS))
    tables.append(f"told AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY id)")
    tables.append(f"book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})")
    return f"WITH {', '.join(tables)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN told USING (id) CROSS JOIN book"


OP11_SQL = _sql()
