"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys shorter than
LEAST_CHARS count nowhere. The exact state is two tables: postings (doc_id, digest), and counts
(digest, refs, first, last): how many postings a key has and the smallest and largest document
holding it. A key is shared when first and last differ. Beside them stand cuckoo filters of 16-bit
fingerprints, one per shard of the digest space, which hold the shared keys: a key enters its
shard's filter when it becomes shared and is deleted from it when it no longer is. insert() and
delete() move all three forward; nothing is forgotten, so a deletion brings back the exact state.

Decisions stream the postings through their shard's filter; what passes is checked against the
exact counts, so a false positive of a filter costs a lookup and never a line.

Scale: postings are 32-byte digests, never lines. Counts are summed before the shuffle. The few
keys that hold more than 1/HOT_SHARE of all postings (there can be no more than HOT_SHARE of
them) are joined by broadcast before the deal to shards; a shard's rows are streamed, not
collected. The number of shards follows the number of postings: when these have doubled since the
last deal, all filters are dealt anew, and a shard whose filter would be fuller than FULL is built
anew from the exact counts, with room for twice its keys.

Defined results: null or empty texts are one empty line; a doc_id that repeats is one document;
rows without doc_id neither count nor lose lines; equal lines within the smallest document all
stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, UPPER, LOWER, ascii_lower, ascii_trim, materialise, parts_for, whole

LEAST_CHARS = 10
SHARD_POSTINGS = 8192
HOT_SHARE = 10_000
#: And a hot key has this many postings, below which its shard takes it like any other.
HOT_LEAST = 1000
SLOTS = 4
#: Share of a filter's cells that may be taken before it is built anew.
FULL = 0.9
_TRIM, _FROM_TO = ASCII_SPACE.encode(), bytes.maketrans(UPPER.encode(), LOWER.encode())

FILTER_SCHEMA = "shard long, buckets int, cells binary, stash binary"


class CuckooFilter:
    """Partial-key cuckoo filter: buckets of SLOTS 16-bit fingerprints (0 is empty), and a stash."""

    KICKS = 200

    def __init__(self, buckets: int, cells: bytes | None = None, stash: bytes = b""):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(buckets, SLOTS).copy()
        self.stash: list[tuple[int, int]] = [tuple(x) for x in np.frombuffer(stash, np.int64).reshape(-1, 2).tolist()]

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8))))))

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and other bucket of each digest ((n, 32) bytes)."""
        words = np.ascontiguousarray(digests[:, 8:24]).view("<u8").reshape(-1, 2)
        prints = (words[:, 0] % np.uint64(65535)).astype(np.int64) + 1
        one = (words[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, self.other(one, prints)

    def other(self, bucket, prints):
        return bucket ^ ((prints * 0x5BD1E995 & 0x7FFFFFFF) & (self.buckets - 1))

    def insert(self, digests: np.ndarray) -> None:
        """All keys at once: each round fills free cells of the buckets asked for, then moves on
        to the other bucket, then puts one key a bucket in place of another, which moves on."""
        prints, at, other = self.places(digests)
        left = self._fill(prints, at)
        prints, at = prints[left], other[left]
        for kick in range(self.KICKS):
            left = self._fill(prints, at)
            prints, at = prints[left], at[left]
            if not len(prints):
                return
            _, one = np.unique(at, return_index=True)
            slot = kick % SLOTS
            out = self.cells[at[one], slot].astype(np.int64)
            self.cells[at[one], slot] = prints[one]
            prints[one] = out
            at[one] = self.other(at[one], out)
        self.stash += list(zip(prints.tolist(), at.tolist(), strict=True))

    def _fill(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free cells of their buckets; the places of those left over."""
        if not len(prints):
            return np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
        empty = self.cells[bucket] == 0
        fits = rank < empty.sum(1)
        # the rank-th free cell of a bucket
        slot = (np.cumsum(empty[fits], 1) == rank[fits, None] + 1).argmax(1)
        self.cells[bucket[fits], slot] = prints[order[fits]]
        return np.sort(order[~fits])

    @property
    def load(self) -> float:
        return (np.count_nonzero(self.cells) + len(self.stash)) / self.cells.size

    def delete(self, digests: np.ndarray) -> None:
        """Of keys that are in the filter only, as with any cuckoo filter."""
        for p, a, b in zip(*(x.tolist() for x in self.places(digests)), strict=True):
            for at in (a, b):
                here = np.flatnonzero(self.cells[at] == p)
                if len(here):
                    self.cells[at, here[0]] = 0
                    break
            else:
                for at in (a, b):
                    if (p, at) in self.stash:
                        self.stash.remove((p, at))
                        break

    def holds(self, digests: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(digests)
        found = ((self.cells[one] == prints[:, None]) | (self.cells[two] == prints[:, None])).any(1)
        for p, at in self.stash:
            found |= (prints == p) & ((one == at) | (two == at))
        return found

    def row(self, shard: int) -> tuple[int, int, bytes, bytes]:
        return shard, self.buckets, self.cells.tobytes(), np.array(self.stash, np.int64).tobytes()


@dataclass(frozen=True)
class LineState:
    """The index: all DataFrames, so that it can be written, read and moved forward."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _shard_of(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("long"), F.lit(shards))


def postings_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest) for each distinct key of at least LEAST_CHARS code points in a document."""
    lines = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.explode(F.array_distinct(F.split(ascii_lower(whole(text)), "\n", -1))).alias("line"))
    keys = lines.select("doc_id", ascii_trim(F.col("line")).alias("line")).filter(F.char_length("line") >= LEAST_CHARS)
    return keys.select("doc_id", F.unhex(F.sha2("line", 256)).alias("digest"))


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("digest").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _shared(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("first") != F.col("last"))


def _move(old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after insertions and deletions, or a row without cells if it gets too full."""
    shard = int((old if len(old) else changes)["shard"].iloc[0])
    added, gone = (_matrix(changes.loc[changes["added"] == flag, "digest"]) for flag in (True, False))
    if len(old):
        row = old.iloc[0]
        held = CuckooFilter(int(row["buckets"]), row["cells"], row["stash"])
    else:
        held = CuckooFilter.sized(len(added))
    held.delete(gone)
    if held.load + len(added) / held.cells.size > FULL:
        return pd.DataFrame([(shard, 0, b"", b"")], columns=["shard", "buckets", "cells", "stash"])
    held.insert(added)
    return pd.DataFrame([held.row(shard)], columns=["shard", "buckets", "cells", "stash"])


def _build(group: pd.DataFrame) -> pd.DataFrame:
    held = CuckooFilter.sized(2 * len(group))
    held.insert(_matrix(group["digest"]))
    return pd.DataFrame([held.row(int(group["shard"].iloc[0]))], columns=["shard", "buckets", "cells", "stash"])


def filters_of(counts: DataFrame, shards: int) -> DataFrame:
    """Filters built from the exact counts."""
    return _shared(counts).select("digest").withColumn("shard", _shard_of(shards)).groupBy("shard").applyInPandas(_build, FILTER_SCHEMA)


def build(docs: DataFrame, text: str = "text", key: str = "doc_id") -> LineState:
    """The state over a first set of documents."""
    postings = materialise(postings_of(docs, text, key), "postings")
    shards = parts_for(postings.count(), SHARD_POSTINGS)
    counts = materialise(_counts(postings), "line-counts")
    return LineState(postings, counts, filters_of(counts, shards), shards)


def _moved(state: LineState, postings: DataFrame, touched: DataFrame) -> LineState:
    """The state with other postings; touched: digests whose postings changed."""
    postings = materialise(postings, "postings")
    new = _counts(postings.join(touched, "digest", "left_semi"))
    was = state.counts.join(touched, "digest", "left_semi")
    change = was.select("digest", (F.col("first") != F.col("last")).alias("a")).join(new.select("digest", (F.col("first") != F.col("last")).alias("b")), "digest", "full")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    change = change.filter(a != b).select("digest", b.alias("added")).withColumn("shard", _shard_of(state.shards))
    counts = materialise(state.counts.join(touched, "digest", "left_anti").unionByName(new), "line-counts")
    shards = parts_for(postings.count(), SHARD_POSTINGS)
    if shards > 2 * state.shards:
        return LineState(postings, counts, materialise(filters_of(counts, shards), "line-filters"), shards)
    moved = materialise(state.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(_move, FILTER_SCHEMA), "line-filters")
    full = moved.filter("buckets = 0").select("shard")
    if not full.isEmpty():
        anew = _shared(counts).select("digest", _shard_of(state.shards).alias("shard")).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, FILTER_SCHEMA)
        moved = materialise(moved.filter("buckets > 0").unionByName(anew), "line-filters")
    return LineState(postings, counts, moved, state.shards)


def insert(state: LineState, docs: DataFrame, text: str = "text", key: str = "doc_id") -> LineState:
    """The state after documents (with keys not yet in it) arrive."""
    new = materialise(postings_of(docs, text, key), "postings")
    return _moved(state, state.postings.unionByName(new), new.select("digest").distinct())


def delete(state: LineState, keys: DataFrame) -> LineState:
    """The state after documents go: keys has doc_id."""
    gone = keys.select(F.col("doc_id").cast("long")).distinct()
    touched = state.postings.join(gone, "doc_id", "left_semi").select("digest").distinct()
    return _moved(state, state.postings.join(gone, "doc_id", "left_anti"), touched)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its filter's row first; postings that pass their filter."""
    shard, held = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        kinds = batch.column("kind").to_numpy()
        keep = []
        edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])]) if len(shards) else []
        for s, e in zip(edges, [*edges[1:], len(shards)], strict=True):
            if kinds[s] == 0:
                row = {n: batch.column(n)[int(s)].as_py() for n in ("buckets", "cells", "stash")}
                shard, held = shards[s], CuckooFilter(row["buckets"], row["cells"], row["stash"])
            elif shards[s] == shard and held is not None:
                keep.append(s + np.flatnonzero(held.holds(_matrix(batch.column("digest").slice(int(s), int(e - s)).to_pylist()))))
        at = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("digest").take(at)], ["doc_id", "digest"])


def drops(state: LineState) -> DataFrame:
    """(doc_id, digest) of the keys whose lines a document loses."""
    total = state.counts.agg(F.sum("refs")).first()[0] or 0
    hot = (F.col("refs") * HOT_SHARE > total) & (F.col("refs") > HOT_LEAST)
    shared = _shared(state.counts)
    # fewer than HOT_SHARE keys can each hold more than 1/HOT_SHARE of the postings
    hottest = F.broadcast(state.counts.filter(hot).select("digest", "first", "last"))
    marked = state.postings.join(hottest, "digest", "left")
    common = marked.filter(F.col("first") != F.col("last")).filter(F.col("doc_id") != F.col("first")).select("doc_id", "digest")
    rest = marked.filter(F.col("first").isNull()).select("doc_id", "digest")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = rest.select(_shard_of(state.shards).alias("shard"), F.lit(1).alias("kind"), "doc_id", "digest", none("int", "buckets"), none("binary", "cells"), none("binary", "stash"))
    sides = state.filters.select("shard", F.lit(0).alias("kind"), none("long", "doc_id"), none("binary", "digest"), "buckets", "cells", "stash")
    passed = sides.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe, "doc_id long, digest binary")
    exact = passed.join(shared.filter(~hot).select("digest", "first"), "digest").filter(F.col("doc_id") != F.col("first")).select("doc_id", "digest")
    return common.unionByName(exact)


def _keys(lines: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(x.translate(_FROM_TO).strip(_TRIM)).digest() for x in lines]


def apply(docs: DataFrame, dropped: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256, and the kept text if wanted."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if keep_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for body, lost in zip(batch.column(1), batch.column(2), strict=True):
                body, lost = body.as_py(), lost.as_py()
                n = body.count(b"\n") + 1
                kept = body
                if lost:
                    lines, lost = body.split(b"\n"), set(lost)
                    lines = [x for x, k in zip(lines, _keys(lines), strict=True) if k not in lost]
                    kept = b"\n".join(lines)
                    out[1].append(n - len(lines))
                else:
                    out[1].append(0)
                out[0].append(n)
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            if keep_text:
                columns.append(pa.array(out[3], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    by_doc = dropped.groupBy("doc_id").agg(F.collect_set("digest").alias("lost"))
    body = docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).cast("binary").alias("body"))
    return body.join(by_doc, "doc_id", "left").select("doc_id", "body", "lost").mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply(docs, drops(build(docs)), keep_text=False)


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND s.first_doc <> l.doc_id AS lost
  FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
