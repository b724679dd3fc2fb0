"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

A document's set is its distinct shingles of five words (ASCII white space, A-Z lower-cased);
with fewer words the whole sequence is the one shingle. Under each of PERMUTATIONS hash functions
both the minimum and the maximum over the set are kept, so PERMUTATIONS evaluations give twice as
many signature values; BANDS bands of ROWS values go to buckets. At similarity 0.75 a pair shares
no bucket with probability (1 - 0.75**ROWS)**BANDS, about one in a million.

Equal word sequences are collapsed to their smallest document first. Then, without ever listing
all pairs of a bucket:

1. star: each bucket's members are paired with its hub, the member that meets most others over
   all buckets (the original among its copies, as a rule); distinct pairs over all buckets are
   pruned by set sizes (exactly) and by signature (4.5 standard deviations below the threshold),
   and the rest confirmed on full sets computed from whole texts;
2. confirmed links give components;
3. rest: in a bucket whose members still lie in different components, pairs between components are
   looked at within blocks of the bucket, each pair in the first bucket that it shares: first by
   sizes and signatures alone, then, of the documents that these leave a partner in the block, on full
   sets; a link joins its components at once, so a block yields fewer links than members.

Members of one component need no further comparison, as components and not single links are the
outcome.

Scale: texts move once, and only those of documents that share a bucket move on. In confirmation
a paired text is streamed past its star's set, in chunks of CHUNK members, so that a hub costs no
task more than that. All groups (copies, buckets, hubs) are counted before the shuffle, and joined
by plain equi-joins that adaptive execution can split; groups with more than a thousandth of all
rows by broadcast. Signatures of a mixed bucket go to each pair of its blocks, a few hundred bytes
a document; texts only go to the blocks in which they have a partner left.

Defined results: null, empty and blank texts have no shingle and link with nothing; repeated rows
are copies; rows of one doc_id with different texts are texts of their own, which link each by itself
under that doc_id; a null doc_id links with nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, let_go, materialise, mix64, whole, with_group
from .components import components

SHINGLE = 5
PERMUTATIONS = 72
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
SIMILAR, WHOLE = 75, 100
#: Share of equal signature values under which a pair of similarity 0.75 is not expected: 4.5 standard deviations.
ESTIMATE = 0.75 - 4.5 * (0.75 * 0.25 / (2 * PERMUTATIONS)) ** 0.5
CHUNK = 256
BLOCK = 512
REMEMBERED = 150_000

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)
#: Signature values in band order: each band takes minima and maxima of different permutations.
_ORDER = np.random.default_rng(7).permutation(2 * PERMUTATIONS)

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("copy_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bytes", T.BinaryType())])


class WordHashes(dict):
    """64-bit hashes by word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = out * _K + h[i : i + len(out)]
            out ^= out >> np.uint64(29)
        return np.unique(mix64(out))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, in band order."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            ranks = found[None, at : at + 2048] * _A[:, None]
            ranks += _B[:, None]
            np.minimum(low, ranks.min(1), out=low)
            np.maximum(high, ranks.max(1), out=high)
    return np.concatenate([low, high])[_ORDER]


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _K
        for i in range(ROWS):
            key = mix64(key ^ rows[:, i]) + _K
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    hashes, seen = WordHashes(), {}
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = body.as_py().lower().split()
            told = None
            if words and doc is not None:
                key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                told = seen.get(key)
                if told is None:
                    found = shingles(words, hashes)
                    values = signature(found)
                    told = (key, len(found), band_keys(values), (mix64(values) & np.uint64(255)).astype(np.uint8).tobytes())
                    if len(seen) >= 2000:
                        seen.clear()
                    seen[key] = told
            elif words:
                told = (None, len(shingles(words, hashes)), None, None)
            for column, value in zip(out, told or (None, 0, None, None), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], SIGNED.fieldNames())


def signed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).cast("binary").alias("body")).mapInArrow(_sign, SIGNED)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature values, less what one byte of each makes equal by chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            batch = batch.filter(pa.array(_alike(left, right) >= ESTIMATE))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"])


def _sized(left: str, right: str):
    return F.least(left, right) * WHOLE >= F.greatest(left, right) * SIMILAR


def pruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that their sizes and signatures leave possible."""
    side = lambda n: reps.select(F.col("doc_id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("bytes").alias(f"s_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_sized("n_a", "n_b")).select("a", "b", "s_a", "s_b").mapInArrow(_prune, "a long, b long")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (hub, chunk), the hub's own text first."""
    hashes, at, held = WordHashes(), None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for hub, chunk, member, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = shingles(body.lower().split(), hashes)
            if member is None:
                at, held = (hub, chunk), found
            elif at == (hub, chunk):
                both = len(np.intersect1d(held, found, assume_unique=True))
                if WHOLE * both >= SIMILAR * (len(held) + len(found) - both):
                    a.append(hub)
                    b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub a, member b) whose full sets are similar enough. texts: doc_id, body."""
    pairs = materialise(pairs, "pairs")
    chunks = materialise(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n")), "chunks")
    hubs = chunks.join(texts, chunks["a"] == texts["doc_id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "body")
    members = pairs.join(chunks, "a").join(texts, F.col("b") == F.col("doc_id")).select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("chunk"), "b", "body")
    dealt = hubs.unionByName(members).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.select("a", "chunk", "b", "body").mapInArrow(_confirm, "a long, b long")


def _partners(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By member of a sorted block: members of other components behind it that may link, and the labels,
    which may be changed between one member and the next."""
    sig = np.frombuffer(b"".join(group["bytes"]), np.uint8).reshape(len(group), -1)
    bands = np.stack(group["bands"].to_numpy())
    doc, n, part, hub, label = (group[c].to_numpy().copy() for c in ("doc_id", "n_shingles", "part", "hub", "label"))
    apart = group["one"].iloc[0] != group["two"].iloc[0]
    here = int(np.argmax(bands[0] == group["bucket"].iloc[0]))
    for i in range(len(group) - 1):
        rest = np.arange(i + 1, len(group))
        rest = rest[(label[rest] != label[i]) & (np.minimum(n[rest], n[i]) * WHOLE >= np.maximum(n[rest], n[i]) * SIMILAR)]
        rest = rest[(doc[rest] != hub[i]) & (doc[i] != hub[i])]  # the star has seen pairs with the hub
        if apart:
            rest = rest[part[rest] != part[i]]
        if len(rest):
            rest = rest[((bands[rest] == bands[i]).argmax(1) == here) & (_alike(sig[rest], sig[i]) >= ESTIMATE)]
        yield i, rest, label


def _left(group: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block that sizes and signatures leave a partner there."""
    group = group.sort_values("doc_id", ignore_index=True)
    met = np.zeros(len(group), bool)
    for i, rest, _ in _partners(group):
        met[rest] = True
        met[i] |= len(rest) > 0
    return group.loc[met, ["bucket", "one", "two", "hub", "doc_id", "label", "part"]]


def _between(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join components within a block of a bucket: a spanning set of them."""
    group = group.sort_values("doc_id", ignore_index=True)
    doc = group["doc_id"].to_numpy()
    sets: dict[int, np.ndarray] = {}
    hashes = WordHashes()

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(group["body"].iat[i].lower().split(), hashes)
        return sets[i]

    a, b = [], []
    for i, rest, label in _partners(group):
        for j in rest:
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(full(i), full(j), assume_unique=True))
            if WHOLE * both >= SIMILAR * (len(full(i)) + len(full(j)) - both):
                a.append(doc[i])
                b.append(doc[j])
                label[label == label[j]] = label[i]
    return pd.DataFrame({"a": a, "b": b}, dtype=np.int64)


BLOCK_ROW = "bucket long, one int, two int, hub long, doc_id long, label long, part int"


def _blocks(shared: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of BLOCK_ROW: documents of mixed buckets with a partner left, once per such block.
    shared: (bucket, hub, size, doc_id)."""
    known = labels.select(F.col("node").alias("doc_id"), "component")
    told = materialise(shared.filter(F.col("size") > 2).join(known, "doc_id", "left").select("bucket", "hub", "size", "doc_id", F.coalesce("component", "doc_id").alias("label")), "labelled")
    mixed = told.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") != F.col("y")).select("bucket")
    rows = told.join(materialise(mixed, "mixed"), "bucket")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("bucket", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"), "hub", "doc_id", "label", "part")
    rows = rows.join(reps.select("doc_id", "n_shingles", "bands", "bytes"), "doc_id")
    return materialise(rows.groupBy("bucket", "one", "two").applyInPandas(_left, BLOCK_ROW), "blocks")


def _rest_links(shared: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between components that still meet in a bucket."""
    rows = _blocks(shared, labels, reps)
    needed = rows.select("doc_id").distinct()
    if needed.isEmpty():
        return None
    told = materialise(texts.join(needed, "doc_id", "left_semi").join(reps.select("doc_id", "n_shingles", "bands", "bytes"), "doc_id"), "mixed-texts")
    return rows.join(told, "doc_id").groupBy("bucket", "one", "two").applyInPandas(_between, "a long, b long").distinct()


def _numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows in the order of their doc_id, with a number each: row (null without a doc_id), doc_id, text."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).sort(F.col("doc_id").asc_nulls_last(), "text")
    return materialise(rows.select(F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row"), "doc_id", "text"), "numbered")


def _by_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """near_dedup() where one doc_id stands at different texts: rows are told apart by their number,
    and the smallest number of a component is its smallest doc_id."""
    rows = _numbered(docs, text, key)
    told = near_dedup(rows, key="row").withColumnRenamed("doc_id", "row")
    named = rows.select("row", "doc_id").filter(F.col("row").isNotNull())
    out = told.filter(F.col("row").isNotNull()).join(named, "row").join(named.select(F.col("row").alias("component_id"), F.col("doc_id").alias("component")), "component_id")
    out = out.select("doc_id", "n_shingles", "component").unionByName(told.filter(F.col("row").isNull()).select(F.col("row").alias("doc_id"), "n_shingles", F.col("component_id").alias("component")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    rows = materialise(signed(docs, text, key), "signed")
    text_of = F.coalesce("copy_key", F.lit(b""))
    if not rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(text_of).alias("a"), F.max(text_of).alias("b")).filter("a != b").isEmpty():
        discard(rows)
        return _by_rows(docs, text, key)
    copies = materialise(rows.filter(F.col("copy_key").isNotNull()).groupBy("copy_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "copies")
    reps = materialise(rows.filter(F.col("copy_key").isNotNull()).join(copies.select(F.col("rep").alias("doc_id"), F.col("copy_key").alias("own")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "representatives")
    spread = reps.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = materialise(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "buckets")
    members = materialise(spread.join(sizes, "bucket").select("bucket", "size", "doc_id"), "bucket-members")
    met = materialise(members.groupBy("doc_id").agg(F.sum("size").alias("met")), "meetings")
    hubs = materialise(members.join(met, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("met", -F.col("doc_id"))).alias("hub")), "hubs")
    shared = materialise(members.join(hubs, "bucket").select("bucket", "hub", "size", "doc_id"), "bucket-hubs")
    star = shared.filter(F.col("doc_id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    # the one shuffle of texts: of all documents, but only those that share a bucket go further
    body = docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).cast("binary").alias("body"))
    texts = materialise(body.join(met.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("body").alias("body")), "paired-texts")
    links = materialise(confirmed(pruned(star, reps), texts), "links")
    labels = components(links)
    more = _rest_links(shared, labels, reps, texts)
    if more is not None:
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = copies.join(labels, copies["rep"] == labels["node"], "left").select("copy_key", "size", F.coalesce("component", "rep").alias("component"))
    named = materialise(named, "components")
    some = rows.filter(F.col("copy_key").isNotNull()).select("doc_id", "n_shingles", "copy_key")
    out = with_group(some, named, "copy_key", "size", some.count()).select("doc_id", "n_shingles", "component")
    out = out.unionByName(rows.filter(F.col("copy_key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    discard(copies, reps, sizes, members, met, hubs, shared, texts, links)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
