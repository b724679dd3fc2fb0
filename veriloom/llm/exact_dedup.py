"""Exact deduplication by a minimal perfect hash over historical digests.

History is reduced to its distinct SHA-256 digests. They are dealt to shards by their first
eight bytes; each shard gets a minimal perfect hash (hash and displace: a pilot per bucket,
single keys placed directly), and slot i of the shard holds one full digest, the locator of the
row that wins its group, and the group's size. A lookup computes a slot and compares all 32
bytes held there, so that a digest that was never indexed is told apart from a member.

Members join the historical group that their slot holds; digests that are no members form groups of
their own. The groups after an arrival are the slots, moved forward by their members, and these.

Scale: texts are read once and only digests move. Groups are summed before the shuffle, so a
text that is a third of all rows is one row per task there. The number of shards follows the
number of distinct digests. The way back to single rows is an equi-join on the digest; groups
with more than a thousandth of all rows are broadcast for it (fewer than a thousand rows).

Defined results: null text counts as empty and empty texts are one group; equal texts with equal
doc_id are all kept (doc_id is the row's key); a null doc_id never wins over another; an empty
table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix64, parts_for, whole, with_group

#: Distinct digests a shard holds on average.
SHARD_KEYS = 1024
BUCKET_KEYS = 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

INDEX_SCHEMA = "shard long, n int, pilots binary, digests binary, winners binary, named binary, sizes binary"
#: named: whether any row of the group has a doc_id; without one, winner says nothing.
GROUP_SCHEMA = "digest binary, winner long, named boolean, size long"


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its key as doc_id and the digest of its whole text."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(whole(text), 256)).alias("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """Distinct digests with the largest doc_id, whether there is one, and the number of rows."""
    told = rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))
    return told.select("digest", F.coalesce("winner", F.lit(0)).alias("winner"), F.col("winner").isNotNull().alias("named"), "size")


def _words(keys: np.ndarray, part: int) -> np.ndarray:
    """Bytes 8*part to 8*part+8 of each digest as a number."""
    return np.ascontiguousarray(keys[:, 8 * part : 8 * part + 8]).view("<u8").ravel()


def _slots(second: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(second + (pilots.astype(np.uint64) + np.uint64(1)) * _GOLDEN) % np.uint64(n)).astype(np.int64)


def build_pilots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots by bucket and the slot of each key. keys: distinct digests, (n, 32) uint8."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    home = (_words(keys, 1) % np.uint64(buckets)).astype(np.int64)
    second = _words(keys, 2)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    counts = np.diff(starts)
    pilots = np.zeros(buckets, np.int64)
    slot = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        members = order[starts[b] : starts[b + 1]]
        if len(members) == 0:
            break
        if len(members) == 1:
            break  # buckets of one come last and take the free slots directly
        at = 0
        while True:
            tries = np.arange(at, at + 64)
            there = _slots(second[members][None, :], tries[:, None], n)
            there.sort(axis=1)
            good = ~taken[there].any(axis=1) & (np.diff(there, axis=1) > 0).all(axis=1)
            if good.any():
                pilots[b] = tries[int(np.argmax(good))]
                slot[members] = _slots(second[members], np.full(len(members), pilots[b]), n)
                taken[slot[members]] = True
                break
            at += 64
    free = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(counts == 1):
        place = int(next(free))
        slot[order[starts[b]]] = place
        pilots[b] = -1 - place
    return pilots, slot


def find_slots(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot each digest would have; whether it is there is for the byte check to say."""
    pilot = pilots[(_words(keys, 1) % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -1 - pilot, _slots(_words(keys, 2), np.maximum(pilot, 0), n))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(shard["digest"])
    pilots, slot = build_pilots(keys)
    back = np.argsort(slot)
    column = lambda name, kind: shard[name].to_numpy(kind)[back].tobytes()
    return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "n": [len(keys)], "pilots": [pilots.tobytes()], "digests": [keys[back].tobytes()], "winners": [column("winner", np.int64)], "named": [column("named", bool)], "sizes": [column("size", np.int64)]})


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    # the first 7 bytes of the digest as a number, so that it never is negative
    return groups.withColumn("shard", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("long"), F.lit(shards)))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard: pilots, and the slots' digests, winner locators and group sizes."""
    return _sharded(groups, shards).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def _slots_of(row) -> tuple[np.ndarray, ...]:
    """A shard's slots: digests, winners, whether these are known, sizes."""
    held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    return held, np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["named"], bool).copy(), np.frombuffer(row["sizes"], np.int64).copy()


def find(row, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each digest in a shard's index, and whether all its bytes stand there."""
    at = find_slots(keys, np.frombuffer(row["pilots"], np.int64), int(row["n"]))
    return at, (np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)[at] == keys).all(axis=1)


def _arrive(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """A shard's groups after the asked ones arrived."""
    told = [(_matrix(asked["digest"]), asked["winner"].to_numpy(np.int64), asked["named"].to_numpy(bool), asked["size"].to_numpy(np.int64))]
    fresh = [np.ones(len(asked), bool)]
    if len(index):
        slots = _slots_of(index.iloc[0])
        if len(asked):
            keys, winner, named, size = told[0]
            at, member = find(index.iloc[0], keys)
            at = at[member]  # distinct digests have distinct slots
            _, old, known, sizes = slots
            old[at] = np.where(known[at] & named[member], np.maximum(old[at], winner[member]), np.where(known[at], old[at], winner[member]))
            known[at] |= named[member]
            sizes[at] += size[member]
            told, fresh = [tuple(x[~member] for x in told[0])], [np.ones(int((~member).sum()), bool)]
        told.append(slots)
        fresh.append(np.zeros(len(slots[0]), bool))
    keys, winner, named, size = (np.concatenate(x) for x in zip(*told, strict=True))
    return pd.DataFrame({"digest": [k.tobytes() for k in keys], "winner": winner, "named": named, "size": size, "is_new": np.concatenate(fresh)})


def arrived(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """All groups after groups arrived at an index: a row per slot, moved forward by its member, and
    one per digest that no slot holds (is_new)."""
    asked = _sharded(groups, shards).groupBy("shard")
    return index.groupBy("shard").cogroup(asked).applyInPandas(_arrive, GROUP_SCHEMA + ", is_new boolean")


def exact_dedup(history: DataFrame, incoming: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Decisions over history and incoming rows together; of equal texts the largest key stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, is_new: one row per row of either
    input; is_new marks incoming rows whose digest history did not hold.
    """
    rows = materialise(digests(history, text, key).withColumn("late", F.lit(False)).unionByName(digests(incoming, text, key).withColumn("late", F.lit(True))), "digests")
    old, late = groups_of(rows.filter(~F.col("late"))), groups_of(rows.filter("late"))
    known = rows.filter(~F.col("late")).count()
    shards = parts_for(known, SHARD_KEYS)
    groups = materialise(arrived(build_index(old, shards), late, shards), "groups")
    groups = groups.select("digest", F.when(F.col("named"), F.col("winner")).alias("keep_id"), F.col("size").alias("group_size"), F.col("is_new").alias("fresh"))
    return with_group(rows, groups, "digest", "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), (F.col("late") & F.col("fresh")).alias("is_new")
    )


def split_generations(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table in two generations of about equal size, by a hash of the key."""
    early = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(2)) == 0
    return docs.filter(early), docs.filter(~early)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: one half as history, the other arriving later."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(*split_generations(docs)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
