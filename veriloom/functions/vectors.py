"""Vector expressions on ARRAY<FLOAT> or ARRAY<DOUBLE>."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 where either norm is 0."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


class _Places:
    """Place and sign of tokens, remembered by token; the memory starts anew beyond REMEMBERED."""

    REMEMBERED = 1_000_000
    WORD = re.compile("[a-z0-9]+")

    def __init__(self, dimension: int):
        self.dimension, self.known = dimension, {}

    def __getitem__(self, token: str) -> int:
        """place * 2, and one more where the sign is minus."""
        at = self.known.get(token)
        if at is None:
            digest = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
            at = int.from_bytes(digest[:4], "big") % self.dimension * 2 + digest[4] % 2
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[token] = at
        return at

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Signed sums by text and place, and whether any token met the place. texts are lower-cased."""
        docs, places, n = [], [], len(texts)
        dense = ["".join(t.split()) for t in texts]
        lengths = np.array([len(t) for t in dense], np.int64)
        codes = np.frombuffer("".join(dense).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if len(codes) > 1:
            doc = np.repeat(np.arange(n), lengths)
            inner = doc[1:] == doc[:-1]
            pairs, which = np.unique((codes[:-1] << 21 | codes[1:])[inner], return_inverse=True)
            told = np.array([self[chr(p >> 21) + chr(p & 0x1FFFFF)] for p in pairs.tolist()], np.int64)
            docs.append(doc[:-1][inner])
            places.append(told[which] if len(told) else told)
        words = [self.WORD.findall(t) for t in texts]
        docs.append(np.repeat(np.arange(n), [len(w) for w in words]))
        places.append(np.array([self[w] for ws in words for w in ws], np.int64))
        doc, place = np.concatenate(docs), np.concatenate(places)
        cell = doc * self.dimension + (place >> 1)
        size = n * self.dimension
        value = np.bincount(cell, 1.0 - 2.0 * (place & 1), size).astype(float).reshape(n, -1)
        return value, np.bincount(cell, minlength=size).reshape(n, -1) > 0


#: Characters whose tokens are summed at once, which bounds a worker's memory.
SUMMED = 1_000_000


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (key, lower-cased text, ...) in stretches of about SUMMED characters."""
    sizes = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SUMMED, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _mapped(texts: DataFrame, text: str, key: str, fields: list, run) -> DataFrame:
    rows = texts.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("hash"))
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], *fields]))


def token_hits(texts: DataFrame, dimension: int, text: str = "text", key: str = "id") -> DataFrame:
    """(key, idx, value): signed sums of hashed tokens, the deterministic embedder's raw vector.

    Tokens are character bigrams of the text without white space, and [a-z0-9]+ words. A token's
    SHA-256 gives its place (first four bytes, big-endian, modulo the dimension) and sign (fifth
    byte even: plus). Distinct tokens are hashed once per worker and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dimension)
        for batch in batches:
            for part in _parts(batch):
                value, met = places.sums(part.column(1).to_pylist())
                doc, idx = np.nonzero(met)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(idx.astype(np.int32)), pa.array(value[doc, idx].astype(np.int64))], [key, "idx", "value"])

    return _mapped(texts, text, key, [T.StructField("idx", T.IntegerType()), T.StructField("value", T.LongType())], run)


def hash_embed(texts: DataFrame, dimension: int = 64, text: str = "text", key: str = "id") -> DataFrame:
    """(key, embedding ARRAY<FLOAT>): unit vectors; texts whose sums are all zero use their hash's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dimension)
        for batch in batches:
            for part in _parts(batch):
                value, _ = places.sums(part.column(1).to_pylist())
                for i in np.flatnonzero(~value.any(1)):  # byte i adds to place i modulo the dimension
                    bytes_ = np.frombuffer(part.column(2)[int(i)].as_py(), np.uint8)
                    np.add.at(value[i], np.arange(len(bytes_)) % dimension, (bytes_ - 127.5) / 127.5)
                length = np.linalg.norm(value, axis=1, keepdims=True)
                unit_ = np.divide(value, length, out=value.copy(), where=length > 0).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit_.size + 1, dimension), pa.int32()), pa.array(unit_.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], [key, "embedding"])

    return _mapped(texts, text, key, [T.StructField("embedding", T.ArrayType(T.FloatType()))], run)


def summary(v: Column, top: int = 10, preview: int = 8) -> Column:
    """Dimension, preview, min, max, mean, population deviation, L2 norm, and the largest dimensions."""
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ranked = F.slice(F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("m"), i.alias("i")))), 1, top)
    return F.struct(
        F.size(v).cast("long").alias("dimension"), F.slice(v, 1, preview).alias("preview"), F.array_min(v).cast("double").alias("min"), F.array_max(v).cast("double").alias("max"),
        mean.alias("mean"), F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0))).alias("std"), F.sqrt(square).alias("l2"), F.transform(ranked, lambda r: r["i"]).alias("largest"),
    )
