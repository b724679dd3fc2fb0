"""Byte-level BPE ids of whole texts: each distinct pre-token is encoded once and joined back.

1. Texts become chunks of up to CHUNK_BYTES: each document a run of pre-tokens in order, and each
   pre-token a place in the chunk's list of distinct ones. That is the explosion into (pre-token,
   position), with the positions of equal pre-tokens of a chunk already combined.
2. Distinct pre-tokens are shuffled by hash, over all chunks; each is encoded once there, and its ids go
   back to the chunks that hold it.
3. A chunk's ids meet its positions and are put together by them.

Decoding takes ids alone: each id is joined with the token-byte table (as many rows as the
vocabulary has), and the bytes are put together by position.

Scale: texts are read once and never shuffled, and neither are positions: chunks are written
(compressed) in buckets of files by chunk, where the ids come to them. What moves is a chunk's distinct
pre-tokens and their ids, in blocks. The number of hash buckets follows the number of
distinct pre-tokens of all chunks, so that a bucket holds about BUCKET_WORDS of them. A pre-token that
every chunk holds would fill its bucket as chunks get more; from BUCKET_CHUNKS chunks on buckets are
salted by chunk, so that it is encoded once per so many chunks. A chunk's memory is bounded by
CHUNK_BYTES and its longest text.

Defined results: null text counts as empty, and an empty text has no ids; every row is encoded, also
of repeated or null doc_id; special tokens' strings are ordinary text; bytes that are no UTF-8
become U+FFFD first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from .common import discard, hold, let_go, materialise, parts_for, whole
from .tokens import vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text of a chunk.
CHUNK_BYTES = 16 << 20
#: Pre-tokens, each once per chunk, that a bucket holds on average.
BUCKET_WORDS = 200_000
#: Chunks that send to one bucket at most, on average.
BUCKET_CHUNKS = 65_536
#: Positions and ids that are looked up at once, but for a longer text's.
STEP = 1 << 18
#: Units a worker remembers within a chunk.
REMEMBERED = 500_000

CHUNK = "chunk long, docs array<long>, lengths array<long>, places binary, n_words long, words binary"
BLOCK = "bucket long, salt long, chunk long, words binary"
FOUND = "chunk long, bucket long, ids binary"
ENCODED = "doc_id long, n_tokens long, ids binary"


def pattern() -> str:
    """The public pattern that cuts texts into pre-tokens."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file's tokens with their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of their places, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers_back(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _two(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def _two_back(packed: bytes) -> tuple[bytes, bytes]:
    cut = 4 + int.from_bytes(packed[:4], "little")
    return packed[4:cut], packed[cut:]


def _words_packed(words: list[bytes]) -> bytes:
    return _two(_numbers(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words), 1))


def _words_back(packed: bytes) -> pa.LargeBinaryArray:
    lengths, joined = _two_back(packed)
    n = _numbers_back(lengths)
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(zstandard.decompress(joined))])


class PreTokens:
    """Distinct pre-tokens of a chunk and their places, texts as runs of places.

    A text is cut before single spaces, as no pre-token crosses these; each distinct unit is matched
    once. Where white space stands on both sides of a space (or the text ends with it), a unit's
    matches would depend on its neighbours, and the whole text is matched.
    """

    def __init__(self) -> None:
        self.match = regex.compile(pattern()).findall
        self.crossing = regex.compile(r"\s (?:\s|$)").search
        self.place: dict[str, int] = {}
        self.units: dict[str, bytes] = {}

    def _run(self, text: str) -> bytes:
        place = self.place
        return array("I", [place.setdefault(word, len(place)) for word in self.match(text)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            if len(self.units) >= REMEMBERED:
                self.units.clear()
            found = self.units[unit] = self._run(" " + unit)
        return found

    def run(self, text: str) -> bytes:
        if self.crossing(text):
            return self._run(text)
        first, *rest = text.split(" ")
        return self._run(first) + b"".join(map(self._unit, rest))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash's upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def chunked(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of CHUNK: documents as runs of places, and the distinct pre-tokens in the order of places,
    which is that of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, count = TaskContext.get().partitionId(), 0

        def chunk(ids: list, lengths: list[int], runs: list[bytes], found: PreTokens) -> pa.RecordBatch:
            words = [w.encode() for w in found.place]
            order = np.argsort(_hashes(words), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            places = _two(_numbers(np.frombuffer(b"".join(runs), np.uint32)), _numbers(rank))
            row = {"chunk": [(part << 33) + count], "docs": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "places": pa.array([places], pa.binary()), "n_words": [len(words)], "words": pa.array([_words_packed([words[i] for i in order])], pa.binary())}
            return pa.RecordBatch.from_pydict(row)

        ids, lengths, runs, found, size = [], [], [], PreTokens(), 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = body.as_py()
                runs.append(found.run(raw.decode("utf-8", "replace")))
                ids.append(doc)
                lengths.append(len(runs[-1]) // 4)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield chunk(ids, lengths, runs, found)
                    count += 1
                    ids, lengths, runs, found, size = [], [], [], PreTokens(), 0
        if ids:
            yield chunk(ids, lengths, runs, found)

    return docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).cast("binary").alias("body")).mapInArrow(run, CHUNK)


def dealt(chunks: DataFrame, buckets: int, salts: int) -> DataFrame:
    """Rows of BLOCK: a chunk's distinct pre-tokens by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, salt, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words_back(packed).to_pylist()
                bucket = _bucket(_hashes(words), buckets)
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[starts] if len(ends) else [], pa.int64()), pa.array([salt] * len(ends), pa.int64()), pa.array([chunk] * len(ends), pa.int64()),
                    pa.array([_words_packed(words[a:b]) for a, b in zip(starts, ends, strict=True)] if len(ends) else [], pa.binary()),
                ], ["bucket", "salt", "chunk", "words"])

    return chunks.filter("n_words > 0").select("chunk", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt"), "words").mapInArrow(run, BLOCK)


def _encoder(path: str):
    """tiktoken's encoder of a single pre-token."""
    import tiktoken

    return hold(f"byte bpe {path}", lambda: tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=ranks(path), special_tokens={})).encode_ordinary


def encoded_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Rows of FOUND: each block's ids, every distinct pre-token of a bucket encoded once."""

    def run(group: pa.Table) -> pa.Table:
        encode = _encoder(path)
        parts = [_words_back(packed) for packed in group["words"].to_pylist()]
        told = pa.concat_arrays(parts).dictionary_encode()
        ids = [encode(word.decode()) for word in told.dictionary.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(np.fromiter((i for one in ids for i in one), np.uint32, int(counts.sum()))))
        out, at = [], 0
        for words in parts:
            which = told.indices.slice(at, len(words))
            at += len(words)
            out.append(_two(_numbers(counts[which.to_numpy()]), _numbers(lists.take(which).flatten().to_numpy())))
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "ids": pa.array(out, pa.binary())})

    return blocks.groupBy("bucket", "salt").applyInArrow(run, FOUND)


def _assembled(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with their ids, put together STEP positions at a time."""
    blocks = [_two_back(ids) for _, ids in sorted(zip(right["bucket"].to_pylist(), right["ids"].to_pylist(), strict=True))]
    counts = np.concatenate([np.zeros(0, np.uint32), *(_numbers_back(c) for c, _ in blocks)])
    values = np.concatenate([np.zeros(0, np.uint32), *(_numbers_back(v) for _, v in blocks)])
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.array(values))
    del blocks
    out = []
    for ids, lengths, places in zip(left["docs"].to_pylist(), left["lengths"].to_pylist(), left["places"].to_pylist(), strict=True):
        runs, rank = map(_numbers_back, _two_back(places))
        ends = np.cumsum([0, *lengths])
        doc = 0
        while doc < len(ids):
            upto = max(doc + 1, int(np.searchsorted(ends, ends[doc] + STEP, "right")) - 1)
            held, tokens = [], np.zeros(upto - doc, np.int64)
            for at in range(int(ends[doc]), int(ends[upto]), STEP):
                which = rank[runs[at : min(at + STEP, int(ends[upto]))]]
                held.append(lists.take(pa.array(which)).flatten().to_numpy())
                if upto > doc + 1:
                    tokens = np.diff(np.concatenate([[0], np.cumsum(counts[which], dtype=np.int64)])[ends[doc : upto + 1] - ends[doc]])
                else:
                    tokens[0] += len(held[-1])
            flat = np.concatenate([np.zeros(0, np.uint32), *held]).astype("<u4", copy=False)
            offsets = np.concatenate([[0], np.cumsum(4 * tokens)]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), upto - doc, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[doc:upto], pa.int64()), pa.array(tokens), packed], ["doc_id", "n_tokens", "ids"]))
            doc = upto
    return pa.Table.from_batches(out)


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """materialise(), dealt into files by a key: a later grouping by it does not shuffle the table."""
    spark = df.sparkSession
    name = f"veriloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).bucketBy(parts, by).saveAsTable(name)
    table = spark.table(name)
    table.written_to, table.named = path, name
    return table


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers): one row per document; and the
    table of chunks that it reads, for drop() after use."""
    chunks = _bucketed(chunked(docs, text, key), "chunk")
    held = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    blocks = dealt(chunks, parts_for(held[1], BUCKET_WORDS), parts_for(held[0], BUCKET_CHUNKS))
    left = chunks.select("chunk", "docs", "lengths", "places").groupBy("chunk")
    return left.cogroup(encoded_blocks(blocks, path).groupBy("chunk")).applyInArrow(_assembled, ENCODED), chunks


def drop(chunks: DataFrame) -> None:
    """The end of a table of chunks."""
    chunks.sparkSession.sql(f"DROP TABLE IF EXISTS {chunks.named}")
    discard(chunks)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the bytes that their ids stand for (binary, in place of a column of that name; null ids give null)."""
    rows = rows.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.LargeBinaryArray:
            held = {rank: token for token, rank in ranks(path).items()}
            return pa.array([held.get(i) for i in range(max(held, default=-1) + 1)], pa.large_binary())

        tokens = hold(f"token bytes {path}", table)
        for batch in batches:
            sizes = np.cumsum([0, *((pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False) // 4).tolist())])
            row = 0
            while row < batch.num_rows:
                upto = max(row + 1, int(np.searchsorted(sizes, sizes[row] + STEP, "right")) - 1)
                part = batch.slice(row, upto - row)
                row = upto
                given = part.column(at).to_pylist()
                asked = np.frombuffer(b"".join(x or b"" for x in given), "<u4")
                told = tokens.take(pa.array(asked[asked < len(tokens)]))
                if len(told) < len(asked) or told.null_count:
                    raise ValueError("an id that the vocabulary does not have")
                offsets = np.frombuffer(told.buffers()[1], np.int64)[told.offset :] if len(told) else np.zeros(1, np.int64)
                data = memoryview(told.buffers()[2]) if len(told) else b""
                ends = offsets[np.cumsum([0, *(len(x or b"") // 4 for x in given)])].tolist()
                out = [None if x is None else bytes(data[a:b]) for x, a, b in zip(given, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, decoded])

    at = rows.columns.index(ids)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(decoded, T.BinaryType())]))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded; the ids alone decoded."""
    path = vocabulary(VOCABULARY)
    rows, chunks = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    told = decode(rows, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    out = materialise(told, "byte-bpe")
    drop(chunks)
    return out
