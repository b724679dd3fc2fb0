"""Secrets in whole texts: plain patterns, and novelty against a primed zstandard dictionary.

Base kinds are patterns: an assignment to a sensitive name (assign), an access key id (access), a
long lower-case hex run (hex). The method adds kind `novel`: a long run of key characters with a
sensitive word in it or within WINDOW bytes to either side, over line ends, is a candidate. Its
novelty is the bytes it adds to a zstandard frame of the text around it, under a dictionary of
common identifiers. Other candidates are left out of that text, so that a key neither primes its own
repetition nor the next line of itself; a candidate without lower-case letters is measured in
lower case, as constants are names too. That measure alone decides, also where a base kind has
found the same stretch.
Words, identifiers and what stands nearby cost few bytes, as the frame's codes are fitted to the text
around; random key material costs about what its entropy says. Candidates that stay incompressible
are reported. Base findings stay as they are.

Scale: a map over documents without a shuffle. Cheap byte searches decide which patterns a text
needs. The text around a candidate is WINDOW bytes to either side, so a candidate's cost has a bound
however long the text is; every candidate of every text is measured.

Defined results: null counts as empty, and an empty text has no finding; offsets are code points,
ends are exclusive; rows that repeat are scanned each; findings of one kind never overlap; a novel
one may lie over base ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_ONLY = bytes(49 if b in b"0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * 24

#: Words that make the text around them a sensitive context.
CONTEXT = (b"key", b"secret", b"token", b"passw", b"passphrase", b"pwd", b"auth", b"credential", b"bearer", b"private", b"signature", b"signing", b"session", b"cookie", b"salt", b"hmac", b"webhook", b"connection")
_CONTEXT = re.compile(rb"(?:%s)" % b"|".join(CONTEXT), re.IGNORECASE)
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_LOWER = re.compile(rb"[a-z]")
#: Bytes of surrounding text on either side that prime the dictionary and may hold the sensitive word.
WINDOW = 1024
#: Marginal compressed bytes per byte from which a candidate is novel. Of planted random keys about
#: 3 in 100 stay below, of joined words, identifiers and paths about 10 in 100 lie above.
NOVELTY = 0.75

#: Identifiers that code is full of; they prime every dictionary.
IDENTIFIERS = b" ".join(
    (
        b"abstract application arguments assert async attribute authentication authorization await backend balance boolean break buffer builder button",
        b"cache callback catch certificate channel char class client collection column command commit component config configuration connect connection const constructor",
        b"container content context continue controller cookie count create credential current database dataset datetime debug default delete description destination",
        b"development device dictionary directory document domain double element encoding encryption endpoint environment error event example exception execute export",
        b"expression extends factory false file final finally float folder format function gateway generate global handler header hostname identifier implements",
        b"import index information initialize input instance integer interface internal iterator javascript keyboard language length library listener localhost location",
        b"logger management manager message metadata method middleware migration module namespace network notification null number object operation options organization",
        b"output package parameter parent partition password path pattern payload permission pipeline platform plugin policy postgres primary private process production",
        b"profile project property protected protocol provider public publickey python query queue random range record reference register registry repository request",
        b"required resource response result return router runtime schedule schema scheme secret security select sequence serialize server service session settings",
        b"signature source staging standard statement static status storage stream string struct subscription success summary switch synchronized system table target",
        b"template terminal test thread throw timeout timestamp token transaction transform true tuple type undefined undefined unique update upload user username",
        b"utility validate value variable vector version virtual void volume webhook widget window workflow workspace wrapper 0123456789 abcdefghijklmnopqrstuvwxyz",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ AKIA BEGIN PRIVATE PUBLIC CERTIFICATE https:// http:// www. .com .org .net application/json Content-Type charset=utf-8 example.com",
    )
)


@lru_cache(1)
def _compressor():
    """One per worker: frames without headers that count, under the identifiers."""
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def novelty(candidate: bytes, before: bytes = b"", after: bytes = b"") -> float:
    """Marginal compressed bytes per byte of the candidate, given identifiers and what surrounds it."""
    before, after = (_CANDIDATE.sub(b" ", x) for x in (before, after))
    if not _LOWER.search(candidate):
        candidate, before, after = candidate.lower(), before.lower(), after.lower()
    packed = lambda data: len(_compressor().compress(data))
    return max(0, packed(before + candidate + after) - packed(before + after)) / max(1, len(candidate))


def base_findings(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, leftmost and non-overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.translate(_HEX_ONLY):
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def novel_findings(text: bytes) -> list[tuple[int, int, int]]:
    """Candidates in sensitive context that neither the text around them nor the dictionary shortens."""
    out, words = [], None
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        if words is None:
            words = [w.span() for w in _CONTEXT.finditer(text)]
        near = bisect_left(words, (max(0, s - WINDOW),))
        if near == len(words) or words[near][1] > e + WINDOW:
            continue
        if novelty(m[0], text[max(0, s - WINDOW) : s], text[e : e + WINDOW]) >= NOVELTY:
            out.append((s, e, 3))
    return out


def findings(text: bytes) -> list[tuple[int, int, int]]:
    """All findings of a text as (start, end, kind) in code points, by start and kind."""
    found = sorted(base_findings(text) + novel_findings(text), key=lambda x: (x[0], x[2]))
    if not found or text.isascii():
        return found
    places = sorted({p for s, e, _ in found for p in (s, e)})
    at, chars, told = 0, 0, {}
    for p in places:
        chars += len(text[at:p].decode("utf-8", "replace"))
        at, told[p] = p, chars
    return [(told[s], told[e], k) for s, e, k in found]


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of findings replaced by the mark."""
    out, at = [], 0
    for s, e, _ in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Findings per document: doc_id, n_assign, n_access, n_hex, n_novel, base, spans (kind:start:end lists)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [findings(x.as_py()) for x in batch.column(1)]
            counts = [pa.array([sum(k == kind for _, _, k in f) for f in found], pa.int64()) for kind in range(len(KINDS))]
            base = pa.array([_told([x for x in f if x[2] < 3]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array([_told(f) for f in found], pa.string())], schema.fieldNames())

    return docs.select(F.col(key).cast("long"), whole(text).cast("binary")).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in the text column replaced by the mark; null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for x in batch.column(at):
                body = x.as_py()
                found = findings(body.encode("utf-8", "replace")) if body else []
                clean.append(redacted(body, found, mark) if found else body)
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")
