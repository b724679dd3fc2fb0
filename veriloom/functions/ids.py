"""Identities: hashes and name-based UUIDs as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """A version 5 UUID of a UTF-8 name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def document_id(manual: Column, snapshot: Column, topic: Column) -> Column:
    return F.concat_ws(":", manual, snapshot, topic)


def chunk_id(manual: Column, snapshot: Column, topic: Column, section_path: Column, part: Column, text_hash: Column) -> Column:
    """The UUID of a chunk's place and text."""
    return uuid5(F.concat_ws("|", manual, snapshot, topic, F.array_join(section_path, "/"), part.cast("string"), text_hash))


def embedding_key(embedder: str, text: Column) -> Column:
    return F.concat(F.lit(embedder + ":"), sha256(text))
