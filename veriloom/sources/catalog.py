"""Manual catalogs and crawl manifests."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import first_wins, latest

ENTRY = "id INT, url STRING, publishDate STRING, version STRING, name STRING"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array file (a byte order mark is skipped), in file order."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    rows = raw.select(F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{ENTRY.replace(' INT', ': INT').replace(' STRING', ': STRING')}>>", {"mode": "FAILFAST"})).alias("ordinal", "e"))
    return rows.select("ordinal", "e.*")


def fetched(spark: SparkSession, url: str, hosts: list[str], fetch: Callable[[str], bytes]) -> DataFrame:
    """Entries of a catalog that fetch(url) returns; a url that is not https or of another host raises."""
    told = urlparse(url)
    if told.scheme != "https" or told.hostname not in hosts:
        raise ValueError(f"bad catalog url: {url}")
    payload = json.loads(fetch(url).decode("utf-8-sig"))
    if not isinstance(payload, list) or not all(isinstance(x, dict) for x in payload):
        raise ValueError("a catalog is a list of objects")
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([(i, *(x.get(n) for n in names)) for i, x in enumerate(payload)], f"ordinal INT, {ENTRY}")


def parsed(entries: DataFrame, hosts: list[str], url: str = "url") -> DataFrame:
    """entries with manual_key and snapshot_id from their url; the first of equal urls stays.

    The query is cut off. A url that is not https, of another host, with fewer than five path parts,
    not ending in index.html or with a snapshot that is no number raises.
    """
    clean = F.split(url, r"\?").getItem(0)
    parts = F.split(F.regexp_extract(clean, "^[a-z]+://[^/]+(/.*)$", 1), "/")
    host = F.regexp_extract(clean, "^https://([^/]+)/", 1)
    good = host.isin(*hosts) & (F.size(parts) >= 5) & (F.element_at(parts, -1) == "index.html") & F.element_at(parts, -2).rlike("^[0-9]+$")
    rows = entries.withColumn(url, F.when(F.coalesce(good, F.lit(False)), clean).otherwise(F.raise_error(F.concat(F.lit("bad catalog url: "), F.coalesce(F.col(url), F.lit("null")))).cast("string")))
    rows = first_wins(rows, url, "ordinal")
    parts = F.split(F.regexp_extract(url, "^[a-z]+://[^/]+(/.*)$", 1), "/")
    return rows.withColumn("manual_key", F.element_at(parts, -3)).withColumn("snapshot_id", F.element_at(parts, -2))


def selected(entries: DataFrame, pattern: str | None = None, limit: int | None = None, *columns: str) -> DataFrame:
    """Entries whose name or key the case-insensitive pattern is found in, the first `limit` of them."""
    columns = columns or ("name", "manual_key")
    if pattern:
        found: Column = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
        entries = entries.filter(found)
    rows = entries.orderBy("ordinal")
    return rows.limit(limit) if limit else rows


def manifest_state(lines: DataFrame) -> DataFrame:
    """The last ok row per url of an append-only manifest. lines: ordinal, value (JSON); bad lines are skipped."""
    row = F.from_json("value", "url STRING, status STRING, etag STRING, last_modified STRING, path STRING")
    rows = lines.select("ordinal", row.alias("r")).select("ordinal", "r.*")
    return latest(rows, "url", "ordinal", F.col("status") == "ok")
