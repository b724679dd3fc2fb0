"""Pages by a fetch client, with resume from a manifest; and pages that are stored already.

The engine has no network of its own: fetch is a function that loads a client, called once per
worker, which takes (url, etag, last_modified) and returns (status, etag, last_modified, body).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "url string, status string, http int, etag string, last_modified string, html string, error string"


def stored_pages(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(url, html): files of a folder, by the paths of a manifest's ok rows (catalog.manifest_state)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    rows = files.select(F.replace(path, root, F.lit("")).alias("path"), F.decode("content", "UTF-8").alias("html"))
    return manifest.select("url", "path").join(rows, "path").select("url", "html")


def crawl(targets: DataFrame, known: DataFrame, fetch: Callable[[], Callable], retries: int = 3, pause: float = 0.5, interval: float = 0.0) -> DataFrame:
    """PAGE rows: one per target url, status ok, reused or failed.

    known: (url, etag, last_modified, html) of pages that are held; they are asked for conditionally
    and reused where the answer is 304. Errors are tried again after pause * 2**n seconds, at most
    retries times, and then are a row's error: no page's failure stops the others. interval: least
    seconds between two requests of a task.
    """
    rows = targets.select("url").distinct().join(known.select("url", "etag", "last_modified", F.col("html").alias("held")), "url", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, last = fetch(), 0.0
        for frame in frames:
            told = []
            for row in frame.where(frame.notna(), None).itertuples(index=False):
                out = {"url": row.url, "status": "failed", "etag": row.etag, "last_modified": row.last_modified}
                for n in range(retries + 1):
                    if n:
                        time.sleep(pause * 2 ** (n - 1))
                    time.sleep(max(0.0, last + interval - time.monotonic()))
                    last = time.monotonic()
                    try:
                        http, etag, modified, body = client(row.url, row.etag, row.last_modified)
                        out["http"], out["error"] = http, None
                        if http == 304 and row.held is not None:
                            out |= {"status": "reused", "html": row.held}
                        elif http == 200:
                            out |= {"status": "ok", "html": body, "etag": etag, "last_modified": modified}
                        else:
                            out["error"] = f"status {http}"
                            if http >= 500 or http == 429:
                                continue
                        break
                    except Exception as error:  # what a page's client raises is that page's failure
                        out["error"] = f"{type(error).__name__}: {error}"
                told.append(out)
            yield pd.DataFrame(told, columns=[c.split(" ")[0] for c in PAGE.split(", ")], dtype=object).astype({"http": "Int32"})

    return rows.mapInPandas(run, PAGE)


def crawl_report(pages: DataFrame) -> DataFrame:
    """One row: targets, and how many were loaded, reused and failed."""
    at = lambda s: F.count_if(F.col("status") == s)
    return pages.agg(F.count(F.lit(1)).alias("targets"), at("ok").alias("loaded"), at("reused").alias("reused"), at("failed").alias("failed"))
