"""Experiment suites: configurations over the same cases in one job, and their report."""

from __future__ import annotations

import json
from dataclasses import asdict
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import retrieval_summary
from ..session import written
from .engine import Engine, evaluate
from .registry import Clients
from .settings import Settings

MEANS = ("precision", "recall", "f1", "rr")
REQUIRED = ("count", *MEANS, "errors")


def config_hash(settings: Settings) -> str:
    """SHA-256 of the settings as JSON with sorted keys."""
    return sha256(json.dumps(asdict(settings), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def differing(base: Settings, other: Settings) -> list[str]:
    """Dotted names of the settings in which two configurations differ."""

    def flat(values: dict, at: str = "") -> dict:
        out = {}
        for k, v in values.items():
            out |= flat(v, f"{at}{k}.") if isinstance(v, dict) and v else {at + k: v}
        return out

    a, b = flat(asdict(base)), flat(asdict(other))
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))


def check_suite(configs: dict[str, Settings], baseline: str, one_factor: bool = True) -> None:
    """A suite names its baseline, its configurations differ, and each from the baseline in one setting."""
    if baseline not in configs:
        raise ValueError(f"no baseline {baseline}; choose one of: {', '.join(sorted(configs))}")
    seen: dict[str, str] = {}
    for name, settings in configs.items():
        if (other := seen.setdefault(config_hash(settings), name)) != name:
            raise ValueError(f"{name} and {other} are the same configuration")
        changed = differing(configs[baseline], settings)
        if one_factor and name != baseline and len(changed) != 1:
            raise ValueError(f"{name} changes {len(changed)} settings: {', '.join(changed)}")


def run_suite(chunks: DataFrame, configs: dict[str, Settings], baseline: str, questions: DataFrame, cases: DataFrame, gold: DataFrame, k: int = 10, one_factor: bool = True, clients: Clients = Clients(), fail_fast: bool = False) -> DataFrame:
    """(config_id, scope, count, metrics, errors, status, error): all cases under all configurations.

    errors: cases whose question a configuration cannot take or that fail while they run; they are
    missing from its means. A configuration that fails as a whole, or in every case, is one row with
    status failed and its error, and the others are run nevertheless, unless fail_fast.
    """
    check_suite(configs, baseline, one_factor)
    spark, out = chunks.sparkSession, None
    for name, settings in configs.items():
        try:
            engine = Engine(chunks, settings, clients=clients)
            rows = written(evaluate({name: engine}, questions, cases, gold, k), "suite-cases")
            failed = rows.filter(F.col("error").isNotNull())
            bad = failed.count()
            if bad and bad == cases.count():
                raise RuntimeError(failed.agg(F.min("error")).first()[0])
            part = retrieval_summary(rows.filter(F.col("error").isNull())).select("scope", "count", *MEANS, F.lit(bad).cast("long").alias("errors"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
        except Exception as error:
            if fail_fast:
                raise
            part = spark.createDataFrame([("all", 0, None, None, None, None, cases.count(), "failed", f"{type(error).__name__}: {str(error)[:500]}")], "scope string, count long, precision double, recall double, f1 double, rr double, errors long, status string, error string")
        part = part.withColumn("config_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def valid_report(row: dict) -> bool:
    """A report row has all its numbers, and whole numbers of cases and errors that are not negative."""
    return all(k in row for k in REQUIRED) and all(isinstance(row[k], int) and row[k] >= 0 for k in ("count", "errors"))
