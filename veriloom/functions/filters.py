"""Retrieval filters as predicates: a conjunction of what is set."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS = ("manual_id", "snapshot_id", "vehicle_model")
LISTS = (("manual_keys", "manual_key"), ("manual_names", "manual_name"), ("topic_ids", "topic_id"))


@dataclass(frozen=True)
class RetrievalFilters:
    manual_id: str | None = None
    snapshot_id: str | None = None
    vehicle_model: str | None = None
    manual_keys: list[str] = field(default_factory=list)
    manual_names: list[str] = field(default_factory=list)
    topic_ids: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        """For one filter: reaches the scan. Empty values don't restrict; null never matches."""
        parts = [F.col(name) == getattr(self, name) for name in SCALARS if getattr(self, name)]
        parts += [F.col(column).isin(values) for name, column in LISTS if (values := getattr(self, name))]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def batched(struct: str = "filters") -> Column:
    """For a filter struct column on joined rows."""
    f = lambda name: F.col(f"{struct}.{name}")
    scalars = [f(n).isNull() | (f(n) == "") | F.col(n).eqNullSafe(f(n)) for n in SCALARS]
    lists = [f(n).isNull() | (F.size(f(n)) == 0) | F.coalesce(F.array_contains(f(n), F.col(c)), F.lit(False)) for n, c in LISTS]
    return reduce(lambda a, b: a & b, [*scalars, *lists])
