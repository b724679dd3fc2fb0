"""Settings: frozen dataclasses from layered mappings with `extends`."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Retrieval:
    retriever: str = "hybrid"
    top_k: int = 5
    candidate_top_k: int = 20
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    min_score: float = 0.0
    per_topic_limit: int = 2
    #: Digits that scores are rounded to before ranking, so that the order of sums cannot decide; none.
    score_digits: int | None = None

    def __post_init__(self):
        if self.top_k < 1 or self.candidate_top_k < self.top_k:
            raise ValueError("candidate_top_k must be at least top_k, and top_k at least 1")
        if not 0 <= self.bm25_b <= 1:
            raise ValueError("bm25_b must be between 0 and 1")


@dataclass(frozen=True)
class Query:
    processor: str = "identity"
    max_queries: int = 4
    aliases: dict[str, str] = field(default_factory=dict)
    expansions: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    chunk_target_chars: int = 900
    chunk_overlap_chars: int = 120
    embedder: str = "hash_mock"
    dimension: int = 64
    vector_store: str = "in_memory"
    reranker: str = "noop"
    generator: str = "mock"
    controller: str = "heuristic"
    chunker: str = "heading"
    evidence_selector: str = "diversified"
    strategy: str = "vanilla"
    max_steps: int = 4
    max_repairs: int = 1
    retrieval: Retrieval = field(default_factory=Retrieval)
    query: Query = field(default_factory=Query)


def merged(base: dict, over: dict) -> dict:
    """Mappings merged deeply; anything else is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_mapping(path: str | Path, seen: tuple[Path, ...] = ()) -> dict[str, Any]:
    """A JSON (or, where the library is there, YAML) file over what it extends; cycles raise."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError("configuration extends itself: " + " -> ".join(p.name for p in (*seen, path)))
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        told = json.loads(text)
    else:
        import yaml

        told = yaml.safe_load(text) or {}
    parents = told.pop("extends", [])
    out: dict[str, Any] = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merged(out, load_mapping(path.parent / parent, (*seen, path)))
    return merged(out, told)


def settings(told: dict[str, Any], prefix: str = "VERILOOM_", environ: dict[str, str] | None = None) -> Settings:
    """Settings from a mapping, with PREFIX_SECTION__NAME environment values on top; unknown names raise."""
    over: dict[str, Any] = {}
    for key, value in (os.environ if environ is None else environ).items():
        if key.startswith(prefix):
            at = over
            *path, last = key[len(prefix) :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[last] = json.loads(value)
            except ValueError:
                at[last] = value
    told = merged(told, over)

    def make(kind, values: dict):
        known = {f.name: f for f in fields(kind)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        nested = {"retrieval": Retrieval, "query": Query}
        return kind(**{k: make(nested[k], v) if k in nested and isinstance(v, dict) else v for k, v in values.items()})

    return make(Settings, told)
