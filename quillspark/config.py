"""Parameters of an analysis, from defaults or a YAML file."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Sampling:
    year_start: int = 2015
    year_end: int = 2023
    per_cell: int = 11112
    equal_cells: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Labels:
    positive_from: float = 0.05
    negative_to: float = -0.05
    positive_stars: tuple[int, ...] = (4, 5)
    neutral_stars: tuple[int, ...] = (3,)
    negative_stars: tuple[int, ...] = (1, 2)


@dataclass(frozen=True)
class Words:
    min_df: int = 10
    top_n: int = 25
    max_terms: int = 100_000
    max_ngram: int = 2


@dataclass(frozen=True)
class Bootstrap:
    iterations: int = 10_000
    level: float = 0.95
    seed: int = 42


@dataclass(frozen=True)
class Mismatch:
    high_stars: float = 4
    low_stars: float = 2
    high_score: float = 0.5
    low_score: float = -0.5
    per_direction: int = 50


@dataclass(frozen=True)
class Config:
    """``sources`` maps each category to the paths to try for it, in order."""

    sources: dict[str, tuple[str, ...]] = field(default_factory=dict)
    output: str = "output"
    ascii_least: float = 0.85
    sampling: Sampling = Sampling()
    labels: Labels = Labels()
    words: Words = Words()
    bootstrap: Bootstrap = Bootstrap()
    mismatch: Mismatch = Mismatch()

    def fingerprint(self) -> str:
        """Changes whenever a parameter does; stage outputs carry it."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def _build(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := values.keys() - known.keys():
        raise ValueError(f"{kind.__name__} has no parameters {sorted(unknown)}")
    default = kind()
    made = {}
    for k, v in values.items():
        now = getattr(default, k)
        if is_dataclass(now):
            v = _build(type(now), v or {})
        elif isinstance(now, tuple):
            v = tuple(v)
        elif k == "sources":
            v = {c: (p,) if isinstance(p, str) else tuple(p) for c, p in v.items()}
        made[k] = v
    return kind(**made)


def load_config(path: str | None = None) -> Config:
    """The YAML file at ``path`` over the defaults; unknown names are errors."""
    if path is None:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return _build(Config, yaml.safe_load(f) or {})
