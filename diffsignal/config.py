"""Configuration: layers merged in order, validated, shown as dotted paths."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

MODES = ("runtime", "bench")


def load_yaml(path: str) -> dict[str, Any]:
    """A YAML file as a dict; a missing one is empty."""
    import yaml

    p = Path(path)
    return (yaml.safe_load(p.read_text()) or {}) if p.exists() else {}


def deep_merge(low: Any, high: Any) -> Any:
    """``high`` over ``low``: dicts key by key, everything else (lists and None too) replaced."""
    if isinstance(low, dict) and isinstance(high, dict):
        return low | {k: deep_merge(low[k], v) if k in low else v for k, v in high.items()}
    return high


def clean(value: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in value.items() if v is not None}


DEFAULTS: dict[str, Any] = {
    "llm": {"provider": "local", "model": "canned", "temperature": 0.05},
    "embeddings": {"provider": "local", "model": "hash", "dimension": 16},
    "index": {"chunk_size": 1000, "chunk_overlap": 200},
    "review": {"confidence_threshold": 0.8, "max_signals": 10},
    "context": {"max_chunks": 8},
}


@dataclass(frozen=True)
class Issue:
    path: str
    message: str


def validate(config: dict[str, Any]) -> list[Issue]:
    """What is wrong with a merged configuration."""
    out = []

    def must(path: str, ok: bool, message: str) -> None:
        if not ok:
            out.append(Issue(path, message))

    get = lambda path: _at(config, path)
    size, overlap = get("index.chunk_size"), get("index.chunk_overlap")
    must("index.chunk_size", isinstance(size, int) and size > 0, "must be a positive integer")
    must("index.chunk_overlap", isinstance(overlap, int) and overlap >= 0, "must be an integer from 0")
    if isinstance(size, int) and isinstance(overlap, int):
        must("index.chunk_overlap", overlap < size, "must be smaller than chunk_size")
    t = get("review.confidence_threshold")
    must("review.confidence_threshold", isinstance(t, (int, float)) and 0 <= t <= 1, "must lie between 0 and 1")
    for path in ("review.max_signals", "context.max_chunks", "embeddings.dimension"):
        must(path, isinstance(get(path), int) and get(path) > 0, "must be a positive integer")
    mode = config.get("mode", "runtime")
    must("mode", mode in MODES, f"must be one of {', '.join(MODES)}")
    if mode == "runtime":
        must("llm.provider", bool(get("llm.provider")), "is needed at run time")
    return out


def _at(config: dict[str, Any], path: str) -> Any:
    for part in path.split("."):
        config = config.get(part) if isinstance(config, dict) else None
    return config


def issues_for(issues: list[Issue], prefixes: list[str]) -> list[Issue]:
    return [i for i in issues if any(i.path.startswith(p) for p in prefixes)]


def resolve(*layers: dict[str, Any]) -> tuple[dict[str, Any], list[Issue]]:
    """Defaults under the layers, lowest first (global, repository, command line), with the issues of the result."""
    out = DEFAULTS
    for layer in layers:
        out = deep_merge(out, layer)
    return out, validate(out)


def flatten(config: dict[str, Any], hidden: tuple[str, ...] = ("repository.root",), prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, value) of every leaf but the hidden ones."""
    out = []
    for k, v in config.items():
        path = f"{prefix}{k}"
        if isinstance(v, dict):
            out += flatten(v, hidden, f"{path}.")
        elif path not in hidden:
            out.append((path, str(v)))
    return out


def table_text(rows: list[tuple[str, str]]) -> str:
    """Aligned lines of pairs."""
    width = max((len(k) for k, _ in rows), default=0)
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in rows)
