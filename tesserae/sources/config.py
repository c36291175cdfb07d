"""Configuration files: YAML or JSON with inheritance, and typed sections."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path
from typing import Any, TypeVar

T = TypeVar("T")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; nested sections are merged, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path, seen: tuple[Path, ...] = ()) -> dict[str, Any]:
    """A file with the values of the one it names under ``base_config`` (relative to itself) below its own."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"{path} inherits from itself")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        own = json.loads(text)
    else:
        import yaml

        own = yaml.safe_load(text) or {}
    base = own.pop("base_config", None)
    return merged(load(path.parent / base, (*seen, path)), own) if base else own


def section(kind: type[T], values: dict[str, Any] | None) -> T:
    """A dataclass from a section of values; keys it does not know are left out."""
    known = {f.name for f in dataclasses.fields(kind)}  # type: ignore[arg-type]
    return kind(**{k: v for k, v in (values or {}).items() if k in known})


def fingerprint(values: dict[str, Any]) -> str:
    """16 hexadecimal digits that stand for a configuration."""
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]
