"""Settings of a run, from YAML or JSON: typed sections with defaults; unknown sections or settings are refused."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from tessera.functions.generation import SYSTEM
from tessera.operators.packing import PackPlan
from tessera.operators.retrieval import B, K1, check_parameters


@dataclass(frozen=True)
class Retrieval:
    """Ranking of paragraphs."""

    top_k: int = 5
    k1: float = K1
    b: float = B


@dataclass(frozen=True)
class Prompting:
    """Texts around question and evidence."""

    system: str = SYSTEM
    instruction: str = ""


@dataclass(frozen=True)
class Split:
    """The examples of a run: a split of the table, or the ids of a manifest."""

    name: str = "validation"
    manifest: str | None = None
    stratify_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """All sections of a run's settings."""

    retrieval: Retrieval = field(default_factory=Retrieval)
    packing: PackPlan = field(default_factory=lambda: PackPlan("run"))
    prompting: Prompting = field(default_factory=Prompting)
    split: Split = field(default_factory=Split)

    def resolved(self) -> dict[str, Any]:
        """Every setting, defaults included, as plain values."""
        return asdict(self)


def build(values: dict[str, Any]) -> Settings:
    """Settings from nested plain values; a single stratification column may be given as a text."""
    kinds = {"retrieval": Retrieval, "packing": PackPlan, "prompting": Prompting, "split": Split}
    if unknown := sorted(set(values) - set(kinds)):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    parts: dict[str, Any] = {}
    for name, kind in kinds.items():
        given = dict(values.get(name) or {})
        if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
            raise ValueError(f"unknown settings of {name}: {', '.join(unknown)}")
        if name == "split":
            by = given.get("stratify_by") or ()
            given["stratify_by"] = (by,) if isinstance(by, str) else tuple(by)
        parts[name] = kind(**({"config_id": "run"} | given if name == "packing" else given))
    check_parameters(parts["retrieval"].k1, parts["retrieval"].b)
    return Settings(**parts)


def load(path: str) -> Settings:
    """Settings from a .json or .yaml file; an empty file gives the defaults."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return build(json.loads(text or "{}"))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml package; JSON does without") from e
    return build(yaml.safe_load(text) or {})
