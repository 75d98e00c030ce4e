"""Strategy documents: YAML to a ScreenSpec, with unknown keys rejected at each level (SRC-23, CAT-01)."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from ..operators import filters, scoring
from .screen import ScreenSpec

TOP = {"name", "version", "category", "description", "screening", "style", "tags", "market_scope"}
SCREENING = {"hard_filters", "factor_weights", "max_output", "tech_weight", "scoring_profile", "enabled"}


def _only(found: dict, known: set[str], where: str) -> None:
    unknown = set(found) - known
    if unknown:
        raise ValueError(f"{where}: unknown keys {', '.join(sorted(unknown))}")


def spec_of(document: dict) -> ScreenSpec:
    """A document's spec; unknown keys, filters, factors' profiles are errors."""
    _only(document, TOP, "strategy")
    screening = document.get("screening") or {}
    _only(screening, SCREENING, "screening")
    hard = screening.get("hard_filters") or {}
    _only(hard, set(filters.BY_NAME), "hard_filters")
    profile = screening.get("scoring_profile") or {}
    _only(profile, set(scoring.PROFILE), "scoring_profile")
    most = int(screening.get("max_output", 5))
    if most <= 0:
        raise ValueError("max_output must be positive")
    return ScreenSpec(str(document["name"]), dict(hard), dict(screening.get("factor_weights") or {}), most, {k: float(v) for k, v in profile.items()})


@lru_cache(maxsize=256)
def _parsed(text: str) -> ScreenSpec:
    import yaml

    return spec_of(yaml.safe_load(text))


def load(path: str | Path) -> ScreenSpec:
    """Read one document; equal contents are parsed once."""
    return _parsed(Path(path).read_text())


def load_all(folder: str | Path) -> tuple[dict[str, ScreenSpec], dict[str, str]]:
    """All documents of a folder by name, and what was wrong with those that were left out."""
    found, wrong = {}, {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        try:
            spec = load(path)
            found[spec.name] = spec
        except (ValueError, KeyError, TypeError) as e:
            wrong[path.name] = str(e)
    return found, wrong


def requirements(spec: ScreenSpec) -> dict[str, list[str]]:
    """Columns that a spec's filters need, by phase."""
    out: dict[str, list[str]] = {"snapshot": [], "daily": [], "flow": []}
    for key, _ in filters.active(spec.hard_filters):
        place = out[{"S": "snapshot", "D": "daily", "F": "flow"}[key.phase]]
        if key.column not in place:
            place.append(key.column)
    return out


def compare(a: ScreenSpec, b: ScreenSpec) -> dict[str, dict]:
    """Differences of two specs: filters and weights that were added, removed or changed (CAT-03)."""

    def diff(x: dict, y: dict) -> dict:
        return {"added": {k: y[k] for k in y.keys() - x.keys()}, "removed": {k: x[k] for k in x.keys() - y.keys()}, "changed": {k: (x[k], y[k]) for k in x.keys() & y.keys() if x[k] != y[k]}}

    return {"hard_filters": diff(a.hard_filters, b.hard_filters), "factor_weights": diff(a.factor_weights, b.factor_weights)}
