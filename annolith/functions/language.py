"""Word lists that filter what the grammar finds, by language; languages without lists have empty ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class TemporalRules:
    exact: frozenset[str] = frozenset()
    starts: frozenset[str] = frozenset()
    single: frozenset[str] = frozenset()
    hour_starts: frozenset[str] = frozenset()
    hours: frozenset[str] = frozenset()
    years: frozenset[str] = frozenset()
    prefixes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    person_months: frozenset[str] = frozenset()


@dataclass(frozen=True)
class QuantityRules:
    determiners: frozenset[str] = frozenset()
    multipliers: dict[str, int] = field(default_factory=dict)
    multiplier: str | None = None


_TEMPORAL = {
    "es": TemporalRules(
        exact=frozenset({"SEP"}),
        starts=frozenset("a en de del por para con sin".split()),
        single=frozenset("una un uno unos unas ya ahora primero mar".split()),
        hour_starts=frozenset({"a"}),
        hours=frozenset("una un uno dos tres cuatro cinco seis siete ocho nueve diez once doce".split()),
        years=frozenset({"mil", "1.000", "1000", "2.000"}),
        prefixes={"minute": ("un ",)},
        person_months=frozenset({"julio"}),
    )
}
_MILLION, _BILLION = 10**6, 10**12
_QUANTITY = {
    "es": QuantityRules(
        determiners=frozenset({"un", "una", "uno"}),
        multipliers={"mil": 1000, "millón": _MILLION, "millon": _MILLION, "millones": _MILLION, "billón": _BILLION, "billon": _BILLION, "billones": _BILLION},
        multiplier=r"\s+(mil|millones?|billones?)\b",
    )
}


def _short(language: str) -> str:
    return language.lower().split("-")[0]


def temporal_rules(language: str) -> TemporalRules:
    return _TEMPORAL.get(_short(language), TemporalRules())


def quantity_rules(language: str) -> QuantityRules:
    return _QUANTITY.get(_short(language), QuantityRules())


def language_resource(folder: str, language: str, name: str) -> dict[str, Any]:
    """What ``<folder>/<language>/<name>.yml`` says, the language without a region; empty if there is no such file."""
    import yaml

    path = Path(folder) / _short(language) / f"{name}.yml"
    return (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.is_file() else {}
