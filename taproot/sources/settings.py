"""Configuration files, scope lists and rule descriptions."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from taproot.plans.analysis import LEVELS, OFF_BY_DEFAULT, RULES, Configuration

CONFIG_BYTES, SCOPE_BYTES = 1 << 20, 4 << 20

DESCRIPTIONS = {
    "unused-function": "A function or method that no entry point reaches.",
    "unused-type": "A type that no entry point reaches; its members aren't reported again.",
    "unused-property": "A stored or computed property that nothing reads or writes from an entry point.",
    "unused-enum-case": "An enum case that is never made or matched.",
    "unused-import": "A module of which its file uses no name.",
    "unused-public-api": "A public declaration that the corpus doesn't use.",
    "assign-only-property": "A property that is written and never read.",
    "only-tested": "A declaration that only test code reaches.",
    "dead-branch": "A branch whose condition is constant.",
    "dead-store": "A value that is stored and never read.",
}


def _bounded(path: str, most: int) -> str:
    if not os.path.isfile(path) or os.path.getsize(path) > most:
        raise ValueError(f"{path}: not a file of at most {most} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(path: str, production: bool | None = None) -> tuple[Configuration, list[str]]:
    """(configuration, excluded entries). Every key is optional; an unknown rule or severity is an error."""
    data = json.loads(_bounded(path, CONFIG_BYTES))
    rules = data.get("rules", {})
    if unknown := sorted(set(rules) - set(RULES)):
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    for name, r in rules.items():
        if r.get("severity", "warning") not in ("warning", "error"):
            raise ValueError(f"{name}: unknown severity {r['severity']}")
    on = data.get("production", False) if production is None else production
    least = data.get("minimumConfidence", "low")
    if least not in LEVELS:
        raise ValueError(f"unknown confidence {least}")
    return Configuration(rules=rules, production=on, minimum_confidence=least), list(data.get("exclude", []))


def scope_list(content: str) -> list[str]:
    """One path per line, blanks at its ends off, empty lines out."""
    if len(content.encode()) > SCOPE_BYTES:
        raise ValueError("the scope list is too long")
    return [x for line in content.splitlines() if (x := line.strip(" \t"))]


def describe(rules: Iterable[str] = RULES) -> str:
    return "\n".join(f"{r}: {DESCRIPTIONS[r]}" + (" Off by default." if r in OFF_BY_DEFAULT else "") for r in rules)


def repository_root(path: str) -> str | None:
    """The nearest folder above that holds .git, as a folder or file."""
    at = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
