"""Hooks around an analysis, and the settings that a project can have."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .model import CodeGraph


@dataclass
class Hooks:
    """Named callables before (with the root) and after (with the graph) an analysis; run in order of names, the first
    error ends the analysis. A name registered again replaces the one before."""

    _known: dict[str, tuple[str, Callable[[Any], None], str]] = field(default_factory=dict)

    def register(self, name: str, kind: str, call: Callable[[Any], None], description: str = "") -> None:
        if kind not in ("pre", "post"):
            raise ValueError(f"a hook is pre or post, not {kind}")
        self._known[name] = (kind, call, description)

    def unregister(self, name: str) -> bool:
        return self._known.pop(name, None) is not None

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, (k, _, _) in self._known.items() if kind in (None, k))

    def fire(self, kind: str, subject: Any) -> None:
        for name in self.names(kind):
            try:
                self._known[name][1](subject)
            except Exception as e:
                raise RuntimeError(f"{kind} hook {name} failed: {e}") from e

    def around(self, root: Any, build: Callable[[Any], CodeGraph]) -> CodeGraph:
        self.fire("pre", root)
        graph = build(root)
        self.fire("post", graph)
        return graph


def not_empty(graph: CodeGraph) -> None:
    """A post hook: an analysis without symbols is an error."""
    if graph.nodes.isEmpty():
        raise ValueError("the graph has no symbols")


#: Sections and keys of a project's settings, with the type of each.
SETTINGS: dict[str, dict[str, type]] = {
    "project": {"kind": str},
    "index": {"exclude": list, "string_match_cap": int},
    "analysis": {"exclude": list},
    "inconsistencies": {"disabled": list},
    "query": {"min_confidence": float, "depth": int, "token_budget": int, "page_size": int, "include_stale": bool},
}


def settings(text: str) -> dict[str, dict[str, Any]]:
    """Settings of a TOML text; a section, key or type that isn't known is an error that names it."""
    found = tomllib.loads(text)
    for section, values in found.items():
        if section not in SETTINGS or not isinstance(values, dict):
            raise ValueError(f"unknown section [{section}]")
        for key, value in values.items():
            kind = SETTINGS[section].get(key)
            if kind is None:
                raise ValueError(f"unknown key {section}.{key}")
            if not isinstance(value, kind) and not (kind is float and isinstance(value, int)) or (kind is not bool and isinstance(value, bool)):
                raise ValueError(f"{section}.{key} must be {kind.__name__}")
    return found
