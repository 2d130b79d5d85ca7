"""Plug-ins: parsers, extractors and encoders by name, in an order that honours what each requires."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


@dataclass
class Registry:
    """Named steps of one kind. A later registration of a name replaces the earlier one."""

    steps: dict[str, Callable] = field(default_factory=dict)
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def register(self, name: str, step: Callable, requires: tuple[str, ...] = ()) -> None:
        self.steps[name], self.needs[name] = step, requires

    def order(self, enabled: list[str] | None = None) -> list[str]:
        """The enabled steps and what they require, requirements first; ValueError for unknown names and cycles."""
        wanted, seen = list(enabled if enabled is not None else self.steps), {}
        while wanted:
            name = wanted.pop()
            if name not in self.steps:
                raise ValueError(f"unknown step {name}")
            if name not in seen:
                seen[name] = self.needs[name]
                wanted += self.needs[name]
        try:
            return list(TopologicalSorter({n: sorted(seen[n]) for n in sorted(seen)}).static_order())
        except CycleError as e:
            raise ValueError(f"steps require each other: {e.args[1]}") from e


def merged_config(*layers: dict) -> dict:
    """Later layers over earlier ones, dictionaries within dictionaries."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
