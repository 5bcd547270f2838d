"""Defaults of the procedures, and a file that overrides them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Parameters:
    assignment: dict = field(default_factory=lambda: {"max_iterations": 250, "gap": 1e-4, "steps_below": 1})
    distribution: dict = field(default_factory=lambda: {"max_iterations": 5000, "tolerance": 1e-4, "balance": 1e-3})
    vdf: dict = field(default_factory=lambda: {"function": "bpr", "parameters": [0.15, 4.0]})

    @classmethod
    def load(cls, path: str) -> Parameters:
        """A JSON file of sections; an unknown section or name is an error."""
        with open(path) as f:
            given = json.load(f)
        base = cls()
        for section, values in given.items():
            known = getattr(base, section, None)
            if known is None or set(values) - set(known):
                raise ValueError(f"unknown parameters in {section}")
            base = replace(base, **{section: {**known, **values}})
        return base

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=1)
