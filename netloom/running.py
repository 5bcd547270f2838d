"""A project's own procedures, their progress, and its log."""

from __future__ import annotations

import importlib.util
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path


def procedures(folder: str, parameters: str | None = None) -> dict[str, Callable]:
    """The public functions of run/__init__.py in a project's folder, with what the JSON file says for each by name as keyword arguments."""
    file = Path(folder) / "run" / "__init__.py"
    if not file.exists():
        raise FileNotFoundError(f"no procedures: {file}")
    spec = importlib.util.spec_from_file_location("project_run", file)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    names = getattr(module, "__all__", [n for n in vars(module) if not n.startswith("_")])
    given = json.loads(Path(parameters).read_text()) if parameters else {}
    found = {n: f for n in names if callable(f := getattr(module, n)) and getattr(f, "__module__", None) == "project_run"}
    if unknown := set(given) - set(found):
        raise ValueError(f"no procedure {', '.join(sorted(unknown))}")
    return {n: partial(f, **given.get(n, {})) for n, f in found.items()}


@dataclass
class Progress:
    """Tells listeners (callables of one event, a dict) what has begun, how far it is, and that it ended."""

    listeners: list[Callable[[dict], None]] = field(default_factory=list)

    def tell(self, what: str, **more) -> None:
        for listener in self.listeners:
            listener({"what": what, **more})

    def over(self, items, name: str, total: int | None = None):
        """Goes through items, telling of each."""
        total = total if total is not None else len(items) if hasattr(items, "__len__") else None
        self.tell("start", name=name, total=total)
        for k, item in enumerate(items, 1):
            yield item
            self.tell("step", name=name, done=k, total=total)
        self.tell("end", name=name)


@dataclass
class Log:
    """A project's log file: a line for each event, with time and level."""

    path: str

    def __post_init__(self):
        self.logger = logging.getLogger(f"netloom.{Path(self.path).resolve()}")
        if not self.logger.handlers:
            handler = logging.FileHandler(self.path, encoding="utf-8")
            handler.setFormatter(logging.Formatter("%(asctime)s;%(levelname)s;%(message)s"))
            self.logger.addHandler(handler)
            self.logger.setLevel(logging.INFO)
            self.logger.propagate = False

    def __call__(self, event: dict | str) -> None:
        self.logger.info(event if isinstance(event, str) else json.dumps(event, default=str))

    def contents(self) -> list[str]:
        return Path(self.path).read_text(encoding="utf-8").splitlines()

    def clear(self) -> None:
        Path(self.path).write_text("", encoding="utf-8")
