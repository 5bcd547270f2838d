"""A workspace: a folder of scenarios, each with tables, registries of matrices and results, and a schema version."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MIGRATIONS: list[tuple[int, Callable[[Workspace], None]]] = []


class Workspace:
    """The root scenario cannot be removed. Names of results are unique in any case; a result's table is Parquet."""

    def __init__(self, spark: SparkSession, root: str, scenario: str = "root"):
        self.spark, self.base, self.scenario = spark, Path(root), scenario

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Workspace:
        if Path(root).exists():
            raise FileExistsError(root)
        made = cls(spark, root)
        made.folder.mkdir(parents=True)
        made._put({"version": max([v for v, _ in MIGRATIONS], default=0), "results": {}, "periods": {"1": [0, 86_400]}})
        return made

    @property
    def folder(self) -> Path:
        return self.base / self.scenario

    def _state(self) -> dict:
        return json.loads((self.folder / "workspace.json").read_text())

    def _put(self, state: dict) -> None:
        part = self.folder / "workspace.json.new"
        part.write_text(json.dumps(state, indent=1))
        part.replace(self.folder / "workspace.json")

    def save(self, name: str, df: DataFrame, procedure: str = "", report: dict | None = None) -> None:
        """A new result; an existing name is an error."""
        state = self._state()
        if name.lower() in {n.lower() for n in state["results"]}:
            raise ValueError(f"there is a result {name}")
        df.write.parquet(str(self.folder / "results" / name.lower()))
        state["results"][name] = {"procedure": procedure, "report": report or {}, "time": time.time()}
        self._put(state)

    def load(self, name: str) -> DataFrame:
        known = {n.lower(): n for n in self._state()["results"]}
        if name.lower() not in known:
            raise KeyError(name)
        return self.spark.read.parquet(str(self.folder / "results" / name.lower()))

    def remove(self, name: str) -> None:
        import shutil

        state = self._state()
        state["results"] = {n: v for n, v in state["results"].items() if n.lower() != name.lower()}
        shutil.rmtree(self.folder / "results" / name.lower(), ignore_errors=True)
        self._put(state)

    def results(self) -> list[dict]:
        return [{"name": n, "exists": (self.folder / "results" / n.lower()).exists()} | v for n, v in sorted(self._state()["results"].items())]

    def reconcile(self) -> dict[str, list[str]]:
        """Records without a table, and tables without a record."""
        names = {n.lower() for n in self._state()["results"]}
        here = {p.name for p in (self.folder / "results").glob("*")}
        return {"missing": sorted(names - here), "unregistered": sorted(here - names)}

    def scenarios(self) -> list[str]:
        return sorted(p.name for p in self.base.iterdir() if (p / "workspace.json").exists())

    def clone(self, name: str) -> Workspace:
        import shutil

        if name in self.scenarios():
            raise ValueError(f"there is a scenario {name}")
        shutil.copytree(self.folder, self.base / name)
        return Workspace(self.spark, str(self.base), name)

    def use(self, name: str) -> Workspace:
        if name not in self.scenarios():
            raise KeyError(name)
        return Workspace(self.spark, str(self.base), name)

    def drop_scenario(self, name: str) -> None:
        import shutil

        if name == "root":
            raise ValueError("the root scenario stays")
        shutil.rmtree(self.use(name).folder)

    def set_period(self, number: int, start: int, end: int) -> None:
        if number == 1:
            raise ValueError("period 1 is the whole day and stays")
        if not 0 <= start < end:
            raise ValueError("a period ends after it starts")
        state = self._state()
        state["periods"][str(number)] = [start, end]
        self._put(state)

    def upgrade(self) -> list[int]:
        """Runs the migrations above the workspace's version, in order."""
        state = self._state()
        done = []
        for version, step in sorted(MIGRATIONS, key=lambda m: m[0]):
            if version > state["version"]:
                step(self)
                state = self._state() | {"version": version}
                self._put(state)
                done.append(version)
        return done
