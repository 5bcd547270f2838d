"""Outcomes of assignments as tables by link and pair, and where they are kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.assignment import Equilibrium
from netloom.sources.results import skim_names
from netloom.sources.workspace import Workspace

SIDES = ((1, "AB"), (-1, "BA"))


def by_side(edges: DataFrame, column: str, name: str, both: str) -> list:
    """Aggregates of a column by link: its value along the link and against it (null where there is no such edge), and both as their sum (tot) or
    larger one (Max, max)."""
    ab, ba = (F.max(F.when(F.col("direction") == way, F.col(column))) for way, _ in SIDES)
    one = F.coalesce(ab, F.lit(0.0)) + F.coalesce(ba, F.lit(0.0)) if both == "tot" else F.greatest(ab, ba)
    return [ab.alias(f"{name}_AB"), ba.alias(f"{name}_BA"), one.alias(f"{name}_{both}")]


def link_outcomes(edges: DataFrame) -> DataFrame:
    """One row a link of edges(link_id, direction, preload, time, free_time, capacity, pce): preload, congested time, delay factor (0 where free
    flow takes no time), volume over capacity and flow, each along the link, against it, and both."""
    rows = edges.withColumn("voc", F.col("pce") / F.col("capacity")).withColumn("delay", F.when(F.col("free_time") > 0, F.col("time") / F.col("free_time")).otherwise(0.0))
    fields = (("preload", "Preload", "tot"), ("time", "Congested_Time", "Max"), ("delay", "Delay_factor", "Max"), ("voc", "VOC", "max"), ("pce", "PCE", "tot"))
    return rows.groupBy("link_id").agg(*[x for column, name, both in fields for x in by_side(edges, column, name, both)])


def class_flows(edges: DataFrame, names: list[str]) -> DataFrame:
    """(link_id, name_ab, name_ba, name_tot) for each class's flow, 0 where nothing was loaded."""
    sides = [F.sum(F.when(F.col("direction") == way, F.col(n)).otherwise(0.0)).alias(f"{n}_{side.lower()}") for n in names for way, side in SIDES]
    wide = edges.groupBy("link_id").agg(*sides)
    return wide.select("link_id", *[x for n in names for x in (f"{n}_ab", f"{n}_ba", (F.col(f"{n}_ab") + F.col(f"{n}_ba")).alias(f"{n}_tot"))])


def side_by_side(tables: list[DataFrame], key: str = "link_id") -> DataFrame:
    """Columns of several tables by one key; a key that one lacks has nulls there."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def results(spark, found: Equilibrium, keep_zero: bool = True) -> DataFrame:
    """An equilibrium's flows by class and its link outcomes; keep_zero False leaves out links without flow."""
    edges = found.to_df(spark).join(found.free_df(spark), ["link_id", "direction"])
    out = side_by_side([class_flows(edges, [c.name for c in found.classes]), link_outcomes(edges)])
    return out if keep_zero else out.where("PCE_tot > 0")


def save_results(workspace: Workspace, name: str, found: Equilibrium, keep_zero: bool = True) -> None:
    """A new result of the workspace, with the iterations and the classes in its report; an existing name is an error."""
    setup = {"classes": {c.name: {"pce": c.pce, "vot": c.vot, "core": c.core, "fixed_cost": c.fixed_cost} for c in found.classes}, "converged": found.converged}
    workspace.save(name, results(workspace.spark, found, keep_zero), "traffic assignment", {"convergence": found.report, "setup": setup})


def all_skims(final: DataFrame, blended: DataFrame | None = None, which: str = "final") -> DataFrame:
    """Skims of the last iteration (_final), averaged as the flows are (_blended), or both."""
    if which not in ("final", "blended", "all"):
        raise ValueError("skims are final, blended or all")
    if which != "final" and blended is None:
        raise ValueError("no blended skims were made")
    if which == "all":
        return skim_names(final, "final").join(skim_names(blended, "blended"), ["origin", "destination"], "full")
    return skim_names(final, "final") if which == "final" else skim_names(blended, "blended")


def blend(before: DataFrame | None, now: DataFrame, alpha: float) -> DataFrame:
    """Skims averaged with the step that the flows took: before + alpha * (now - before)."""
    if before is None:
        return now
    names = [c for c in now.columns if c not in ("origin", "destination")]
    both = before.join(now.withColumnsRenamed({n: f"__{n}" for n in names}), ["origin", "destination"], "full")
    return both.select("origin", "destination", *[(F.coalesce(n, F.lit(0.0)) + alpha * (F.coalesce(f"__{n}", F.lit(0.0)) - F.coalesce(n, F.lit(0.0)))).alias(n) for n in names])


def select_link_cores(od: DataFrame, cores: list[str]) -> DataFrame:
    """(origin, destination, set_core ..): the demand of each select-link set as a matrix core of its own, 0 where a pair has none."""
    sets = sorted(r[0] for r in od.select("set").distinct().collect())
    sums = [F.sum(F.when(F.col("set") == s, F.col(c)).otherwise(0.0)).alias(f"{s}_{c}") for s in sets for c in cores]
    return od.groupBy("origin", "destination").agg(*sums)


def select_link_flows(flows: DataFrame, cores: list[str]) -> DataFrame:
    """(link_id, set_core_ab, _ba, _tot) of links that a set's demand uses."""
    sets = sorted(r[0] for r in flows.select("set").distinct().collect())
    wide = flows.select("link_id", "direction", *[F.when(F.col("set") == s, F.col(c)).otherwise(0.0).alias(f"{s}_{c}") for s in sets for c in cores])
    return class_flows(wide, [f"{s}_{c}" for s in sets for c in cores])


def save_select_link(workspace: Workspace, name: str, od: DataFrame, flows: DataFrame, cores: list[str]) -> None:
    """Both tables of a select-link analysis: name_matrices and name_flows."""
    workspace.save(f"{name}_matrices", select_link_cores(od, cores), "select link")
    workspace.save(f"{name}_flows", select_link_flows(flows, cores), "select link")


def save_transit_results(workspace: Workspace, name: str, volumes: dict[str, DataFrame], keep_zero: bool = True) -> None:
    """Volumes(edge, volume) by class as class_volume, side by side."""
    named = [df.groupBy("edge").agg(F.sum("volume").alias(f"{c}_volume")) for c, df in sorted(volumes.items())]
    both = side_by_side(named, "edge").fillna(0.0)
    kept = both if keep_zero else both.where(reduce(lambda a, b: a | b, [F.col(f"{c}_volume") > 0 for c in sorted(volumes)]))
    workspace.save(name, kept, "transit assignment")


def save_skims(workspace: Workspace, name: str, skims: DataFrame, procedure: str = "network skimming", report: dict | None = None) -> None:
    workspace.save(name, skims, procedure, report)
