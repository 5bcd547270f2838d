"""Transit patterns on the road network: matching by stops and shapes, synthesis without shapes, cleaning of paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from netloom.functions import geometry as Y
from netloom.operators import kernels as K
from netloom.operators.graph import reachable_package
from netloom.operators.graph import spread as spread_rows

#: Fixed values, in metres: a link along the shape costs DISCOUNT of its length; how near a stop's link must be, of the route's mode and
#: of any; how much longer a preferred path may be.
SHAPE_NEAR, DISCOUNT, STOP_MODAL, STOP_ANY, PREFERRED = 20.0, 0.1, 25.0, 100.0, 2.0
REASONS = ("unmatched-stop", "no-path", "too-few-stops")


@dataclass
class Roads:
    """Links as lines with their directed graph; `modes` and `priority` by link."""

    graph: K.GraphArrays
    lines: dict[int, Y.Line]
    ends: dict[int, tuple[int, int]]
    two_way: dict[int, int]
    modes: dict[int, str]
    priority: frozenset[int]

    def near(self, p: Y.Point, mode: str) -> list[tuple[float, int, float]]:
        """(distance, link, place along) of links near a stop: those of the mode within STOP_MODAL, else any within STOP_ANY; nearest first."""
        found = []
        for k, line in self.lines.items():
            place, gap = Y.locate(line, p)
            if gap <= STOP_ANY:
                found.append((gap, k, place))
        found.sort()
        modal = [f for f in found if f[0] <= STOP_MODAL and (not mode or mode in self.modes[f[1]])]
        return (modal or found)[:3]

    def costs(self, shape: Y.Line | None, preferred: bool = False) -> list[float]:
        """Edge lengths, less along a shape; only priority links if those are preferred."""
        out = self.graph.cost.copy()
        if shape:
            along = {k for k, line in self.lines.items() if all(Y.locate(shape, Y.point_at(line, f * Y.length(line)))[1] <= SHAPE_NEAR for f in (0.1, 0.5, 0.9))}
            out[[k in along for k in self.graph.link_id.tolist()]] *= DISCOUNT
        if preferred:
            out[[k not in self.priority for k in self.graph.link_id.tolist()]] = math.inf
        return out.tolist()


def collect_roads(spark: SparkSession, links: DataFrame) -> Roads:
    """links(link_id, a_node, b_node, direction, points array<struct<x, y>>[, modes, priority]), small enough to broadcast."""
    rows = links.collect()
    lines = {r.link_id: [(p.x, p.y) for p in r.points] for r in rows}
    edges = [(r.a_node, r.b_node, r.link_id, 1) for r in rows if r.direction != -1] + [(r.b_node, r.a_node, r.link_id, -1) for r in rows if r.direction != 1]
    nodes = np.array(sorted({n for e in edges for n in e[:2]}))
    at = {int(n): k for k, n in enumerate(nodes)}
    cost = np.array([Y.length(lines[e[2]]) for e in edges])
    graph = K.GraphArrays(nodes, np.array([at[e[0]] for e in edges]), np.array([at[e[1]] for e in edges]), cost, np.array([e[2] for e in edges]), np.array([e[3] for e in edges]))
    has = set(links.columns)
    return Roads(graph, lines, {r.link_id: (r.a_node, r.b_node) for r in rows}, {r.link_id: r.direction for r in rows}, {r.link_id: r.modes if "modes" in has else "" for r in rows}, frozenset(r.link_id for r in rows if "priority" in has and r.priority))


def between(roads: Roads, a: list[tuple], b: list[tuple], costs: list[float]) -> tuple[float, list[tuple[int, int]]] | None:
    """The best (cost, signed links) from one stop's candidates to the next's: along a shared link, or out of one, over the network and into the other."""
    best = None
    trees: dict[int, K.Tree] = {}
    g = roads.graph
    share = {int(k): c / full if full else 1.0 for k, c, full in zip(g.link_id, costs, g.cost.tolist(), strict=True)}
    for gap1, k1, p1 in a:
        n1 = Y.length(roads.lines[k1])
        f1 = share[k1]
        out = [(roads.ends[k1][1], (n1 - p1) * f1, 1)] * (roads.two_way[k1] != -1) + [(roads.ends[k1][0], p1 * f1, -1)] * (roads.two_way[k1] != 1)
        for gap2, k2, p2 in b:
            if k1 == k2 and (way := 1 if p2 >= p1 else -1) and roads.two_way[k1] != -way:
                option = (abs(p2 - p1) * f1 + gap1 + gap2, [(k1, way)])
                if best is None or option < best:
                    best = option
                continue
            n2, f2 = Y.length(roads.lines[k2]), share[k2]
            into = [(roads.ends[k2][0], p2 * f2, 1)] * (roads.two_way[k2] != -1) + [(roads.ends[k2][1], (n2 - p2) * f2, -1)] * (roads.two_way[k2] != 1)
            for start, c1, w1 in out:
                if start not in trees:
                    trees[start] = K.shortest_tree(g, g.place[start], costs=costs)
                for end, c2, w2 in into:
                    over = float(trees[start].cost[g.place[end]])
                    if c1 + over + c2 < math.inf:
                        path = [(int(g.link_id[k]), int(g.direction[k])) for k in K.path_edges(g, trees[start], g.place[end])]
                        option = (c1 + over + c2 + gap1 + gap2, [(k1, w1), *path, (k2, w2)])
                        if best is None or option[0] < best[0]:
                            best = option
    return best


def clean_path(steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A path without repeats and without going along a link and straight back."""
    out: list[tuple[int, int]] = []
    for link, way in steps:
        if out and out[-1][0] == link:
            if out[-1][1] == -way:
                out.pop()
            continue
        out.append((link, way))
    return out


def match_pattern(roads: Roads, stops: list[Y.Point], shape: Y.Line | None = None, mode: str = "") -> tuple[list[tuple[int, int]], str, int]:
    """(signed links, reason, number of the stop it fails at): reason is empty if the pattern is matched.

    With a shape, links along it are cheap. Without one, a path over priority links is taken if it isn't over PREFERRED times as
    long as the shortest.
    """
    if len(stops) < 2:
        return [], "too-few-stops", 0
    near = [roads.near(p, mode) for p in stops]
    for k, found in enumerate(near):
        if not found:
            return [], "unmatched-stop", k
    costs = roads.costs(shape)
    preferred = roads.costs(None, True) if shape is None and roads.priority else None
    steps: list[tuple[int, int]] = []
    for k, (a, b) in enumerate(zip(near, near[1:], strict=False)):
        found = between(roads, a, b, costs)
        if preferred is not None and found is not None:
            other = between(roads, a, b, preferred)
            found = other if other is not None and other[0] <= PREFERRED * found[0] else found
        if found is None:
            return [], "no-path", k + 1
        steps += found[1]
    return clean_path(steps), "", -1


def match_patterns(spark: SparkSession, links: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, accepted, reason, failed_at, links array<long>, length) of patterns(pattern, stops array<struct<x, y>>, shape the same or
    null, mode). Patterns with equal stops, shape and mode are worked on once."""
    reachable_package(spark)
    shared = spark.sparkContext.broadcast(collect_roads(spark, links))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roads = shared.value
        for pdf in batches:
            out = []
            for key, stops, shape, mode in zip(pdf["key"], pdf["stops"], pdf["shape"], pdf["mode"], strict=True):
                line = [(p["x"], p["y"]) for p in shape] if shape is not None and len(shape) > 1 else None
                steps, reason, at = match_pattern(roads, [(p["x"], p["y"]) for p in stops], line, mode or "")
                out.append((key, not reason, reason, at, [k * w for k, w in steps], sum(Y.length(roads.lines[k]) for k, _ in steps)))
            yield pd.DataFrame(out, columns=["key", "accepted", "reason", "failed_at", "links", "length"])

    keyed = patterns.selectExpr("pattern", "stops", "shape", "mode", "xxhash64(stops, shape, mode) key")
    once = spread_rows(keyed.dropDuplicates(["key"]), "key").mapInPandas(run, "key long, accepted boolean, reason string, failed_at int, links array<long>, length double")
    return keyed.select("pattern", "key").join(once, "key").drop("key")


def summary(matched: DataFrame) -> DataFrame:
    """(accepted, reason, n) with a total."""
    return matched.rollup("accepted", "reason").count().withColumnRenamed("count", "n")


def spread(zones: DataFrame, candidates: DataFrame, spacing: tuple[float, ...] = (150.0, 100.0)) -> DataFrame:
    """(zone, node) chosen greedily from candidates(zone, node, x, y, distance) up to zones(zone, target): the nearest first, each a spacing
    away from those before; a smaller spacing if too few are found."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "node"])
        target, chosen = int(pdf["target"].iloc[0]), []
        for gap in spacing:
            for r in pdf.itertuples():
                if len(chosen) < target and all(r.node != c.node and math.dist((r.x, r.y), (c.x, c.y)) >= gap for c in chosen):
                    chosen.append(r)
        return pd.DataFrame({"zone": [c.zone for c in chosen], "node": [c.node for c in chosen]}, dtype="int64")

    reachable_package(zones.sparkSession)
    return candidates.join(zones.select("zone", "target"), "zone").groupBy("zone").applyInPandas(pick, "zone long, node long")
