"""Traffic assignment: all-or-nothing loading, select links, equilibrium (MSA, Frank-Wolfe, conjugate and bi-conjugate)."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.vdf import vdf
from netloom.operators import kernels as K
from netloom.operators.graph import arrays, min_plus, reachable_package, spread

ALGORITHMS = {"all-or-nothing": "all-or-nothing", "msa": "msa", "fw": "fw", "frank-wolfe": "fw", "cfw": "cfw", "bfw": "bfw"}


def by_origin(od: DataFrame, cores: list[str]) -> DataFrame:
    """Demand that can be loaded, with an origin's rows together: positive cells off the diagonal."""
    some = " OR ".join(f"`{c}` > 0" for c in cores)
    rows = od.where("origin <> destination").where(some).select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cores])
    return spread(rows, "origin").sortWithinPartitions("origin", "destination")


def _origins(batches: Iterator[pd.DataFrame], cores: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(origin, destinations, demand) from batches sorted by origin, whole origins at a time."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = pdf["origin"].iloc[-1]
        done, rest = pdf[pdf["origin"] != last], pdf[pdf["origin"] == last]
        for o, g in done.groupby("origin", sort=False):
            yield int(o), g["destination"].to_numpy(), g[cores].to_numpy(float)
    if rest is not None and len(rest):
        yield int(rest["origin"].iloc[0]), rest["destination"].to_numpy(), rest[cores].to_numpy(float)


def _batches(g: K.GraphArrays, batches: Iterator[pd.DataFrame], cores: list[str], blocked: bool) -> Iterator[tuple[K.Trees, np.ndarray, np.ndarray, np.ndarray]]:
    """Trees of some origins, with the demand of each that the graph knows: (trees, rows of them, targets, demand)."""
    known = np.sort(g.nodes)
    place = np.argsort(g.nodes, kind="stable")

    def searched(some: list[tuple[int, np.ndarray, np.ndarray]]):
        rows = np.repeat(np.arange(len(some)), [len(t) for _, t, _ in some])
        ids, values = np.concatenate([t for _, t, _ in some]), np.concatenate([v for *_, v in some])
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        there = known[at] == ids
        return K.shortest_trees(g, np.array([g.place[o] for o, *_ in some]), blocked), rows[there], place[at[there]], values[there]

    size = max(1, min(256, K.BATCH_LABELS // max(1, len(g.nodes))))
    waiting = []
    for one in _origins(batches, cores):
        if one[0] in g.place:
            waiting.append(one)
        if len(waiting) == size:
            yield searched(waiting)
            waiting = []
    if waiting:
        yield searched(waiting)


def all_or_nothing(spark: SparkSession, graph: K.GraphArrays, od: DataFrame, cores: list[str], blocked: bool = False, prepared: bool = False, shared: Broadcast | None = None) -> DataFrame:
    """(edge, link_id, direction, *cores): demand on cheapest paths. Each task sums its origins' flows by edge before the shuffle.

    Demand within a zone, and between zones without a path, is not loaded. prepared: od comes from by_origin and isn't shuffled again.
    shared: the graph as it was broadcast before; then only its costs are sent.
    """
    reachable_package(spark)
    costs = spark.sparkContext.broadcast(graph.cost) if shared else None
    shared = shared or spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        if costs is not None:
            g.with_cost(costs.value)
        flows = np.zeros((len(g.tail), len(cores)))
        for trees, rows, targets, values in _batches(g, batches, cores, blocked):
            K.load_trees(g, trees, rows, targets, values, flows)
        used = np.flatnonzero(flows.any(axis=1))
        yield pd.DataFrame({"edge": used, "link_id": g.link_id[used], "direction": g.direction[used]} | {c: flows[used, k] for k, c in enumerate(cores)})

    schema = "edge long, link_id long, direction long" + "".join(f", `{c}` double" for c in cores)
    rows = od.select("origin", "destination", *cores) if prepared else by_origin(od, cores)
    return rows.mapInPandas(run, schema).groupBy("edge", "link_id", "direction").agg(*[F.sum(c).alias(c) for c in cores])


def all_or_nothing_by_joins(edges: DataFrame, od: DataFrame, cores: list[str], cost: str) -> DataFrame:
    """(link_id, direction, *cores) as all_or_nothing() gives, for graphs too large to broadcast: labels by relaxation, and demand that goes back
    along them a link a round, that of one origin at one node as one row."""
    some = " OR ".join(f"`{c}` > 0" for c in cores)
    now = od.where("origin <> destination").where(some).select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("node"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cores])
    labels = min_plus(edges, now.select("origin").distinct(), cost).where("pred_node is not null").select("origin", "node", "pred_node", "link_id", "direction").checkpoint()
    sums, out = [F.sum(c).alias(c) for c in cores], None
    while True:
        step = now.join(labels, ["origin", "node"]).checkpoint()
        if step.isEmpty():
            break
        flows = step.groupBy("link_id", "direction").agg(*sums)
        out = (flows if out is None else out.unionByName(flows).groupBy("link_id", "direction").agg(*sums)).checkpoint()
        now = step.groupBy("origin", F.col("pred_node").alias("node")).agg(*sums)
    return out if out is not None else labels.select("link_id", "direction", *[F.lit(0.0).alias(c) for c in cores]).limit(0)


def link_results(flows: DataFrame, links: DataFrame, cores: list[str]) -> DataFrame:
    """(link_id, *_ab, *_ba, *_tot) of every link, 0 where nothing was loaded."""
    sides = [F.sum(F.when(F.col("direction") == way, F.col(c)).otherwise(0.0)).alias(f"{c}_{side}") for c in cores for way, side in ((1, "ab"), (-1, "ba"))]
    wide = flows.groupBy("link_id").agg(*sides)
    out = links.select("link_id").join(wide, "link_id", "left").fillna(0.0)
    return out.select("link_id", *[x for c in cores for x in (f"{c}_ab", f"{c}_ba", (F.col(f"{c}_ab") + F.col(f"{c}_ba")).alias(f"{c}_tot"))])


def select_link(spark: SparkSession, graph: K.GraphArrays, od: DataFrame, cores: list[str], sets: dict[str, list[tuple[int, int]]], blocked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of each named set of (link_id, direction; 0 for both): (set, origin, destination, *cores) of demand whose path uses any
    of its links, and (set, link_id, direction, *cores) of that demand along its whole path."""
    reachable_package(spark)
    names = sorted(sets)
    members = {n: {(k, d) for k, way in sets[n] for d in ((1, -1) if way == 0 else (way,))} for n in names}
    known = set(zip(graph.link_id.tolist(), graph.direction.tolist(), strict=True))
    for n in names:
        if not members[n] & known:
            raise ValueError(f"no link of set {n} is in the graph")
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        inside = {n: np.array([(k, d) in members[n] for k, d in zip(g.link_id.tolist(), g.direction.tolist(), strict=True)]) for n in names}
        flows = {n: np.zeros((len(g.tail), len(cores))) for n in names}
        g.fields = {n: inside[n].astype(float) for n in names}
        for trees, rows, targets, values in _batches(g, batches, cores, blocked):
            uses = K.path_sums(g, trees, names)
            for k, n in enumerate(names):
                hit = (uses[rows, targets, k] > 0) & np.isfinite(trees.cost[rows, targets]) & (trees.origins[rows] != targets)
                K.load_trees(g, trees, rows[hit], targets[hit], values[hit], flows[n])
                none = pd.array([None] * int(hit.sum()), dtype="Int64")
                yield pd.DataFrame({"set": n, "origin": g.nodes[trees.origins[rows[hit]]], "destination": g.nodes[targets[hit]], "link_id": none, "direction": none} | {c: values[hit, j] for j, c in enumerate(cores)})
        for n in names:
            at = np.flatnonzero(flows[n].any(axis=1))
            none = pd.array([None] * len(at), dtype="Int64")
            yield pd.DataFrame({"set": n, "origin": none, "destination": none, "link_id": g.link_id[at], "direction": g.direction[at]} | {c: flows[n][at, k] for k, c in enumerate(cores)})

    schema = "set string, origin long, destination long, link_id long, direction long" + "".join(f", `{c}` double" for c in cores)
    both = by_origin(od, cores).mapInPandas(run, schema).persist()
    sums = [F.sum(c).alias(c) for c in cores]
    return both.where("link_id is null").groupBy("set", "origin", "destination").agg(*sums), both.where("link_id is not null").groupBy("set", "link_id", "direction").agg(*sums)


@dataclass
class TrafficClass:
    """A user class: its demand column, passenger-car equivalent, value of time and fixed cost (edge field and multiplier)."""

    name: str
    core: str
    pce: float = 1.0
    vot: float = 1.0
    fixed_cost: str | None = None
    multiplier: float = 1.0

    def fixed(self, g: K.GraphArrays) -> np.ndarray:
        if self.fixed_cost is None:
            return np.zeros(len(g.tail))
        cost = np.nan_to_num(g.fields[self.fixed_cost] * self.multiplier / self.vot)
        if cost.min(initial=0) < 0:
            raise ValueError(f"fixed costs of {self.name} must not be negative")
        return cost


@dataclass
class Equilibrium:
    """The result: flows by class (edges, classes) in vehicles, times, and a report of the iterations."""

    graph: K.GraphArrays
    classes: list[TrafficClass]
    flows: np.ndarray
    times: np.ndarray
    free_times: np.ndarray
    capacity: np.ndarray
    preload: np.ndarray
    report: list[dict] = field(default_factory=list)
    converged: bool = False

    def to_df(self, spark: SparkSession) -> DataFrame:
        g, pce = self.graph, sum(c.pce * self.flows[:, k] for k, c in enumerate(self.classes))
        delay = np.divide(self.times, self.free_times, out=np.zeros_like(self.times), where=self.free_times > 0)
        cols = {"link_id": g.link_id, "direction": g.direction} | {c.name: self.flows[:, k] for k, c in enumerate(self.classes)}
        return spark.createDataFrame(pd.DataFrame(cols | {"pce": pce, "preload": self.preload, "time": self.times, "delay": delay, "voc": (pce + self.preload) / self.capacity}))

    def free_df(self, spark: SparkSession) -> DataFrame:
        """(link_id, direction, free_time, capacity) of each edge."""
        return spark.createDataFrame(pd.DataFrame({"link_id": self.graph.link_id, "direction": self.graph.direction, "free_time": self.free_times, "capacity": self.capacity}))

    def report_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.report))


def bounded_minimum(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-4, most: int = 10) -> float:
    """Least f on an interval by parabolic and golden-section steps (Brent's method, bounded)."""
    golden = 0.5 * (3 - math.sqrt(5))
    a, b = low, high
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(most - 1):
        middle, tol = 0.5 * (a + b), 1e-8 * abs(x) + tolerance / 3
        if abs(x - middle) <= 2 * tol - 0.5 * (b - a):
            break
        use_golden = True
        if abs(before) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * before) and q * (a - x) < p < q * (b - x):
                before, step, use_golden = step, p / q, False
                if min(x + step - a, b - x - step) < 2 * tol:
                    step = math.copysign(tol, middle - x)
        if use_golden:
            before = (a if x >= middle else b) - x
            step = golden * before
        u = x + (step if abs(step) >= tol else math.copysign(tol, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def root(f: Callable[[float], float], low: float, high: float, tolerance: float) -> float | None:
    """A zero of f on an interval by bisection; None without a change of sign."""
    at_low, at_high = f(low), f(high)
    if at_low * at_high > 0:
        return None
    while high - low > tolerance:
        middle = 0.5 * (low + high)
        value = f(middle)
        if value == 0:
            return middle
        low, high, at_low = (middle, high, value) if value * at_low > 0 else (low, middle, at_low)
    return 0.5 * (low + high)


def assign(
    spark: SparkSession, edges: DataFrame, zones: DataFrame, od: DataFrame, classes: list[TrafficClass], algorithm: str = "bfw", function: str = "bpr", parameters: tuple = (0.15, 4.0),
    time_field: str = "free_flow_time", capacity_field: str = "capacity", max_iterations: int = 250, gap: float = 1e-4, steps_below: int = 1, preload: DataFrame | None = None, blocked: bool = False, fields: tuple[str, ...] = (),
) -> Equilibrium:
    """User equilibrium. The demand stays distributed; each iteration runs one job that loads all origins and returns link flows,
    and the driver holds vectors by edge only. Parameters of the function are numbers or names of edge fields."""
    if (how := ALGORITHMS.get(algorithm.lower())) is None:
        raise ValueError(f"no algorithm {algorithm!r}; there are {', '.join(ALGORITHMS)}")
    curve = vdf(function)
    curve.check(*parameters)
    wanted = tuple(dict.fromkeys([capacity_field, *fields, *[c.fixed_cost for c in classes if c.fixed_cost], *[p for p in parameters if isinstance(p, str)]]))
    g = arrays(edges, zones, time_field, wanted)
    t0, capacity = g.cost.copy(), g.fields[capacity_field]
    if not np.isfinite(capacity).all() or capacity.min() <= 0:
        raise ValueError(f"{capacity_field} must be positive")
    p = [g.fields[x] if isinstance(x, str) else x for x in parameters]
    pce, fixed = np.array([c.pce for c in classes]), np.stack([c.fixed(g) for c in classes], axis=1)
    base = preload_of(g, preload)
    time_at = lambda flow: curve.values(flow + base, capacity, t0, *p)
    rows = by_origin(od, [c.core for c in classes]).persist()
    reachable_package(spark)
    shared = spark.sparkContext.broadcast(g)
    same_cost = not fixed.any()

    def load(times: np.ndarray) -> np.ndarray:
        y = np.zeros((len(t0), len(classes)))
        for some in [list(range(len(classes)))] if same_cost else [[k] for k in range(len(classes))]:
            g.with_cost(times + fixed[:, some[0]])
            names = [classes[k].core for k in some]
            found = all_or_nothing(spark, g, rows, names, blocked, prepared=True, shared=shared).toPandas()
            for k, n in zip(some, names, strict=True):
                y[found["edge"].to_numpy(np.int64), k] = found[n].to_numpy()
        return y * pce

    x = s = before = None
    times, alpha, below, out, last_kind = time_at(np.zeros(len(t0))), 1.0, 0, [], "fw"
    began, done = time.time(), False
    for k in range(1, max_iterations + 1):
        y = load(times)
        beta, kind, note = (1.0, 0.0, 0.0), "fw", ""
        if x is None:
            x, s = y.copy(), y
        else:
            total, slope = x.sum(axis=1), curve.slopes(x.sum(axis=1) + base, capacity, t0, *p)
            if how in ("cfw", "bfw") and k > 2 and last_kind != "reset":
                conjugate = how == "cfw" or k == 3 or last_kind == "fw" or before is None
                if conjugate:
                    a, b = (s - x).sum(axis=1), (y - x).sum(axis=1)
                    low = (slope * a * (y - s).sum(axis=1)).sum()
                    lam = min(max((slope * a * b).sum() / low, 0.0), 0.99999) if low else 0.0
                    new, kind, beta = lam * s + (1 - lam) * y, "cfw", (1 - lam, lam, 0.0)
                else:
                    X, Y, Z, Wd = (m.sum(axis=1) for m in (alpha * s + (1 - alpha) * before - x, y - x, s - x, before - s))
                    xw, zz = (slope * X * Wd).sum(), (slope * Z * Z).sum()
                    mu = max(0.0, -(slope * X * Y).sum() / xw) if xw else 0.0
                    nu = max(0.0, -(slope * Z * Y).sum() / zz + (mu * alpha / (1 - alpha) if alpha < 1 else 0.0)) if zz else 0.0
                    b0 = 1 / (1 + nu + mu)
                    new, kind, beta = b0 * (y + nu * s + mu * before), "bfw", (b0, nu * b0, mu * b0)
            else:
                new = y
            before, s = s, new
            d = (s - x).sum(axis=1)
            constant = float((fixed * (s - x)).sum())
            last_gap = out[-1]["rgap"] if out else 1.0
            if how in ("msa", "all-or-nothing"):
                alpha = 1 / k
            elif kind == "fw":
                slope_at = lambda a: float((time_at(total + a * d) * d).sum()) + constant  # noqa: B023, E731
                found = root(slope_at, 0.0, 1.0, max(min(1e-6, last_gap * 1e-5), 1e-12))
                alpha = found if found is not None else 1.0 if slope_at(0.0) < 0 else 0.01 / k
            else:
                high = min(1.0, 1 / math.sqrt(k))
                objective = lambda a: 0.5 * a * float(((times + time_at(total + a * d)) * d).sum()) + a * constant  # noqa: B023, E731
                alpha = bounded_minimum(objective, 0.0, high)
                if objective(high) < objective(alpha):
                    alpha = high
                if objective(alpha) >= 0:
                    alpha, kind, note = 0.0, "reset", "no better point on the direction"
            x = x + alpha * (s - x)
        last_kind = kind
        if how == "all-or-nothing":
            out.append({"iteration": k, "rgap": math.inf, "alpha": 1.0, "beta0": 1.0, "beta1": 0.0, "beta2": 0.0, "warning": "", "seconds": time.time() - began})
            done = True
            break
        at_x, at_y = (float(((times[:, None] + fixed) * m).sum()) for m in (x, y))
        rgap = abs(at_x - at_y) / at_x if at_x else (0.0 if not at_y else math.inf)
        times = time_at(x.sum(axis=1))
        out.append({"iteration": k, "rgap": rgap, "alpha": float(alpha), "beta0": beta[0], "beta1": beta[1], "beta2": beta[2], "warning": note, "seconds": time.time() - began})
        below = below + 1 if rgap <= gap else 0
        if k > 1 and below >= steps_below:
            done = True
            break
    rows.unpersist()
    shared.unpersist()
    if x is None:
        x = np.zeros((len(t0), len(classes)))
    return Equilibrium(g.with_cost(times), classes, x / pce, times, t0, capacity, base, out, done)


def merged_preload(edges: DataFrame, preload: DataFrame) -> DataFrame:
    """(link_id, direction, preload) of each edge: what preload(link_id, direction, preload) says, 0 without a row. Repeated rows and missing
    columns are an error; rows of edges that aren't there are left out."""
    if missing := {"link_id", "direction", "preload"} - set(preload.columns):
        raise ValueError(f"a preload lacks {', '.join(sorted(missing))}")
    if not preload.groupBy("link_id", "direction").count().where("count > 1").isEmpty():
        raise ValueError("a preload has one row for each link and direction")
    given = preload.select("link_id", "direction", F.nanvl(F.col("preload").cast("double"), F.lit(0.0)).alias("preload"))
    return edges.select("link_id", "direction").join(given, ["link_id", "direction"], "left").fillna(0.0, ["preload"])


def preload_of(g: K.GraphArrays, preload: DataFrame | None) -> np.ndarray:
    """A preload by edge of the graph (which the driver holds in any case)."""
    if preload is None:
        return np.zeros(len(g.tail))
    edges = preload.sparkSession.createDataFrame(pd.DataFrame({"link_id": g.link_id, "direction": g.direction, "edge": np.arange(len(g.tail))}))
    rows = merged_preload(edges, preload).join(edges, ["link_id", "direction"]).select("edge", "preload").toPandas()
    return rows.sort_values("edge")["preload"].to_numpy(float)


def relative_gap(edges: DataFrame) -> DataFrame:
    """(rgap) of edges(time, flow, best): |sum of time * flow - sum of time * best| over the first, best being the flow on cheapest paths."""
    now, best = F.sum(F.col("time") * F.col("flow")), F.sum(F.col("time") * F.col("best"))
    return edges.agg((F.abs(now - best) / now).alias("rgap"))


def congested_skims(spark: SparkSession, found: Equilibrium, zones: DataFrame, names: list[str] | None = None, which: int = 0) -> DataFrame:
    """(origin, destination, cost, congested_time, *names) at the equilibrium's times: cost is the class's generalised cost."""
    from netloom.operators.graph import skims

    g = found.graph
    g.fields = g.fields | {"congested_time": found.times}
    g.with_cost(found.times + found.classes[which].fixed(g))
    return skims(spark, g, zones, ["congested_time", *(names or [])])


def class_info(od: DataFrame, classes: list[TrafficClass]) -> DataFrame:
    """(class, pce, vot, total) of each class."""
    one = od.agg(*[F.sum(F.nanvl(F.col(c.core).cast("double"), F.lit(0.0))).alias(f"c{k}") for k, c in enumerate(classes)])
    rows = [F.struct(F.lit(c.name).alias("class"), F.lit(float(c.pce)).alias("pce"), F.lit(float(c.vot)).alias("vot"), F.col(f"c{k}").alias("total")) for k, c in enumerate(classes)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_field(links: DataFrame, field: str, zeros: bool = False) -> None:
    """Raises unless a field is there, without nulls or NaN, and positive (or zero, if that is allowed)."""
    if field not in links.columns:
        raise ValueError(f"no field {field}")
    c = F.col(field).cast("double")
    s = links.agg(F.count_if(c.isNull() | F.isnan(c)).alias("bad"), F.min(c).alias("least")).first()
    if s.bad:
        raise ValueError(f"{field} has {s.bad} empty values")
    if s.least is not None and (s.least < 0 or s.least == 0 and not zeros):
        raise ValueError(f"{field} must be {'zero or more' if zeros else 'positive'}")


def delaunay_assignment(spark: SparkSession, zones: DataFrame, od: DataFrame, core: str) -> DataFrame:
    """(a_node, b_node, distance, flow): demand between zones(zone, x, y) on their Delaunay edges, by distance."""
    from netloom.functions.delaunay import delaunay_edges
    from netloom.operators.graph import directed

    z = zones.select("zone", "x", "y").orderBy("zone").collect()
    links = [(k + 1, z[i].zone, z[j].zone, 0, math.hypot(z[i].x - z[j].x, z[i].y - z[j].y)) for k, (i, j) in enumerate(delaunay_edges([(r.x, r.y) for r in z]))]
    df = spark.createDataFrame(links, "link_id long, a_node long, b_node long, direction int, distance double")
    flows = all_or_nothing(spark, arrays(directed(df), zones.select("zone"), "distance"), od, [core])
    return df.join(link_results(flows, df, [core]), "link_id").select("a_node", "b_node", "distance", F.col(f"{core}_tot").alias("flow"))
