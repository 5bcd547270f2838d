"""Trip distribution: proportional fitting and gravity models on sparse origin-destination tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import deterrence
from netloom.operators.graph import reachable_package, spread

#: Seeds of up to so many cells are fitted in one task's arrays (one job for all iterations); larger ones in place, a job an iteration.
CELLS_IN_TASK = 1_000_000


@dataclass
class Fit:
    matrix: DataFrame
    iterations: int
    error: float


def check_vectors(vectors: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """vectors(zone, rows, columns) without nulls; the columns rescaled to the rows' sum, which they must meet within tolerance."""
    s = vectors.agg(F.sum("rows").alias("p"), F.sum("columns").alias("a"), F.count_if(F.expr("rows is null or columns is null or rows < 0 or columns < 0")).alias("bad"), F.count("*").alias("n"), F.count_distinct("zone").alias("d")).first()
    if s.bad or s.n != s.d:
        raise ValueError("vectors need one row a zone and values of zero or more")
    if not s.a or abs(s.p - s.a) > tolerance * max(s.p, s.a):
        raise ValueError(f"vectors are not balanced: {s.p} and {s.a}")
    return vectors.select("zone", "rows", (F.col("columns") * F.lit(s.p / s.a)).alias("columns"))


def fit_arrays(o: np.ndarray, d: np.ndarray, x: np.ndarray, p: np.ndarray, a: np.ndarray, most: int, tolerance: float) -> tuple[np.ndarray, int, float]:
    """Alternate scaling of cells (o, d, x) to row totals p and column totals a; iterations and the last factor's distance from 1."""
    n, error, k = len(p), np.inf, 0

    def factors(goal: np.ndarray, now: np.ndarray) -> np.ndarray:
        return np.divide(goal, now, out=np.ones(n), where=(goal > 0) & (now > 0))

    def off(f: np.ndarray) -> float:
        return float(np.maximum(f, 1 / f).max(initial=1.0))

    for k in range(1, most + 1):
        f = factors(p, np.bincount(o, x, n))
        x = x * f[o]
        h = factors(a, np.bincount(d, x, n))
        x = x * h[d]
        error = max(off(f), off(h)) - 1
        if error < tolerance:
            break
    return x, k, error


def ipf(seed: DataFrame, vectors: DataFrame, max_iterations: int = 5000, tolerance: float = 1e-4) -> Fit:
    """seed(origin, destination, value) fitted to vectors(zone, rows, columns): each iteration scales rows, then columns.

    NaN and null cells are zero; cells of zones whose goal is zero become zero. Cells are checked for size: up to
    CELLS_IN_TASK they are fitted in one task's arrays, more where they lie, with the same result.
    """
    spark = seed.sparkSession
    v = check_vectors(vectors)
    value = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
    cells = seed.select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination"), value.alias("value")).where("value > 0")
    rows, cols = v.select(F.col("zone").alias("origin"), F.col("rows").alias("p")).where("p > 0"), v.select(F.col("zone").alias("destination"), F.col("columns").alias("a")).where("a > 0")
    cells = cells.join(rows.select("origin"), "origin", "left_semi").join(cols.select("destination"), "destination", "left_semi").groupBy("origin", "destination").agg(F.sum("value").alias("value"))
    if cells.limit(CELLS_IN_TASK + 1).count() > CELLS_IN_TASK:
        return ipf_in_place(cells, rows, cols, max_iterations, tolerance)
    goals = v.toPandas()
    zone = goals["zone"].to_numpy(np.int64)
    order = np.argsort(zone)
    p, a, zone = goals["rows"].to_numpy(float)[order], goals["columns"].to_numpy(float)[order], zone[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        pdf = pd.concat(got, ignore_index=True)
        o, d = np.searchsorted(zone, pdf["origin"]), np.searchsorted(zone, pdf["destination"])
        x, k, error = fit_arrays(o, d, pdf["value"].to_numpy(float), p, a, max_iterations, tolerance)
        yield pdf.assign(value=x, iterations=k, error=error)

    out = cells.repartition(1).mapInPandas(run, "origin long, destination long, value double, iterations int, error double").persist()
    info = out.select("iterations", "error").first()
    return Fit(out.select("origin", "destination", "value"), info.iterations if info else 0, info.error if info else 0.0)


def ipf_in_place(cells: DataFrame, rows: DataFrame, cols: DataFrame, most: int, tolerance: float) -> Fit:
    """The same by rounds over cells that stay where they are: an origin's cells lie together, so that a task scales its rows by itself and sends
    the sums of its columns only; the driver holds a factor for each zone."""
    spark = cells.sparkSession
    reachable_package(spark)
    held = spread(cells, "origin").persist()
    p = {int(r[0]): float(r[1]) for r in rows.select("origin", "p").collect()}
    a = {int(r[0]): float(r[1]) for r in cols.select("destination", "a").collect()}
    goals, factor, before, error, k = spark.sparkContext.broadcast(p), dict.fromkeys(a, 1.0), {}, float("inf"), 0

    def scaled(batches: Iterator[pd.DataFrame], c: dict[int, float]) -> tuple[pd.DataFrame, pd.Series] | None:
        got = [b for b in batches if len(b)]
        if not got:
            return None
        pdf = pd.concat(got, ignore_index=True)
        x = pdf["value"] * pdf["destination"].map(c)
        return pdf, x * pdf["origin"].map(goals.value) / x.groupby(pdf["origin"]).transform("sum")

    for k in range(1, most + 1):
        now = spark.sparkContext.broadcast(factor)

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            if found := scaled(batches, now.value):
                pdf, x = found
                by = x.groupby(pdf["destination"]).sum()
                rest = x.groupby(pdf["origin"]).sum() / (pdf["value"] * pdf["destination"].map(now.value)).groupby(pdf["origin"]).sum()
                yield pd.DataFrame({"kind": ["c"] * len(by) + ["r"] * len(rest), "zone": [*by.index, *rest.index], "value": [*by, *rest]})

        told = held.mapInPandas(sums, "kind string, zone long, value double").toPandas()  # zones times tasks at most
        by = told[told["kind"] == "c"].groupby("zone")["value"].sum()
        mine = dict(told[told["kind"] == "r"][["zone", "value"]].itertuples(index=False))
        new = {z: factor[z] * a[z] / by[z] if z in by.index else factor[z] for z in factor}
        off = [mine[z] / before.get(z, 1.0) for z in mine] + [new[z] / factor[z] for z in new]
        last, factor, before = factor, new, mine
        now.unpersist()
        error = max([max(f, 1 / f) for f in off if f > 0], default=1.0) - 1
        if error < tolerance:
            break
    final, rows_at = spark.sparkContext.broadcast(factor), spark.sparkContext.broadcast(last if k else factor)

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if found := scaled(batches, rows_at.value):
            pdf, x = found
            yield pdf.assign(value=x * pdf["destination"].map(final.value) / pdf["destination"].map(rows_at.value))

    return Fit(held.mapInPandas(done, "origin long, destination long, value double"), k, error)


@dataclass
class GravityModel:
    """EXPO has beta, POWER alpha, GAMMA both."""

    function: str
    alpha: float | None = None
    beta: float | None = None

    def __post_init__(self):
        self.function = self.function.upper()
        needs = {"EXPO": (False, True), "POWER": (True, False), "GAMMA": (True, True)}.get(self.function)
        if needs is None:
            raise ValueError(f"no deterrence function {self.function!r}")
        for name, need in zip(("alpha", "beta"), needs, strict=True):
            value = getattr(self, name)
            if need != (value is not None) or need and not isinstance(value, int | float):
                raise ValueError(f"{self.function}: {name} is {'a number' if need else 'not used'}")

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, path: str) -> GravityModel:
        with open(path) as f:
            return cls(**json.load(f))


def gravity_seed(impedance: DataFrame, vectors: DataFrame, model: GravityModel, max_cost: float | None = None) -> DataFrame:
    """(origin, destination, value): production * attraction * deterrence(cost), 0 beyond max_cost, scaled to the productions' sum."""
    v = vectors.select("zone", "rows", "columns")
    joined = impedance.join(v.select(F.col("zone").alias("origin"), "rows"), "origin").join(v.select(F.col("zone").alias("destination"), "columns"), "destination")
    value = F.col("rows") * F.col("columns") * deterrence(model.function, F.col("cost"), model.alpha, model.beta)
    if max_cost is not None:
        value = F.when(F.col("cost") <= max_cost, value).otherwise(0.0)
    raw = joined.select("origin", "destination", value.alias("value"))
    total, goal = raw.agg(F.sum("value")).first()[0], v.agg(F.sum("rows")).first()[0]
    return raw.withColumn("value", F.col("value") * F.lit((goal or 0.0) / total if total else 0.0))


def gravity(impedance: DataFrame, vectors: DataFrame, model: GravityModel, max_cost: float | None = None, max_iterations: int = 5000, tolerance: float = 1e-4) -> Fit:
    """The gravity model's trips from impedance(origin, destination, cost), fitted to the vectors."""
    return ipf(gravity_seed(impedance, check_vectors(vectors), model, max_cost), vectors, max_iterations, tolerance)


def mean_cost(matrix: DataFrame, impedance: DataFrame) -> float:
    both = matrix.join(impedance, ["origin", "destination"]).where("cost < double('inf')")
    s = both.agg(F.sum(F.col("value") * F.col("cost")).alias("c"), F.sum("value").alias("n")).first()
    return s.c / s.n


def calibrate(matrix: DataFrame, impedance: DataFrame, function: str = "EXPO", max_iterations: int = 100, tolerance: float = 1e-4) -> tuple[GravityModel, list[dict]]:
    """EXPO or POWER parameter whose model has the observed mean cost, by Hyman's secant steps; and a report."""
    rows = matrix.groupBy(F.col("origin").alias("zone")).agg(F.sum("value").alias("rows")).join(matrix.groupBy(F.col("destination").alias("zone")).agg(F.sum("value").alias("columns")), "zone", "full").fillna(0.0).persist()
    goal = mean_cost(matrix, impedance)
    make = lambda b: GravityModel(function, beta=b) if function.upper() == "EXPO" else GravityModel(function, alpha=b)
    at = lambda b: mean_cost(gravity(impedance, rows, make(b)).matrix, impedance)
    b0 = 1 / goal
    c0 = at(b0)
    report = [{"iteration": 1, "parameter": b0, "mean_cost": c0}]
    b1 = b0 * c0 / goal
    for k in range(2, max_iterations + 1):
        if abs(c0 - goal) / goal < tolerance:
            break
        c1 = at(b1)
        report.append({"iteration": k, "parameter": b1, "mean_cost": c1})
        following = ((goal - c0) * b1 - (goal - c1) * b0) / (c1 - c0) if c1 != c0 else b1
        b0, c0, b1 = b1, c1, max(following, 1e-12)
    return make(b0), report
