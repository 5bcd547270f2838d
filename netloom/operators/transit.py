"""Transit graphs and optimal-strategy assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import kernels as K
from netloom.operators.graph import numbered, reachable_package, spread

INFINITE = float("inf")
#: Fixed values, in seconds: dwell at a stop's platform, penalty of alighting and transfers, stop time between segments; metres a second on foot.
PLATFORM, TRANSFER, DWELL, LEAST, WALK = 15.0, 480.0, 30.0, 1e-6, 1.0


def vertices(segments: DataFrame, stops: DataFrame, zones: DataFrame) -> DataFrame:
    """(node, kind, stop, line, seq, zone): origins and destinations of zones, stops, and a boarding and an alighting vertex for
    each of segments(line, seq, from_stop, to_stop). Origins keep their zone's id, the others follow."""
    none = F.lit(None)
    parts = [
        zones.select(F.lit("origin").alias("kind"), none.cast("long").alias("stop"), none.cast("string").alias("line"), none.cast("int").alias("seq"), F.col("zone")),
        zones.select(F.lit("destination"), none.cast("long"), none.cast("string"), none.cast("int"), "zone"),
        stops.select(F.lit("stop"), "stop", none.cast("string"), none.cast("int"), none.cast("long")),
        segments.select(F.lit("boarding"), "from_stop", "line", "seq", none.cast("long")),
        segments.select(F.lit("alighting"), "to_stop", "line", "seq", none.cast("long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    top = zones.agg(F.max("zone")).first()[0] or 0
    others = numbered(out.where("kind <> 'origin'"), ["kind", "zone", "stop", "line", "seq"], "node", top + 1)
    return others.unionByName(out.where("kind = 'origin'").withColumn("node", F.col("zone"))).select("node", "kind", "stop", "line", "seq", "zone")


def on_board(segments: DataFrame, v: DataFrame) -> DataFrame:
    b, a = v.where("kind = 'boarding'").select("line", "seq", F.col("node").alias("tail")), v.where("kind = 'alighting'").select("line", "seq", F.col("node").alias("head"))
    return segments.join(b, ["line", "seq"]).join(a, ["line", "seq"]).select("tail", "head", F.lit("on-board").alias("kind"), "line", F.col("travel_time").alias("time"), F.lit(INFINITE).alias("freq"))


def boarding(v: DataFrame, headway: DataFrame, wait_factor: float = 1.0) -> DataFrame:
    """Stop to boarding vertex: frequency 1 / headway / wait_factor."""
    s, b = v.where("kind = 'stop'").select("stop", F.col("node").alias("tail")), v.where("kind = 'boarding'").select("stop", "line", F.col("node").alias("head"))
    return b.join(s, "stop").join(headway, "line").select("tail", "head", F.lit("boarding").alias("kind"), "line", F.lit(PLATFORM + LEAST).alias("time"), (1 / F.col("headway") / wait_factor).alias("freq"))


def alighting(v: DataFrame) -> DataFrame:
    s, a = v.where("kind = 'stop'").select("stop", F.col("node").alias("head")), v.where("kind = 'alighting'").select("stop", "line", F.col("node").alias("tail"))
    return a.join(s, "stop").select("tail", "head", F.lit("alighting").alias("kind"), "line", F.lit(PLATFORM + TRANSFER + LEAST).alias("time"), F.lit(INFINITE).alias("freq"))


def dwell(v: DataFrame) -> DataFrame:
    """Alighting vertex of a segment to the boarding vertex of the next."""
    a, b = v.where("kind = 'alighting'").select("line", (F.col("seq") + 1).alias("seq"), F.col("node").alias("tail")), v.where("kind = 'boarding'").select("line", "seq", F.col("node").alias("head"))
    return a.join(b, ["line", "seq"]).select("tail", "head", F.lit("dwell").alias("kind"), "line", F.lit(DWELL).alias("time"), F.lit(INFINITE).alias("freq"))


def inner_transfers(v: DataFrame, headway: DataFrame, wait_factor: float = 1.0) -> DataFrame:
    """Alighting to boarding vertex of another line at the same stop."""
    a, b = v.where("kind = 'alighting'").select("stop", F.col("line").alias("from_line"), F.col("node").alias("tail")), v.where("kind = 'boarding'").select("stop", "line", F.col("node").alias("head"))
    return a.join(b, "stop").where("from_line <> line").join(headway, "line").select("tail", "head", F.lit("inner_transfer").alias("kind"), "line", F.lit(DWELL + TRANSFER).alias("time"), (1 / F.col("headway") / wait_factor).alias("freq"))


def outer_transfers(v: DataFrame, stops: DataFrame, headway: DataFrame, wait_factor: float = 1.0) -> DataFrame:
    """Alighting to boarding vertex of another line at another stop of the same station, on foot."""
    place = stops.select("stop", "station", "x", "y")
    a = v.where("kind = 'alighting'").select("stop", F.col("line").alias("from_line"), F.col("node").alias("tail")).join(place, "stop").select("station", F.col("stop").alias("s1"), "from_line", "tail", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = v.where("kind = 'boarding'").select("stop", "line", F.col("node").alias("head")).join(place, "stop").select("station", F.col("stop").alias("s2"), "line", "head", F.col("x").alias("x2"), F.col("y").alias("y2"))
    time = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) / WALK + TRANSFER
    return a.join(b, "station").where("s1 <> s2 and from_line <> line").join(headway, "line").select("tail", "head", F.lit("outer_transfer").alias("kind"), "line", time.alias("time"), (1 / F.col("headway") / wait_factor).alias("freq")).dropDuplicates(["tail", "head"])


def walking(v: DataFrame, stops: DataFrame) -> DataFrame:
    s = v.where("kind = 'stop'").select("stop", "node").join(stops.select("stop", "station", "x", "y"), "stop")
    a, b = s.select("station", F.col("stop").alias("s1"), F.col("node").alias("tail"), F.col("x").alias("x1"), F.col("y").alias("y1")), s.select("station", F.col("stop").alias("s2"), F.col("node").alias("head"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    time = F.greatest(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) / WALK, F.lit(LEAST))
    return a.join(b, "station").where("s1 <> s2").select("tail", "head", F.lit("walking").alias("kind"), F.lit(None).cast("string").alias("line"), time.alias("time"), F.lit(INFINITE).alias("freq"))


def connectors(v: DataFrame, nearest: DataFrame, factor: float = 1.0) -> DataFrame:
    """Access and egress edges of nearest(stop, zone, distance)."""
    s = v.where("kind = 'stop'").select("stop", "node")
    o, d = v.where("kind = 'origin'").select("zone", F.col("node").alias("z")), v.where("kind = 'destination'").select("zone", F.col("node").alias("z"))
    time = (F.col("distance") / WALK * factor).alias("time")
    none = F.lit(None).cast("string").alias("line")
    access = nearest.join(s, "stop").join(o, "zone").select(F.col("z").alias("tail"), F.col("node").alias("head"), F.lit("access_connector").alias("kind"), none, time, F.lit(INFINITE).alias("freq"))
    egress = nearest.join(s, "stop").join(d, "zone").select(F.col("node").alias("tail"), F.col("z").alias("head"), F.lit("egress_connector").alias("kind"), none, time, F.lit(INFINITE).alias("freq"))
    return access.union(egress)


def transit_edges(segments: DataFrame, stops: DataFrame, zones: DataFrame, headway: DataFrame, nearest: DataFrame, inner: bool = True, outer: bool = True, walk: bool = True, wait_factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The vertices and the edges (edge, tail, head, kind, line, time, freq) of a period's transit graph."""
    v = vertices(segments, stops, zones).persist()
    parts = [on_board(segments, v), boarding(v, headway, wait_factor), alighting(v), dwell(v), connectors(v, nearest)]
    parts += [inner_transfers(v, headway, wait_factor)] * inner + [outer_transfers(v, stops, headway, wait_factor)] * outer + [walking(v, stops)] * walk
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return v, numbered(out, ["kind", "tail", "head", "line"], "edge", 1)


#: Skims: which edges count (an edge counts 1), or add their time.
COUNTED = {"boardings": ("boarding",), "alightings": ("alighting",), "inner_transfers": ("inner_transfer",), "outer_transfers": ("outer_transfer",), "transfers": ("inner_transfer", "outer_transfer")}
TIMED = {"on_board_time": ("on-board",), "dwelling_time": ("dwell",), "egress_time": ("egress_connector",), "access_time": ("access_connector",), "walking_time": ("walking", "access_connector", "egress_connector"), "transfer_time": ("inner_transfer", "outer_transfer"), "in_vehicle_time": ("on-board", "dwell")}


def skim_columns(edges: DataFrame, names: list[str]) -> DataFrame:
    out = edges
    for n in names:
        if n in COUNTED:
            out = out.withColumn(n, F.col("kind").isin(*COUNTED[n]).cast("double"))
        elif n in TIMED:
            out = out.withColumn(n, F.when(F.col("kind").isin(*TIMED[n]), F.col("time")).otherwise(0.0))
        elif n not in edges.columns:
            raise ValueError(f"no skim {n!r}")
    return out


def optimal_strategies(spark: SparkSession, edges: DataFrame, demand: DataFrame, core: str = "trips", skims: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edge, volume) and (origin, destination, time, *skims) of demand(origin, destination, core) between nodes of edges(edge, tail,
    head, time, freq, kind). A task works on whole destinations and sums its volumes by edge. Unreachable: no volume, skims of 0."""
    reachable_package(spark)
    names = skims or []
    pdf = skim_columns(edges, names).select("edge", "tail", "head", F.col("time").cast("double").alias("time"), F.col("freq").cast("double").alias("freq"), *[F.col(n).cast("double").alias(n) for n in names]).orderBy("edge").toPandas()
    nodes = np.unique(np.concatenate([pdf["tail"], pdf["head"]]).astype(np.int64))
    pack = tuple(np.searchsorted(nodes, pdf[c].to_numpy(np.int64)) for c in ("tail", "head")) + (pdf["time"].to_numpy(), pdf["freq"].to_numpy(), pdf[names].to_numpy(float), pdf["edge"].to_numpy(np.int64), nodes)
    shared = spark.sparkContext.broadcast(pack)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, head, time, freq, values, ids, known = shared.value
        place = {int(n): k for k, n in enumerate(known)}
        flows = np.zeros(len(tail))
        rest = None

        def work(d: int, g: pd.DataFrame) -> pd.DataFrame:
            o = g["origin"].to_numpy()
            out = pd.DataFrame({"edge": pd.array([None] * len(o), dtype="Int64"), "origin": o, "destination": d, "value": 0.0} | {n: 0.0 for n in names})
            if d not in place:
                return out
            u, f, chosen, key, mean = K.hyperpath(tail, head, time, freq, len(known), place[d], values if names else None)
            volume = np.zeros(len(known))
            at = np.array([place.get(int(x), -1) for x in o])
            good = (at >= 0) & np.isfinite(u[np.maximum(at, 0)])
            np.add.at(volume, at[good], g["trips"].to_numpy(float)[good])
            volume[place[d]] = 0.0
            K.assign_strategy(tail, head, freq, f, chosen, key, volume, flows)
            out.loc[good, "value"] = u[at[good]]
            for k, n in enumerate(names):
                out.loc[good, n] = mean[at[good], k]
            return out

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf["destination"].iloc[-1]
            for d, g in pdf[pdf["destination"] != last].groupby("destination", sort=False):
                yield work(int(d), g)
            rest = pdf[pdf["destination"] == last]
        if rest is not None and len(rest):
            yield work(int(rest["destination"].iloc[0]), rest)
        used = np.flatnonzero(flows)
        none = pd.array([None] * len(used), dtype="Int64")
        yield pd.DataFrame({"edge": pd.array(ids[used], dtype="Int64"), "origin": none, "destination": none, "value": flows[used]} | {n: 0.0 for n in names})

    rows = demand.where(F.col(core) > 0 if not names else F.lit(True)).select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination"), F.col(core).cast("double").alias("trips"))
    schema = "edge long, origin long, destination long, value double" + "".join(f", `{n}` double" for n in names)
    both = spread(rows, "destination").sortWithinPartitions("destination").mapInPandas(run, schema).persist()
    return both.where("edge is not null").groupBy("edge").agg(F.sum("value").alias("volume")), both.where("edge is null").select("origin", "destination", F.col("value").alias("time"), *names)


def waiting_time(skims: DataFrame) -> DataFrame:
    return skims.withColumn("waiting_time", F.col("time") - F.col("in_vehicle_time") - F.col("egress_time") - F.col("access_time"))
