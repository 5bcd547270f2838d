"""Route choice: route sets per pair, path-size logit, link loading, select links, sub-areas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.scalars import inverse_binary_logit
from netloom.operators import kernels as K
from netloom.operators.graph import reachable_package, spread

PARAMETERS = {"max_routes", "max_depth", "max_misses", "penalty", "seed"}
PAIR = ["origin", "destination"]


def route_sets(spark: SparkSession, graph: K.GraphArrays, pairs: DataFrame, method: str = "bfsle", blocked: bool = False, **parameters) -> DataFrame:
    """(origin, destination, route array<long>, cost) of pairs(origin, destination): signed links, the sign the direction."""
    if unknown := set(parameters) - PARAMETERS:
        raise ValueError(f"unknown parameters {', '.join(sorted(unknown))}")
    if method == "bfsle" and not (parameters.get("max_routes") or parameters.get("max_depth")):
        raise ValueError("bfsle needs max_routes or max_depth")
    if method != "bfsle":
        parameters.setdefault("penalty", 1.01)
    reachable_package(spark)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            rows = []
            for o, d in zip(pdf["origin"].tolist(), pdf["destination"].tolist(), strict=True):
                if o != d and o in g.place and d in g.place:
                    for r in K.route_set(g, g.place[o], g.place[d], method, blocked=blocked, **parameters):
                        rows.append((o, d, (g.link_id[r] * g.direction[r]).tolist(), float(g.cost[r].sum())))
            yield pd.DataFrame(rows, columns=["origin", "destination", "route", "cost"])

    keyed = spread(pairs.select(*[F.col(c).cast("long").alias(c) for c in PAIR]).distinct(), *PAIR)
    return keyed.mapInPandas(run, "origin long, destination long, route array<long>, cost double")


def expand_routes(routes: DataFrame, chains: DataFrame) -> DataFrame:
    """Routes over contracted links to routes over network links: chains(chain, direction, links array<long>)."""
    steps = routes.withColumn("rid", F.xxhash64("origin", "destination", "route")).select("*", F.posexplode("route").alias("p", "c"))
    full = steps.withColumn("chain", F.abs("c")).withColumn("direction", F.signum("c").cast("int")).join(chains, ["chain", "direction"])
    return full.groupBy("origin", "destination", "rid", "cost").agg(F.array_sort(F.collect_list(F.struct("p", "links"))).alias("x")).select("origin", "destination", F.flatten(F.transform("x", lambda s: s["links"])).alias("route"), "cost")


def without_repeats(route: Column) -> Column:
    """A route with runs of one link as one."""
    return F.aggregate(route, F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == x), acc).otherwise(F.concat(acc, F.array(x))))


def path_size_logit(routes: DataFrame, costs: DataFrame, beta: float = 1.0, cutoff: float = 0.0) -> DataFrame:
    """Adds route_id, cost, mask, path_overlap and probability to routes(origin, destination, route); costs(link, cost) by signed link.

    A route is kept (mask) if its cost is within the cutoff of the pair's least; a pair with a route of cost zero keeps none.
    Overlap: the sum over links of their share of the route's cost over the number of kept routes that use them.
    """
    keyed = routes.select(*PAIR, "route").withColumn("route_id", F.xxhash64("origin", "destination", "route"))
    steps = keyed.select("*", F.explode("route").alias("link")).join(costs.select("link", F.col("cost").alias("__t")), "link").repartition(*PAIR)
    pair, route = W.partitionBy(*PAIR), W.partitionBy(*PAIR, "route_id")  # one shuffle by pair serves all that follows
    bound = inverse_binary_logit(F.lit((1 - cutoff) / 2 + 0.5))
    steps = steps.withColumn("cost", F.sum("__t").over(route)).withColumn("__least", F.min("cost").over(pair))
    steps = steps.withColumn("mask", (F.col("__least") > 0) & (F.col("cost") <= F.col("__least") + bound))
    steps = steps.withColumn("__n", F.sum(F.col("mask").cast("int")).over(W.partitionBy(*PAIR, "link")))
    share = F.sum(F.when(F.col("mask"), F.col("__t") / F.col("cost") / F.col("__n")).otherwise(0.0))
    full = steps.groupBy(*PAIR, "route_id", "route").agg(F.first("cost").alias("cost"), F.first("mask").alias("mask"), F.first("__least").alias("__least"), share.alias("path_overlap"))
    weight = F.when(F.col("mask"), F.pow("path_overlap", F.lit(beta)) * F.exp(F.col("__least") - F.col("cost"))).otherwise(0.0)
    full = full.withColumn("__w", weight).withColumn("__s", F.sum("__w").over(pair))
    return full.select(*PAIR, "route", "route_id", "cost", "mask", "path_overlap", F.when(F.col("__s") > 0, F.col("__w") / F.col("__s")).otherwise(0.0).alias("probability"))


def link_frequency(routes: DataFrame) -> DataFrame:
    """(origin, destination, link, n): routes of the pair that use the link."""
    return routes.select(*PAIR, F.explode("route").alias("link")).groupBy(*PAIR, "link").agg(F.count("*").alias("n"))


def _demanded(routes: DataFrame, demand: DataFrame, core: str) -> DataFrame:
    missing = demand.where(F.col(core) > 0).where("origin <> destination").join(routes.select(*PAIR).distinct(), PAIR, "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"demand without a route: {missing.first()[0:2]}")
    return routes.join(demand.select(*PAIR, F.col(core).alias("__d")), PAIR).withColumn("volume", F.col("probability") * F.col("__d"))


def load_routes(routes: DataFrame, demand: DataFrame, core: str) -> DataFrame:
    """(link_id, direction, volume) of routes with probabilities; demand without a route is an error."""
    steps = _demanded(routes, demand, core).select(F.explode("route").alias("link"), "volume")
    return steps.groupBy(F.abs("link").alias("link_id"), F.signum("link").cast("long").alias("direction")).agg(F.sum("volume").alias("volume"))


def select_sets(spark: SparkSession, sets: dict[str, list]) -> DataFrame:
    """(set, part, link, direction): a set is met by a route that uses all links of any of its parts. A part is one
    (link, direction) or a list of them; direction 0 means either way."""
    rows = [(name, k, int(link), int(way)) for name, parts in sets.items() for k, part in enumerate(parts) for link, way in (part if isinstance(part, list) else [part])]
    return spark.createDataFrame(rows, "set string, part int, link_id long, direction long").distinct()


def routes_in_sets(routes: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, origin, destination, route_id) of routes that use all links of a part of the set."""
    steps = routes.select(*PAIR, "route_id", F.explode(F.array_distinct("route")).alias("link")).select(*PAIR, "route_id", F.abs("link").alias("link_id"), F.signum("link").cast("long").alias("way"))
    size = sets.groupBy("set", "part").agg(F.count("*").alias("n"))  # the caller's list of links: a few rows
    hit = steps.join(F.broadcast(sets), "link_id").where("direction = 0 or direction = way").select("set", "part", *PAIR, "route_id", "link_id", "direction").distinct()
    return hit.groupBy("set", "part", *PAIR, "route_id").agg(F.count("*").alias("m")).join(F.broadcast(size), ["set", "part"]).where("m = n").select("set", *PAIR, "route_id").distinct()


def select_link(routes: DataFrame, demand: DataFrame, core: str, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, origin, destination, volume) and (set, link_id, direction, volume) of demand on routes in the sets."""
    used = _demanded(routes, demand, core).join(routes_in_sets(routes, sets), [*PAIR, "route_id"])
    od = used.groupBy("set", *PAIR).agg(F.sum("volume").alias("volume"))
    links = used.select("set", F.explode("route").alias("link"), "volume").groupBy("set", F.abs("link").alias("link_id"), F.signum("link").cast("long").alias("direction")).agg(F.sum("volume").alias("volume"))
    return od, links


def sub_area(routes: DataFrame, demand: DataFrame, core: str, edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(origin, destination, volume) of the demand within an area: inside(node) are its nodes, edges(link, tail, head) by signed link.

    Each maximal run of a route's edges that touch the area becomes demand from where it enters (a boundary node outside) or begins to
    where it leaves or ends.
    """
    rows = _demanded(routes, demand, core).select(F.struct(*PAIR, "route_id").alias("route_id"), "volume", F.posexplode("route").alias("p", "link"))
    mark = inside.select("node", F.lit(True).alias("in")).distinct()
    e = edges.join(mark.withColumnsRenamed({"node": "tail", "in": "tin"}), "tail", "left").join(mark.withColumnsRenamed({"node": "head", "in": "hin"}), "head", "left")
    e = e.select("link", "tail", "head", F.expr("tin is not null").alias("tin"), F.expr("hin is not null").alias("hin"))
    touching = rows.join(e, "link").where("tin or hin")
    by = W.partitionBy("route_id").orderBy("p")
    runs = touching.withColumn("run", F.col("p") - F.row_number().over(by))
    ends = runs.groupBy("route_id", "run").agg(F.min_by("tail", "p").alias("origin"), F.max_by("head", "p").alias("destination"), F.first("volume").alias("volume"))
    return ends.where("origin <> destination").groupBy(*PAIR).agg(F.sum("volume").alias("volume"))
