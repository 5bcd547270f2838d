"""Networks as DataFrames: directed expansion, node index, exclusions, compression, and searches run in partitions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import kernels as K

#: A graph over this many bytes isn't broadcast; relational relaxation (min_plus) takes its place.
BROADCAST_BYTES = 512 << 20
REQUIRED = ("link_id", "a_node", "b_node", "direction")


def reachable_package(spark: SparkSession) -> None:
    """Let Python workers on this file system import the package; on a cluster ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by columns to a stated number of partitions: rows that cost much work are few bytes, and adaptive execution would
    put them all in one task."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *columns)


def validate_links(links: DataFrame) -> DataFrame:
    """Lower-cases names; raises for missing columns, a field with only one of _ab and _ba, repeated ids or a wrong direction."""
    links = links.toDF(*[c.lower() for c in links.columns])
    if missing := [c for c in REQUIRED if c not in links.columns]:
        raise ValueError(f"links lack {', '.join(missing)}")
    for c in links.columns:
        if c[-3:] in ("_ab", "_ba") and c[:-3] + {"_ab": "_ba", "_ba": "_ab"}[c[-3:]] not in links.columns:
            raise ValueError(f"field {c} has no counterpart for the other direction")
    bad = links.agg(F.count("*").alias("n"), F.count_distinct("link_id").alias("d"), F.count_if(~F.col("direction").isin(-1, 0, 1) | F.col("direction").isNull()).alias("w")).first()
    if bad.n != bad.d:
        raise ValueError("link ids must be unique")
    if bad.w:
        raise ValueError("direction must be -1, 0 or 1")
    return links


def directed(links: DataFrame) -> DataFrame:
    """One row for each direction that may be travelled: link_id, direction, tail, head, and fields with _ab/_ba resolved."""
    sided = sorted({c[:-3] for c in links.columns if c.endswith("_ab")})
    plain = [c for c in links.columns if c not in REQUIRED and c[-3:] not in ("_ab", "_ba")]

    def half(way: int) -> DataFrame:
        tail, head, side = ("a_node", "b_node", "ab") if way == 1 else ("b_node", "a_node", "ba")
        return links.where(F.col("direction") != -way).select("link_id", F.lit(way).alias("direction"), F.col(tail).alias("tail"), F.col(head).alias("head"), *plain, *[F.col(f"{c}_{side}").alias(c) for c in sided])

    return half(1).unionByName(half(-1))


def reverse(links: DataFrame) -> DataFrame:
    """The transpose: ends swapped, all else as it is."""
    names = {"a_node": "b_node", "b_node": "a_node"}
    return links.select(*[F.col(c).alias(names.get(c, c)) for c in links.columns])


def numbered(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """df with rows numbered from `first` in an order that has no ties: sorted ranges, each numbered on from the rows of those before it. Written
    to the shared folder, so that a range counts the same rows when it is read again."""
    spark = df.sparkSession
    checkpoints(spark)
    keys = {f"__o{k}": c if not isinstance(c, str) else F.col(c) for k, c in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k")).checkpoint()
    at, starts = first, []
    for r in rows.groupBy("__p").count().orderBy("__p").collect():  # a row for each range
        starts.append((r[0], at))
        at += r[1]
    offsets = spark.createDataFrame(starts, "__p int, __at long")
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__at") + F.col("__k")).drop("__p", "__k", "__at")


def node_index(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(node, position, is_zone): zones first, by id, then the other nodes by id."""
    nodes = edges.select(F.col("tail").alias("node")).union(edges.select("head")).union(zones.select("zone")).distinct()
    marked = nodes.join(zones.select(F.col("zone").alias("node"), F.lit(True).alias("z")), "node", "left").withColumn("is_zone", F.coalesce("z", F.lit(False)))
    return numbered(marked.select("node", "is_zone"), [~F.col("is_zone"), "node"], "position").select("node", "position", "is_zone")


def supernet_ids(edges: DataFrame) -> DataFrame:
    """Adds supernet_id, numbered by link and direction (forward first)."""
    return numbered(edges, ["link_id", -F.col("direction")], "supernet_id")


def exclude_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links without those of ids(link_id)."""
    return links.join(ids.select("link_id").distinct(), "link_id", "left_anti")


def for_mode(links: DataFrame, mode: str) -> DataFrame:
    return links.where(F.contains("modes", F.lit(mode)))


def within(links: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Links with both ends inside a box (x0, y0, x1, y1) of nodes(node, x, y)."""
    inside = nodes.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])).select("node")
    return links.join(inside.withColumnRenamed("node", "a_node"), "a_node", "left_semi").join(inside.withColumnRenamed("node", "b_node"), "b_node", "left_semi")


def skimmable_fields(links: DataFrame) -> list[str]:
    """Numeric fields, a pair _ab/_ba as one."""
    numeric = {c for c, t in links.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")} - set(REQUIRED)
    return sorted({c[:-3] if c[-3:] in ("_ab", "_ba") else c for c in numeric})


def arrays(edges: DataFrame, zones: DataFrame, cost: str, fields: tuple[str, ...] = ()) -> K.GraphArrays:
    """The directed graph as arrays for the kernels: zones first, by id. Refused if too large to broadcast."""
    size = edges.count() * 8 * (5 + len(fields))
    if size > BROADCAST_BYTES:
        raise ValueError(f"the graph takes {size} bytes; use min_plus")
    pdf = edges.select("link_id", "direction", "tail", "head", F.col(cost).cast("double").alias("__cost"), *[F.col(f).cast("double").alias(f"__{f}") for f in fields]).toPandas()
    zone = np.sort(zones.select("zone").distinct().toPandas()["zone"].to_numpy(np.int64))
    if len(zone) and zone[0] <= 0:
        raise ValueError("zone ids must be positive")
    if pdf["__cost"].min() < 0:
        raise ValueError(f"{cost} must not be negative")
    rest = np.setdiff1d(np.concatenate([pdf["tail"].to_numpy(np.int64), pdf["head"].to_numpy(np.int64)]), zone)
    nodes = np.concatenate([zone, rest])
    by_id = np.argsort(nodes)
    place = lambda x: by_id[np.searchsorted(nodes, x, sorter=by_id)]
    return K.GraphArrays(nodes, place(pdf["tail"].to_numpy(np.int64)), place(pdf["head"].to_numpy(np.int64)), pdf["__cost"].to_numpy(), pdf["link_id"].to_numpy(np.int64), pdf["direction"].to_numpy(np.int64), frozenset(range(len(zone))), {f: pdf[f"__{f}"].to_numpy() for f in fields})


def per_origins(spark: SparkSession, graph: K.GraphArrays, origins: DataFrame, work, schema: str, blocked: bool = False) -> DataFrame:
    """work(graph, trees) -> DataFrame for batches of origins(origin) searched together; unknown origins give nothing."""
    reachable_package(spark)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            for some in K.batches_of(g, [g.place[o] for o in pdf["origin"].tolist() if o in g.place]):
                yield work(g, K.shortest_trees(g, np.array(some), blocked))

    return spread(origins.select(F.col("origin").cast("long").alias("origin")).distinct(), "origin").mapInPandas(run, schema)


def skims(spark: SparkSession, graph: K.GraphArrays, zones: DataFrame, names: list[str], blocked: bool = False) -> DataFrame:
    """(origin, destination, cost, *names): sums along the cheapest paths between zones; 0 within, infinite if unreachable."""

    def work(g, trees):
        z = np.array(sorted(g.zones))
        out = pd.DataFrame({"origin": np.repeat(g.nodes[trees.origins], len(z)), "destination": np.tile(g.nodes[z], len(trees.origins)), "cost": trees.cost[:, z].ravel()})
        values = K.path_sums(g, trees, names)[:, z]
        return out.assign(**{n: values[:, :, k].ravel() for k, n in enumerate(names)})

    schema = "origin long, destination long, cost double" + "".join(f", {n} double" for n in names)
    return per_origins(spark, graph, zones.select(F.col("zone").alias("origin")), work, schema, blocked)


def trees(spark: SparkSession, graph: K.GraphArrays, origins: DataFrame, blocked: bool = False) -> DataFrame:
    """(origin, node, cost, pred_node, link_id, direction) of reachable nodes; no predecessor at the origin."""

    def work(g, found):
        row, at = np.nonzero(np.isfinite(found.cost))
        k = found.edge[row, at]
        some = k >= 0
        none = lambda x: pd.array(np.where(some, x, 0), dtype="Int64").copy()
        out = pd.DataFrame({"origin": g.nodes[found.origins[row]], "node": g.nodes[at], "cost": found.cost[row, at], "pred_node": none(g.nodes[g.tail[k]]), "link_id": none(g.link_id[k]), "direction": none(g.direction[k])})
        out.loc[~some, ["pred_node", "link_id", "direction"]] = pd.NA
        return out

    return per_origins(spark, graph, origins, work, "origin long, node long, cost double, pred_node long, link_id long, direction long", blocked)


def paths(spark: SparkSession, graph: K.GraphArrays, pairs: DataFrame, blocked: bool = False) -> DataFrame:
    """(origin, destination, path array<struct<link_id, direction, node, milepost>>) of pairs(origin, destination).

    Null where there is no path, or origin and destination are one.
    """
    reachable_package(spark)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        last = None
        for pdf in batches:
            out = []
            for o, d in zip(pdf["origin"].tolist(), pdf["destination"].tolist(), strict=True):
                steps = []
                if o in g.place and d in g.place and o != d:
                    if last is None or last.origin != g.place[o]:
                        last = K.shortest_tree(g, g.place[o], blocked)
                    steps = [(int(g.link_id[k]), int(g.direction[k]), int(g.nodes[g.head[k]]), float(last.cost[g.head[k]])) for k in K.path_edges(g, last, g.place[d])]
                out.append((o, d, [dict(zip(("link_id", "direction", "node", "milepost"), s, strict=True)) for s in steps] or None))
            yield pd.DataFrame(out, columns=["origin", "destination", "path"])

    ordered = spread(pairs.select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination")), "origin").sortWithinPartitions("origin")
    return ordered.mapInPandas(run, "origin long, destination long, path array<struct<link_id:long,direction:long,node:long,milepost:double>>")


def disconnected(spark: SparkSession, graph: K.GraphArrays, zones: DataFrame, blocked: bool = False) -> DataFrame:
    """(origin, destination) pairs of zones without a path; costs don't matter."""
    reachable_package(spark)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        z = np.array(sorted(g.zones))
        for pdf in batches:
            for o in pdf["zone"].tolist():
                seen = K.reachable(g, g.place[o], blocked)
                yield pd.DataFrame({"origin": o, "destination": g.nodes[z[~seen[z]]]})

    return spread(zones.select(F.col("zone").cast("long").alias("zone")), "zone").mapInPandas(run, "origin long, destination long")


def checkpoints(spark: SparkSession) -> None:
    """Sees that checkpoints go to the folder that driver and executors share; one of our own only in local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(path or "/tmp/checkpoints")


def min_plus(edges: DataFrame, origins: DataFrame, cost: str) -> DataFrame:
    """(origin, node, cost, pred_node, link_id, direction) by relaxing all labels at once, round by round until none gets better: for
    graphs too large to broadcast. Only labels that got better are sent on; each round is checkpointed to the shared folder."""
    spark = edges.sparkSession
    checkpoints(spark)
    origin = origins.select(F.col("origin").alias("origin"))
    none = F.lit(None).cast("long")
    labels = origin.select("origin", F.col("origin").alias("node"), F.struct(F.lit(0.0).alias("cost"), none.alias("pred_node"), none.alias("link_id"), none.alias("direction"), F.lit(None).cast("double").alias("step")).alias("l")).checkpoint()
    front = labels
    step = edges.select("tail", "head", F.col(cost).cast("double").alias("c"), F.col("link_id").cast("long").alias("link_id"), F.col("direction").cast("long").alias("direction"))
    while True:  # costs aren't negative: a round settles at least one more link of each path
        sent = front.join(step, F.col("node") == F.col("tail")).select("origin", F.col("head").alias("node"), F.struct((F.col("l.cost") + F.col("c")).alias("cost"), F.col("tail").alias("pred_node"), "link_id", "direction", F.col("c").alias("step")).alias("l"))
        best = sent.groupBy("origin", "node").agg(F.min("l").alias("n"))
        both = labels.join(best, ["origin", "node"], "full").select("origin", "node", "l", "n").checkpoint()
        better = F.expr("n is not null and (l is null or n.cost < l.cost or (n.cost = l.cost and node <> origin and n.step > 0 and n < l))")
        front = both.where(F.expr("n is not null and (l is null or n.cost < l.cost)")).select("origin", "node", F.col("n").alias("l"))
        labels = both.select("origin", "node", F.when(better, F.col("n")).otherwise(F.col("l")).alias("l"))
        if front.isEmpty():
            return labels.select("origin", "node", "l.*").drop("step")


def dead_ends(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(link_id, direction) of edges that no path between zones can use: into or out of nodes that can be entered from and left
    to one neighbour only, or can't be entered at all, round by round until none is left. Nodes that can only be entered stay."""
    checkpoints(edges.sparkSession)
    own = edges.select("link_id", "direction", "tail", "head").where("tail <> head").checkpoint()
    live, n = own, own.count()
    keep = zones.select(F.col("zone").alias("node"))
    while n:
        ends = live.select(F.col("tail").alias("node"), F.col("head").alias("other"), F.lit(1).alias("out")).union(live.select("head", "tail", F.lit(0)))
        both = ends.groupBy("node").agg(F.sum("out").alias("o"), F.sum(1 - F.col("out")).alias("i"), F.min("other").alias("low"), F.max("other").alias("high"))
        gone = both.where("i = 0 or (o > 0 and low = high)").select("node").join(keep, "node", "left_anti")
        live = live.join(gone.select(F.col("node").alias("tail")), "tail", "left_anti").join(gone.select(F.col("node").alias("head")), "head", "left_anti").select(own.columns).checkpoint()
        n, before = live.count(), n
        if n == before:
            break
    return own.join(live, ["link_id", "direction"], "left_anti").select("link_id", "direction")


def chains(links: DataFrame, zones: DataFrame) -> DataFrame:
    """(link_id, chain, seq, way): links contracted at nodes of degree two that aren't zones; way is 1 where the link runs along
    its chain. Degrees count links whatever their direction; a chain is named by its smallest link. O(links) on the driver, so
    refused for graphs too large to broadcast."""
    spark = links.sparkSession
    rows = links.select("link_id", "a_node", "b_node").where("a_node <> b_node").toPandas()
    if len(rows) * 24 > BROADCAST_BYTES:
        raise ValueError("the network is too large to contract")
    at: dict[int, list[int]] = {}
    ends = {int(r.link_id): (int(r.a_node), int(r.b_node)) for r in rows.itertuples()}
    for k, (a, b) in ends.items():
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)
    fixed = {r[0] for r in zones.collect()} | {n for n, ks in at.items() if len(ks) != 2}
    seen, out = set(), []

    def follow(link: int, node: int) -> list[tuple[int, int]]:
        """Links from one that is left at node, up to a fixed node."""
        steps = []
        while True:
            a, b = ends[link]
            seen.add(link)
            node, way = (b, 1) if node == a else (a, -1)
            steps.append((link, way))
            if node in fixed:
                return steps
            following = [k for k in at[node] if k != link] or [link]
            if following[0] in seen:
                return steps
            link = following[0]

    starts = [(k, n) for n in sorted(fixed) if n in at for k in sorted(at[n])]
    for k, n in [*starts, *((k, ends[k][0]) for k in sorted(ends))]:
        if k not in seen:
            steps = follow(k, n)
            if min(steps)[0] != steps[0][0] and min(steps)[0] == steps[-1][0]:
                steps = [(j, -w) for j, w in reversed(steps)]
            name = min(j for j, _ in steps)
            out += [(j, name, s, w) for s, (j, w) in enumerate(steps)]
    return spark.createDataFrame(out, "link_id long, chain long, seq int, way int")


def compressed(edges: DataFrame, chain: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(chain, direction, tail, head, *sums): one edge for each way along a chain that all of its links allow."""
    rows = edges.join(chain, "link_id").withColumn("along", F.col("direction") * F.col("way"))
    length = chain.groupBy("chain").agg(F.count("*").alias("n"))
    key = F.when(F.col("along") == 1, F.col("seq")).otherwise(-F.col("seq"))
    sums = rows.groupBy("chain", F.col("along").alias("direction")).agg(F.count("*").alias("m"), F.min_by("tail", key).alias("tail"), F.max_by("head", key).alias("head"), *[F.sum(f).alias(f) for f in fields])
    return sums.join(length, "chain").where("m = n and tail <> head").drop("m", "n")


def a_star_paths(spark: SparkSession, graph: K.GraphArrays, pairs: DataFrame, places: DataFrame, kind: str = "haversine") -> DataFrame:
    """(origin, destination, cost, links array<long>) of pairs by A*, with places(node, lon, lat); for distance costs. Null where there is no path."""
    reachable_package(spark)
    at = {r.node: (r.lon, r.lat) for r in places.select("node", "lon", "lat").collect()}
    graph.points = np.array([at[int(n)] for n in graph.nodes])
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            out = []
            for o, d in zip(pdf["origin"].tolist(), pdf["destination"].tolist(), strict=True):
                if o not in g.place or d not in g.place:
                    out.append((o, d, None, None))
                    continue
                tree = K.a_star(g, g.place[o], g.place[d], K.estimate(g.points, g.place[d], kind))
                steps = K.path_edges(g, tree, g.place[d])
                cost = float(tree.cost[g.place[d]])
                out.append((o, d, cost if np.isfinite(cost) else None, (g.link_id[steps] * g.direction[steps]).tolist() if steps else None))
            yield pd.DataFrame(out, columns=["origin", "destination", "cost", "links"])

    return spread(pairs.select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination")), "destination").mapInPandas(run, "origin long, destination long, cost double, links array<long>")
