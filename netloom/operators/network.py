"""Network upkeep as batch rewrites and checks: ends and nodes, modes, link types, registries, merging of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.graph import numbered


def node_modes(links: DataFrame) -> DataFrame:
    """(node, modes, link_types): distinct sorted characters of the links at a node."""
    ends = links.select(F.explode(F.array("a_node", "b_node")).alias("node"), "modes", "link_type")
    each = ends.select("node", F.explode(F.filter(F.split("modes", ""), lambda c: c != "")).alias("mode"), "link_type")
    return each.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("mode")), "").alias("modes"), F.array_join(F.array_sort(F.collect_set("link_type")), "").alias("link_types"))


def mode_union(links: DataFrame) -> DataFrame:
    """(a_node, b_node, modes): all modes of parallel links."""
    each = links.select("a_node", "b_node", F.explode(F.filter(F.split("modes", ""), lambda c: c != "")).alias("mode"))
    return each.groupBy("a_node", "b_node").agg(F.array_join(F.array_sort(F.collect_set("mode")), "").alias("modes"))


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without a link that aren't centroids."""
    used = links.select(F.col("a_node").alias("node")).union(links.select("b_node"))
    return nodes.where("not is_centroid").join(used, "node", "left_anti")


def attach_ends(lines: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of lines(link_id, x1, y1, x2, y2) with the nodes at their ends; nodes(node, x, y) gains one for each new place, numbered by x, y."""
    places = lines.select(F.col("x1").alias("x"), F.col("y1").alias("y")).union(lines.select("x2", "y2")).distinct()
    top = nodes.agg(F.max("node")).first()[0] or 0
    new = numbered(places.join(nodes.select("x", "y"), ["x", "y"], "left_anti"), ["x", "y"], "node", top + 1).select("node", "x", "y")
    every = nodes.select("node", "x", "y").unionByName(new)
    a, b = (every.select(F.col("node").alias(n), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, n in ((1, "a_node"), (2, "b_node")))
    distance = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    return lines.join(a, ["x1", "y1"]).join(b, ["x2", "y2"]).select("link_id", "a_node", "b_node", distance.alias("distance")), every


def violations(links: DataFrame, nodes: DataFrame, modes: DataFrame, types: DataFrame) -> DataFrame:
    """(rule, key): what breaks the network's rules. All checks in one union, each an aggregate or an anti join."""
    out = [
        links.where("direction not in (-1, 0, 1) or direction is null").select(F.lit("direction").alias("rule"), F.col("link_id").cast("string").alias("key")),
        links.groupBy("link_id").count().where("count > 1").select(F.lit("repeated link"), F.col("link_id").cast("string")),
        links.where("coalesce(modes, '') = ''").select(F.lit("no mode"), F.col("link_id").cast("string")),
        nodes.groupBy("node").count().where("count > 1").select(F.lit("repeated node"), F.col("node").cast("string")),
        nodes.where("is_centroid is null").select(F.lit("is_centroid"), F.col("node").cast("string")),
        links.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").select(F.lit("unknown node"), F.col("node").cast("string")),
        links.select(F.explode(F.filter(F.split("modes", ""), lambda c: c != "")).alias("mode")).distinct().join(modes.select("mode"), "mode", "left_anti").select(F.lit("unknown mode"), "mode"),
        links.select("link_type").distinct().join(types.select("link_type"), "link_type", "left_anti").select(F.lit("unknown link type"), "link_type"),
        modes.where("not mode rlike '^[A-Za-z]$'").select(F.lit("mode id"), "mode"),
    ]
    both = out[0]
    for o in out[1:]:
        both = both.union(o)
    return both


def reconcile(registry: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state): registered names without a table are missing, tables without a record unregistered; names match in any case."""
    a, b = registry.select(F.lower("name").alias("name")).distinct(), present.select(F.lower("name").alias("name")).distinct()
    return a.join(b, "name", "left_anti").select("name", F.lit("missing").alias("state")).union(b.join(a, "name", "left_anti").select("name", F.lit("unregistered").alias("state")))


def merge_parallel(links: DataFrame) -> DataFrame:
    """Parallel links of one direction become one (the smallest link_id; capacities and lanes add up), opposite ones one two-way link."""
    one = links.groupBy("from_node", "to_node").agg(F.min("link_id").alias("link_id"), F.sum("lanes").alias("lanes"), F.sum("capacity").alias("capacity"))
    low, high = F.least("from_node", "to_node"), F.greatest("from_node", "to_node")
    sides = one.select("*", low.alias("lo"), high.alias("hi"))
    first = F.struct("link_id", "from_node", "to_node", "lanes", "capacity")
    two = sides.groupBy("lo", "hi").agg(F.min(first).alias("f"), F.max(first).alias("g"), F.count("*").alias("n"))
    return two.select("f.link_id", F.col("f.from_node").alias("a_node"), F.col("f.to_node").alias("b_node"), F.when(F.col("n") == 2, 0).otherwise(1).cast("int").alias("direction"),
                      F.col("f.lanes").alias("lanes_ab"), F.col("f.capacity").alias("capacity_ab"), F.when(F.col("n") == 2, F.col("g.lanes")).alias("lanes_ba"), F.when(F.col("n") == 2, F.col("g.capacity")).alias("capacity_ba"))


def exported_rows(links: DataFrame) -> DataFrame:
    """GMNS rows: a two-way link as two; metres as kilometres."""
    base = ["link_id", "direction"]
    ab = links.where("direction >= 0").select(*base, F.col("a_node").alias("from_node_id"), F.col("b_node").alias("to_node_id"), (F.col("distance") / 1000).alias("length"), F.lit(1).alias("dir_flag"))
    ba = links.where("direction <= 0").select(*base, F.col("b_node"), F.col("a_node"), F.col("distance") / 1000, F.lit(-1))
    return ab.union(ba)


def split_ways(ways: DataFrame) -> DataFrame:
    """(way, seg, nodes) of ways(way, nodes array<long>): cut at inner nodes that occur more than once over all ways."""
    each = ways.select("way", F.posexplode("nodes").alias("p", "node"), F.size("nodes").alias("n"))
    shared = each.groupBy("node").count().where("count > 1").select("node", F.lit(True).alias("s"))
    marked = each.join(shared, "node", "left").withColumn("cut", F.coalesce("s", F.lit(False)) & (F.col("p") > 0) & (F.col("p") < F.col("n") - 1))
    seg = F.sum(F.col("cut").cast("int")).over(W.partitionBy("way").orderBy("p"))
    numbered = marked.withColumn("seg", seg)
    ends = numbered.where("cut").select("way", "p", "node", (F.col("seg") - 1).alias("seg"))
    both = numbered.select("way", "p", "node", "seg").union(ends)
    return both.groupBy("way", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "node"))), lambda s: s["node"]).alias("nodes"))


def simplified(links: DataFrame, chains: DataFrame, max_ratio: float = 1.1) -> DataFrame:
    """(chain, distance, speed, capacity, lanes, link_type): chains of links of one type and lane count whose speeds differ by max_ratio
    at most, as one link: speed and capacity weighted by distance, other fields of the longest link."""
    rows = links.join(chains.select("link_id", "chain"), "link_id")
    same = rows.groupBy("chain").agg(
        F.count_distinct("link_type", "lanes").alias("kinds"), (F.max("speed") / F.min("speed")).alias("ratio"), F.count("*").alias("n"), F.sum("distance").alias("distance"),
        (F.sum(F.col("speed") * F.col("distance")) / F.sum("distance")).alias("speed"), (F.sum(F.col("capacity") * F.col("distance")) / F.sum("distance")).alias("capacity"),
        F.max_by("lanes", F.struct("distance", "link_id")).alias("lanes"), F.max_by("link_type", F.struct("distance", "link_id")).alias("link_type"),
    )
    return same.where(F.expr(f"kinds = 1 and ratio <= {max_ratio}")).drop("kinds", "ratio")


def collapse(links: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of gone(link_id) are removed and their ends become one node, the smaller, at the mid-point. Links to remove must not share a node."""
    ends = links.join(gone.select("link_id"), "link_id", "left_semi").select(F.least("a_node", "b_node").alias("keep"), F.greatest("a_node", "b_node").alias("drop"))
    map_ = ends.select(F.col("drop").alias("node"), "keep")
    left = links.join(gone.select("link_id"), "link_id", "left_anti")
    for c in ("a_node", "b_node"):
        left = left.join(map_.select(F.col("node").alias(c), "keep"), c, "left").withColumn(c, F.coalesce("keep", c)).drop("keep")
    mids = ends.join(nodes.select(F.col("node").alias("keep"), F.col("x").alias("x1"), F.col("y").alias("y1")), "keep").join(nodes.select(F.col("node").alias("drop"), F.col("x").alias("x2"), F.col("y").alias("y2")), "drop")
    moved = mids.select(F.col("keep").alias("node"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    rest = nodes.select("node", "x", "y").join(ends.select(F.explode(F.array("keep", "drop")).alias("node")), "node", "left_anti")
    return left.where("a_node <> b_node"), rest.unionByName(moved)
