"""Edits of a network as batch rewrites: each gives new tables that keep the network's rules, or raises and changes nothing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.network import node_modes, orphans

#: Fixed value: the type of links that join zones to the network.
CONNECTOR_TYPE = "centroid_connector"
RESERVED = {"link_id", "a_node", "b_node", "direction", "distance", "modes", "link_type", "node", "node_id", "is_centroid", "geometry", "ogc_fid"}


def some(df: DataFrame, message: str) -> None:
    """Raises with the first row if there is one."""
    first = df.first()
    if first is not None:
        raise ValueError(f"{message}: {first[0]}")


def delete_links(links: DataFrame, nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without those of ids(link_id), and nodes without those that then have no link and aren't centroids. Unknown ids are an error."""
    some(ids.select("link_id").join(links.select("link_id"), "link_id", "left_anti"), "no link")
    left = links.join(ids.select("link_id").distinct(), "link_id", "left_anti")
    touched = links.join(ids.select("link_id"), "link_id", "left_semi").select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
    gone = orphans(nodes, left).select("node").join(touched, "node", "left_semi")
    return left, nodes.join(gone, "node", "left_anti")


def copy_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links and a copy of each of ids(link_id), numbered on from the largest link, by id."""
    some(ids.select("link_id").join(links.select("link_id"), "link_id", "left_anti"), "no link")
    top = links.agg(F.max("link_id")).first()[0]
    number = F.row_number().over(W.orderBy("link_id")) + top  # the list of an edit, not a table
    copies = links.join(ids.select("link_id").distinct(), "link_id", "left_semi").withColumn("link_id", number.cast("long"))
    return links.unionByName(copies.select(links.columns))


def renumber_nodes(nodes: DataFrame, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links with the numbers of new(node, to). A number may be used once, and not by a node that keeps it."""
    some(new.select("node").join(nodes.select("node"), "node", "left_anti"), "no node")
    some(new.groupBy("to").count().where("count > 1"), "two nodes would have the number")
    kept = nodes.select("node").join(new.select("node"), "node", "left_anti")
    some(new.select(F.col("to").alias("node")).join(kept, "node", "left_semi"), "there is a node")
    changed = nodes.join(new, "node", "left").withColumn("node", F.coalesce("to", "node")).select(nodes.columns)
    out = links
    for c in ("a_node", "b_node"):
        out = out.join(new.select(F.col("node").alias(c), F.col("to").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return changed, out.select(links.columns)


def move_nodes(nodes: DataFrame, lines: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes at new places(node, x, y), and lines(link_id, a_node, b_node, x1, y1, x2, y2, ..) whose ends follow them; distances are anew. Two
    nodes at one place are an error."""
    moved = nodes.join(places.select("node", F.col("x").alias("__x"), F.col("y").alias("__y")), "node", "left").withColumns({"x": F.coalesce("__x", "x"), "y": F.coalesce("__y", "y")}).select(nodes.columns)
    some(moved.groupBy("x", "y").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n > 1").select("node"), "another node stands where one would stand with")
    out = lines
    for end, k in (("a_node", 1), ("b_node", 2)):
        out = out.join(places.select(F.col("node").alias(end), F.col("x").alias("__x"), F.col("y").alias("__y")), end, "left")
        out = out.withColumns({f"x{k}": F.coalesce("__x", f"x{k}"), f"y{k}": F.coalesce("__y", f"y{k}")}).drop("__x", "__y")
    return moved, out.withColumn("distance", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")))


def add_centroids(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """Nodes and one centroid for each of zones(zone, x, y), under its number. A number that a node has is an error."""
    some(zones.select(F.col("zone").alias("node")).join(nodes.select("node"), "node", "left_semi"), "there is a node")
    return nodes.unionByName(zones.select(F.col("zone").cast("long").alias("node"), "x", "y", F.lit(True).alias("is_centroid")), allowMissingColumns=True)


def set_modes(links: DataFrame, modes: DataFrame, change: DataFrame) -> DataFrame:
    """Links with the modes of change(link_id, modes), which must be known and at least one."""
    some(change.where("coalesce(modes, '') = ''").select("link_id"), "no mode for link")
    some(change.select(F.explode(F.filter(F.split("modes", ""), lambda c: c != "")).alias("mode")).distinct().join(modes.select("mode"), "mode", "left_anti"), "unknown mode")
    return links.join(change.select("link_id", F.col("modes").alias("__m")), "link_id", "left").withColumn("modes", F.coalesce("__m", "modes")).select(links.columns)


def delete_modes(modes: DataFrame, links: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame]:
    """Modes without some, and links without them; a link that would have none left is an error."""
    pattern = f"[{re.escape(''.join(gone))}]"
    left = links.withColumn("modes", F.regexp_replace("modes", pattern, ""))
    some(left.where("modes = ''").select("link_id"), "no mode is left on link")
    return modes.where(~F.col("mode").isin(gone)), left


def delete_link_type(types: DataFrame, links: DataFrame, gone: str) -> DataFrame:
    """Link types without one that no link has; the connectors' type stays."""
    if gone == CONNECTOR_TYPE:
        raise ValueError(f"{gone} stays")
    some(links.where(F.col("link_type") == gone).select("link_id"), f"type {gone} is that of link")
    return types.where(F.col("link_type") != gone)


def add_field(table: DataFrame, fields: DataFrame, name: str, kind: str = "double", description: str = "") -> tuple[DataFrame, DataFrame]:
    """The table with a field of nulls, and fields(name, description) with its row. Names are letters, digits and underscores, begin with a
    letter, and are new in any case."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name):
        raise ValueError(f"{name} is no name for a field")
    if name.lower() in {c.lower() for c in table.columns} | RESERVED:
        raise ValueError(f"there is a field {name}")
    row = table.sparkSession.createDataFrame([(name, description)], "name string, description string")
    return table.withColumn(name, F.lit(None).cast(kind)), fields.select("name", "description").union(row)


def refreshed_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with modes and link types anew, of the links at them."""
    return nodes.drop("modes", "link_types").join(node_modes(links), "node", "left")


def route_link_distances(route_links: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, seq, link_id, distance): each step's distance is its link's."""
    return route_links.drop("distance").join(links.select("link_id", "distance"), "link_id").select("pattern", "seq", "link_id", "distance")


def counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(what, n): links, nodes and centroids."""
    of_nodes = nodes.agg(F.count("*").alias("nodes"), F.count_if("is_centroid").alias("centroids"))
    each = links.agg(F.count("*").alias("links")).join(of_nodes)
    return each.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in each.columns]), F.array(*each.columns))).alias("what", "n"))
