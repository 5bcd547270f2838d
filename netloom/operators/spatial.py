"""Spatial joins on grid cells, connectors, zones, coverage of stops; geometry as arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.graph import numbered


def cell(x: Column, y: Column, size: float) -> list[Column]:
    return [F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")]


def around(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each row once for each of the nine cells at and around its own."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("__s", F.explode(steps)).withColumn("cx", F.floor(F.col(x) / size) + F.col("__s.i")).withColumn("cy", F.floor(F.col(y) / size) + F.col("__s.j")).drop("__s")


def within_radius(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance): points a(id, x, y) and b(id, x, y) at a distance of radius or less, met in cells of that size."""
    left = around(a.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), radius, "ax", "ay")
    right = b.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *cell(F.col("x"), F.col("y"), radius))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return left.join(right, ["cx", "cy"]).select("a", "b", d.alias("distance")).where(F.col("distance") <= radius)


def nearest(a: DataFrame, b: DataFrame, k: int = 1, bound: float | None = None, first: float | None = None) -> DataFrame:
    """(a, b, distance, rank): the k nearest points of b for each of a, ties by id; within bound if there is one.

    Rounds of radius joins: a point is done once k are found within the radius; the rest go on with twice the radius, until
    it covers the extent. The first radius is that of a circle in which about 2 k points lie at the mean density. A round keeps the k best of a point by a partial aggregate of each task.
    """
    box = a.select("x", "y").union(b.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    n = b.count()
    if not n or box[2] == n:
        return within_radius(a, b, 1.0).limit(0).withColumn("rank", F.lit(1))
    extent = math.hypot(box[0] or 0.0, box[1] or 0.0) + 1e-9
    first = first or max(math.sqrt(2 * k * max(box[0] or 0.0, extent / 1000) * max(box[1] or 0.0, extent / 1000) / (math.pi * n)), extent * 1e-6)
    radius, rest, out, need = min(first, bound or first), a, None, min(k, n)
    while True:
        last = radius >= min(extent, bound or extent)
        found = within_radius(rest, b, radius)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= k)
        done = ranked if last else ranked.withColumn("n", F.count("*").over(W.partitionBy("a"))).where(F.col("n") >= need).drop("n")
        done = done.persist()
        out = done if out is None else out.union(done)
        if last:
            return out
        rest = rest.join(done.select(F.col("a").alias("id")).distinct(), "id", "left_anti").persist()
        if rest.isEmpty():
            return out
        radius = min(2 * radius, bound) if bound else 2 * radius


def overlapping_regions(zones: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop, zone, distance): stops within a zone's distance to the nearest other zone."""
    own = nearest(zones, zones, 2).where("a <> b").groupBy("a").agg(F.min("distance").alias("r"))
    widest = own.agg(F.max("r")).first()[0]
    if not widest:
        return within_radius(stops, zones, 1.0).limit(0).toDF("stop", "zone", "distance")
    found = within_radius(zones, stops, float(widest)).join(own, "a").where("distance <= r")
    return found.select(F.col("b").alias("stop"), F.col("a").alias("zone"), "distance")


def most_per_zone(connectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of (stop, zone, distance) for each zone, ties by stop."""
    return connectors.withColumn("rank", F.row_number().over(W.partitionBy("zone").orderBy("distance", "stop"))).where(F.col("rank") <= k).drop("rank")


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point is in a closed ring, an array of struct(x, y)."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(pairs, crosses)) % 2 == 1


def points_in_zones(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """(id, zone): points(id, x, y) in polygons zones(zone, ring), met in the cells of each polygon's box."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = zones.select("zone", "ring", F.sequence(F.floor(F.array_min(xs) / size), F.floor(F.array_max(xs) / size)).alias("i"), F.sequence(F.floor(F.array_min(ys) / size), F.floor(F.array_max(ys) / size)).alias("j"))
    cells = box.select("zone", "ring", F.explode("i").alias("cx"), "j").select("zone", "ring", "cx", F.explode("j").alias("cy"))
    return points.select("id", "x", "y", *cell(F.col("x"), F.col("y"), size)).join(cells, ["cx", "cy"]).where(inside_ring(F.col("x"), F.col("y"), F.col("ring"))).select("id", "zone").distinct()


def closest_zone(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """(id, zone): the zone that holds a point, the smallest if several do; else that whose border is nearest, the smallest of equals (to 1e-9).

    Borders are met in cells around them, of `size` at first and twice as large for the points that have met none.
    """
    held = points_in_zones(points, zones, size).groupBy("id").agg(F.min("zone").alias("zone"))
    rest = points.join(held.select("id"), "id", "left_anti")
    sides = zones.select("zone", F.explode(F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q"))).alias("s"))
    sides = sides.select(F.col("zone").alias("link_id"), F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))
    box = rest.select("x", "y").union(sides.select("x1", "y1")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    extent, radius, out = math.hypot(box[0] or 0.0, box[1] or 0.0) + size, size, held
    while not rest.isEmpty():
        near = stops_near_links(rest.select("id", "x", "y"), sides, radius).groupBy("id").agg(F.min(F.struct(F.round("distance", 9).alias("d"), F.col("link_id").alias("zone"))).alias("m"))
        out = out.union(near.select("id", "m.zone"))
        if radius >= extent:
            break
        rest, radius = rest.join(near.select("id"), "id", "left_anti"), 2 * radius
    return out


def length(points: Column) -> Column:
    """Length of a line, an array of struct(x, y)."""
    n = F.size(points)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.hypot(F.get(points, k)["x"] - F.get(points, k - 1)["x"], F.get(points, k)["y"] - F.get(points, k - 1)["y"]))


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance of a point from a segment, and the share of the segment at which it is met."""
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / norm))).otherwise(0.0)
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy)), t


def stops_near_links(stops: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(id, link_id, distance, share) of stops(id, x, y) and segments(link_id, x1, y1, x2, y2) within a radius; a segment is met in the
    cells of its box, so that segments should be short against the radius times a few hundred."""
    box = segments.select("*", F.sequence(F.floor((F.least("x1", "x2") - radius) / radius), F.floor((F.greatest("x1", "x2") + radius) / radius)).alias("i"), F.sequence(F.floor((F.least("y1", "y2") - radius) / radius), F.floor((F.greatest("y1", "y2") + radius) / radius)).alias("j"))
    cells = box.select("link_id", "x1", "y1", "x2", "y2", F.explode("i").alias("cx"), "j").select("link_id", "x1", "y1", "x2", "y2", "cx", F.explode("j").alias("cy"))
    d, t = to_segment(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    found = stops.select("id", "x", "y", *cell(F.col("x"), F.col("y"), radius)).join(cells, ["cx", "cy"])
    return found.select("id", "link_id", d.alias("distance"), t.alias("share")).where(F.col("distance") <= radius)


#: So few stops are sent to all tasks, so that only the cells that hold one are dealt out.
FEW = 50_000


def along(segments: DataFrame, size: float) -> DataFrame:
    """Each segment(x1, y1, x2, y2, ..) once for each cell (cx, cy) that may hold a point within `size` of it, column by column of cells."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    pad, dx = 1.001 * size, x2 - x1
    columns = segments.withColumn("cx", F.explode(F.sequence(F.floor((F.least(x1, x2) - pad) / size), F.floor((F.greatest(x1, x2) + pad) / size))))
    ends = [(F.col("cx") * size - pad - x1) / dx, ((F.col("cx") + 1) * size + pad - x1) / dx]
    share = lambda t, other: F.when(dx == 0, other).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    ya, yb = (y1 + t * (y2 - y1) for t in (share(F.least(*ends), 0.0), share(F.greatest(*ends), 1.0)))
    return columns.withColumn("cy", F.explode(F.sequence(F.floor((F.least(ya, yb) - pad) / size), F.floor((F.greatest(ya, yb) + pad) / size))))


def closest_links(stops: DataFrame, segments: DataFrame, bound: float, tie: float = 0.001) -> DataFrame:
    """(id, distance, n): the least distance of stops(id, x, y) to segments(link_id, x1, y1, x2, y2), if it is bound or less, and the number of
    segments that are as near, to the tie. An id has one place; a repeated id counts its segments as often.

    Rounds of joins of the stops' cells and those along the segments: a stop is done once its least distance and the tie lie within the
    radius, the rest go on with four times the radius. At the first radius some four segments are expected within it, and cells and pairs are
    near in number to stops and segments. Stops at one place, and segments of one course, are met once.
    """
    places = stops.select("x", "y").where(F.abs(F.col("x") + F.col("y")) < math.inf)
    x0, x1, y0, y1, m = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    far, ends = bound + tie, ["x1", "y1", "x2", "y2"]
    courses = segments.where(F.abs(sum(F.col(c) for c in ends)) < math.inf)
    if m:
        courses = courses.where((F.greatest("x1", "x2") >= x0 - far) & (F.least("x1", "x2") <= x1 + far) & (F.greatest("y1", "y2") >= y0 - far) & (F.least("y1", "y2") <= y1 + far))
    n, total = courses.agg(F.count("*"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()
    if not n or not m:
        return stops.select("id", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("n")).limit(0)
    courses = courses.groupBy(*ends).agg(F.count("*").alias("copies")).persist()
    area = max(x1 - x0, (y1 - y0) / 1000) * max(y1 - y0, (x1 - x0) / 1000)
    expected = (math.sqrt(total * total + 4 * math.pi * n * area) - total) / (math.pi * n)
    radius, rest, out = min(far, max(expected, 2 * math.sqrt(area / m), total / (5 * (n + m))) or far), places.distinct(), None
    d, _ = to_segment(*[F.col(c) for c in ("x", "y", *ends)])
    by, left = ["cx", "cy", "x", "y"], m
    while True:
        last, cells, at = radius >= far, along(courses, radius), rest.select("x", "y", *cell(F.col("x"), F.col("y"), radius))
        if left <= FEW:
            cells = cells.join(F.broadcast(at.select("cx", "cy").distinct()), ["cx", "cy"], "left_semi")
        cells = cells.withColumnsRenamed({"cx": "sx", "cy": "sy"})
        met = at.join(cells, (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy")) & (d <= radius), "left").select(*by, "copies", d.alias("distance"))
        near = met.withColumn("least", F.min("distance").over(W.partitionBy(*by))).where(F.col("least").isNull() | (F.col("distance") <= F.col("least") + tie))
        met = near.groupBy(*by).agg(F.min("least").alias("distance"), F.sum("copies").alias("n")).drop("cx", "cy").persist()
        done = met.where(F.col("distance") <= (bound if last else radius - tie))
        out = done if out is None else out.union(done)
        rest = met.where(F.coalesce(F.col("distance") > radius - tie, F.lit(True))).select("x", "y")
        if last or not (left := rest.count()):
            break
        radius = min(4 * radius, far)
    found = stops.select("id", "x", "y").join(out, ["x", "y"])
    return found.groupBy("id").agg(F.min("distance").alias("distance"), F.sum("n").alias("n"))


def _status(stops: DataFrame, found: DataFrame, matched: float, model: float) -> DataFrame:
    status = F.when((F.col("distance") <= matched) & (F.col("n") > 1), "ambiguous").when(F.col("distance") <= matched, "matched").when(F.col("distance") <= model, "near-model").otherwise("outside")
    return stops.select("id").join(found, "id", "left").select("id", status.alias("status"), "distance")


def classify_stops(near: DataFrame, stops: DataFrame, matched: float = 25.0, model: float = 100.0, tie: float = 0.001) -> DataFrame:
    """(id, status, distance): matched within 25 m of a link (ambiguous if two are as near, to a millimetre), near-model within 100 m, else outside."""
    least = near.groupBy("id").agg(F.min("distance").alias("distance"))
    ties = near.join(least.withColumnRenamed("distance", "m"), "id").where(F.col("distance") <= F.col("m") + tie).groupBy("id").agg(F.count("*").alias("n"))
    return _status(stops, least.join(ties, "id"), matched, model)


def status_of_stops(stops: DataFrame, segments: DataFrame, matched: float = 25.0, model: float = 100.0, tie: float = 0.001) -> DataFrame:
    """As classify_stops() of all segments within `model`, but of the closest only: the other pairs are not made."""
    return _status(stops, closest_links(stops, segments, model, tie), matched, model)


def coverage(calls: DataFrame, status: DataFrame) -> DataFrame:
    """(pattern, first, last, kept, decision) of calls(pattern, seq, stop): a pattern keeps its first to its last matched stop."""
    rows = calls.join(status.select(F.col("id").alias("stop"), F.col("status").isin("matched", "ambiguous").alias("ok")), "stop", "left")
    ends = rows.groupBy("pattern").agg(F.min(F.when(F.col("ok"), F.col("seq"))).alias("first"), F.max(F.when(F.col("ok"), F.col("seq"))).alias("last"), F.count_if("ok").alias("kept"), F.count("*").alias("n"))
    inner = F.col("last") - F.col("first") + 1
    decision = F.when(F.col("kept") < 2, "insufficient").when(F.col("kept") < inner, "internal-gap").when(F.col("kept") == F.col("n"), "fully-covered").otherwise("trim-covered")
    return ends.select("pattern", "first", "last", "kept", decision.alias("decision"))


def split_links(links: DataFrame, near: DataFrame, ends: float = 1.0) -> DataFrame:
    """(link_id, seq, start, end) in metres: links(link_id, length) cut at stops' places near(link_id, share), rounded to a metre, off the ends."""
    at = near.join(links.select("link_id", "length"), "link_id").select("link_id", F.round(F.col("share") * F.col("length")).alias("cut"), "length").where((F.col("cut") > ends) & (F.col("cut") < F.col("length") - ends)).select("link_id", "cut").distinct()
    marks = at.union(links.select("link_id", F.lit(0.0))).union(links.select("link_id", "length"))
    by = W.partitionBy("link_id").orderBy("cut")
    return marks.withColumn("end", F.lead("cut").over(by)).where("end is not null").select("link_id", (F.row_number().over(by) - 1).cast("int").alias("seq"), F.col("cut").alias("start"), "end")


def connectors(zones: DataFrame, nodes: DataFrame, k: int = 1, bound: float | None = None, connected: DataFrame | None = None) -> DataFrame:
    """(zone, node, distance): links from each zone to its k nearest nodes; connected(zone) are left out."""
    wanted = zones if connected is None else zones.join(connected.select(F.col("zone").alias("id")), "id", "left_anti")
    return nearest(wanted, nodes, k, bound).select(F.col("a").alias("zone"), F.col("b").alias("node"), "distance")


def spread_targets(zones: DataFrame, quartile: float = 0.75) -> DataFrame:
    """(zone, target): connectors wanted by zones(zone, perimeter, demand): a 625th of the perimeter, 2 to 4, and one more in the top quarter of demand."""
    q = zones.agg(F.percentile("demand", F.lit(quartile)).alias("q"))
    n = F.greatest(F.lit(2), F.least(F.lit(4), F.round(F.col("perimeter") / 625).cast("int")))
    return zones.join(F.broadcast(q)).select("zone", (n + F.when(F.col("demand") >= F.col("q"), 1).otherwise(0)).alias("target"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull of points, counter-clockwise from the least (monotone chain)."""
    ps = sorted(set(points))
    if len(ps) < 3:
        return ps
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for order in (ps, ps[::-1]):
        half: list[tuple[float, float]] = []
        for p in order:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def extent(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Hulls of partitions first, so that the driver sees their corners only."""

    def run(batches):
        import pandas as pd

        kept: list[tuple[float, float]] = []
        for pdf in batches:
            kept = hull(kept + list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        yield pd.DataFrame(kept, columns=["x", "y"])

    return hull([tuple(r) for r in points.select("x", "y").mapInPandas(run, "x double, y double").collect()])


def crossing(segments: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """(link_id, kind) of segments(link_id, x1, y1, x2, y2) against one polygon: inside, outside, or crossing (it meets the border, also where
    both ends are on one side of it)."""
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    a, b = inside_ring(x1, y1, points), inside_ring(x2, y2, points)
    meets = F.lit(False)
    for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
        side = lambda x, y: (qx - px) * (y - py) - (qy - py) * (x - px)  # noqa: B023, E731
        other = lambda x, y: (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        meets = meets | ((side(x1, y1) * side(x2, y2) <= 0) & (other(F.lit(px), F.lit(py)) * other(F.lit(qx), F.lit(qy)) <= 0))
    return segments.select("link_id", F.when(meets, "crossing").when(a & b, "inside").otherwise("outside").alias("kind"))


def mode_connectors(zones: DataFrame, nodes: DataFrame, modes: list[str], k: int = 1) -> DataFrame:
    """(zone, node, distance, modes): for each mode the k nearest nodes(id, x, y, modes) that have it; a pair's modes are joined."""
    out = None
    for m in modes:
        found = nearest(zones, nodes.where(F.contains("modes", F.lit(m))).select("id", "x", "y"), k).select(F.col("a").alias("zone"), F.col("b").alias("node"), "distance", F.lit(m).alias("mode"))
        out = found if out is None else out.union(found)
    return out.groupBy("zone", "node").agg(F.min("distance").alias("distance"), F.array_join(F.array_sort(F.collect_set("mode")), "").alias("modes"))


#: Fixed value: connectors' link type. Links that no connector may end at: motorways by type, or by a capacity of so many vehicles.
MOTORWAY, MOTORWAY_CAPACITY = "(?i)motorway|freeway|autobahn", 50_000.0


def eligible_nodes(nodes: DataFrame, links: DataFrame, mode: str | None = None, types: list[str] | None = None, motorways: bool = True) -> DataFrame:
    """Nodes of nodes(id, ..) at a link(a_node, b_node, modes, link_type, capacity) that has the mode and one of the types, and, without
    motorways, at no motorway."""
    allowed = links if mode is None else links.where(F.contains("modes", F.lit(mode)))
    allowed = allowed if types is None else allowed.where(F.col("link_type").isin(types))
    ends = lambda rows: rows.select(F.explode(F.array("a_node", "b_node")).alias("id")).distinct()
    found = nodes.join(ends(allowed), "id", "left_semi")
    if motorways:
        return found
    return found.join(ends(links.where(F.col("link_type").rlike(MOTORWAY) | (F.col("capacity") >= MOTORWAY_CAPACITY))), "id", "left_anti")


def nearest_in_zone(zones: DataFrame, nodes: DataFrame, k: int, size: float) -> DataFrame:
    """(zone, node, distance): the k nearest nodes(id, x, y) within each zone(zone, ring, x, y) to its centre, ties by node."""
    held = points_in_zones(nodes, zones.select("zone", "ring"), size).join(nodes.select("id", F.col("x").alias("nx"), F.col("y").alias("ny")), "id").join(zones.select("zone", "x", "y"), "zone")
    found = held.select("zone", F.col("id").alias("stop"), F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")).alias("distance"))
    return most_per_zone(found, k).select("zone", F.col("stop").alias("node"), "distance")


def with_connectors(links: DataFrame, pairs: DataFrame, mode: str, link_type: str = "centroid_connector") -> DataFrame:
    """Links(link_id, a_node, b_node, direction, modes, link_type, distance) with connectors for pairs(zone, node, distance): a pair that a connector
    joins already gets the mode added to it, others become links of their own, numbered on by zone and node."""
    old = F.col("link_type") == link_type
    keyed = pairs.select(F.col("zone").alias("a_node"), F.col("node").alias("b_node"), F.col("distance").alias("__d")).dropDuplicates(["a_node", "b_node"])
    more = F.array_join(F.array_sort(F.array_distinct(F.split(F.concat("modes", F.lit(mode)), ""))), "")
    kept = links.join(keyed, ["a_node", "b_node"], "left").withColumn("modes", F.when(old & F.col("__d").isNotNull(), more).otherwise(F.col("modes"))).select(links.columns)
    new = keyed.join(links.where(old).select("a_node", "b_node"), ["a_node", "b_node"], "left_anti")
    top = links.agg(F.max("link_id")).first()[0] or 0
    new = numbered(new, ["a_node", "b_node"], "link_id", top + 1)
    return kept.unionByName(new.select("link_id", "a_node", "b_node", F.lit(0).alias("direction"), F.lit(mode).alias("modes"), F.lit(link_type).alias("link_type"), F.col("__d").alias("distance")))


def clip(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A closed ring's part within a box (Sutherland and Hodgman, 1974), closed; empty where they don't meet."""
    points = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for k, q in enumerate(points):
            p = points[k - 1]
            inside_p, inside_q = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if inside_p != inside_q:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if inside_q:
                out.append(q)
        points = out
    return [*points, points[0]] if len(points) > 2 else []


def area_grid(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """An area cut into tiles of its box, ceil(sqrt(corners / 32)) a side, each clipped to the area."""
    side = max(1, math.ceil(math.sqrt((len(ring) - 1) / 32)))
    x0, y0, x1, y1 = min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring)
    dx, dy = (x1 - x0) / side, (y1 - y0) / side
    tiles = [clip(ring, (x0 + i * dx, y0 + j * dy, x0 + (i + 1) * dx, y0 + (j + 1) * dy)) for i in range(side) for j in range(side)]
    return [t for t in tiles if t]


def ring_area(ring: Column) -> Column:
    """Area of a closed ring, an array of struct(x, y)."""
    n = F.size(ring)
    at = lambda k: F.get(ring, k)
    return F.abs(F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, k: acc + at(k - 1)["x"] * at(k)["y"] - at(k)["x"] * at(k - 1)["y"])) / 2
