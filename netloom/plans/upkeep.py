"""Queries over a graph in pieces (contraction, dead ends, saved graphs) and over edits of a network."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import graph as G
from netloom.operators import spatial as P
from netloom.operators import timetable as T
from netloom.operators import upkeep as U
from netloom.operators.model import RoadGraph, build_graphs
from netloom.plans.network import FLOWS_SQL, WALK_SQL, labels_sql, r6
from netloom.plans.places import DIST, POINTS, _squares, cus, sup
from netloom.plans.registry import query
from netloom.sources import derived as D
from netloom.sources import networks as S
from netloom.sources import system as Y


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """The network with each link in three pieces, and stubs of up to three links hung on the nodes; every fifth stub's last link can only be
    left."""
    k = F.col("k")
    rows = D.links(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    share = F.when(k == 1, 0.5).otherwise(0.25)
    a, b = F.when(k == 0, F.col("a_node")).otherwise(999 + 2 * F.col("link_id") + k), F.when(k == 2, F.col("b_node")).otherwise(1000 + 2 * F.col("link_id") + k)
    cut = rows.select((F.col("link_id") * 3 + k).alias("link_id"), a.cast("long").alias("a_node"), b.cast("long").alias("b_node"), "direction", *[(F.col(c) * share).alias(c) for c in ("distance", "free_flow_time")], "capacity")
    z = D.zones(spark, d).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(3)))).where("j <= zone % 4")
    start = F.when(F.col("j") == 1, F.col("zone")).otherwise(9999 + F.col("zone") * 10 + F.col("j"))
    last = (F.col("zone") % 5 == 0) & (F.col("j") == F.col("zone") % 4)
    stubs = z.select((1000 + F.col("zone") * 10 + F.col("j")).alias("link_id"), start.cast("long").alias("a_node"), (10000 + F.col("zone") * 10 + F.col("j")).cast("long").alias("b_node"), F.when(last, -1).otherwise(0).alias("direction"), F.lit(1.0).alias("distance"), F.lit(0.5).alias("free_flow_time"), F.lit(100.0).alias("capacity"))
    return cut.unionByName(stubs)


PIECES_SQL = f"""{D.LINKS_SQL}, pieces AS (
  SELECT link_id AS whole, k, link_id * 3 + k AS link_id, direction FROM links CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
), stubs AS (
  SELECT 1000 + zone * 10 + j AS link_id, CASE WHEN zone % 5 = 0 AND j = zone % 4 THEN -1 ELSE 0 END AS direction FROM (SELECT n_nationkey + 1 AS zone FROM nation) CROSS JOIN (SELECT unnest([1, 2, 3]) AS j) WHERE j <= zone % 4
), sides AS (SELECT unnest([1, -1]) AS side), stub_edges AS (SELECT link_id, side AS direction FROM stubs CROSS JOIN sides WHERE direction <> -side)"""


def road_graph(spark: SparkSession, d: str) -> RoadGraph:
    return RoadGraph.build(pieces(spark, d), D.zones(spark, d)).with_cost("distance")


@query(f"WITH {PIECES_SQL} SELECT link_id, CAST(direction AS BIGINT) AS direction FROM stub_edges")
def dead_end_links(spark: SparkSession, d: str) -> DataFrame:
    return G.dead_ends(G.directed(pieces(spark, d)), D.zones(spark, d)).select("link_id", F.col("direction").cast("long").alias("direction"))


@query(f"WITH {PIECES_SQL} SELECT link_id, whole * 3 AS chain, CAST(k AS INTEGER) AS seq, CAST(1 AS INTEGER) AS way FROM pieces")
def chain_compression(spark: SparkSession, d: str) -> DataFrame:
    return road_graph(spark, d).crosswalk


@query(f"WITH {PIECES_SQL} SELECT link_id * 3 AS chain, CAST(direction AS BIGINT) AS direction, tail, head, round(distance, 6) AS distance FROM edges")
def compressed_cost(spark: SparkSession, d: str) -> DataFrame:
    return road_graph(spark, d).contracted("distance").select(F.col("link_id").alias("chain"), F.col("direction").cast("long").alias("direction"), "tail", "head", *r6("distance"))


@query(f"""WITH {PIECES_SQL}, e AS (SELECT p.link_id, side AS direction, whole * 3 AS chain, side AS chain_direction FROM pieces p CROSS JOIN sides WHERE p.direction <> -side)
SELECT link_id, CAST(direction AS BIGINT) AS direction, chain, CAST(chain_direction AS BIGINT) AS chain_direction FROM e UNION ALL SELECT link_id, direction, (SELECT max(chain) + 1 FROM e), 0 FROM stub_edges""")
def graph_correspondence(spark: SparkSession, d: str) -> DataFrame:
    return road_graph(spark, d).correspondence().select("link_id", F.col("direction").cast("long").alias("direction"), "chain", F.col("chain_direction").cast("long").alias("chain_direction"))


@query(f"""{FLOWS_SQL}, f AS (SELECT link_id, direction, sum(trips) AS v FROM walk JOIN od USING (origin, destination) GROUP BY ALL)
SELECT link_id * 3 + k AS link_id, CAST(direction AS BIGINT) AS direction, round(v, 6) AS trips FROM f CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)""")
def contracted_flows(spark: SparkSession, d: str) -> DataFrame:
    """Demand on contracted edges, spread back to the pieces."""
    return road_graph(spark, d).load(D.demand(spark, d), ["trips"]).select("link_id", F.col("direction").cast("long").alias("direction"), *r6("trips"))


@query(f"""WITH RECURSIVE {D.LINKS_SQL}, {labels_sql()}, {WALK_SQL}
SELECT origin, destination, string_agg(CAST(link_id * direction AS VARCHAR), ',' ORDER BY cost) AS links, origin || ',' || string_agg(CAST(node AS VARCHAR), ',' ORDER BY cost) AS nodes FROM walk GROUP BY origin, destination
UNION ALL SELECT n_nationkey + 1, n_nationkey + 1, '', CAST(n_nationkey + 1 AS VARCHAR) FROM nation""")
def path_traces(spark: SparkSession, d: str) -> DataFrame:
    z = D.zones(spark, d)
    pairs = z.select(F.col("zone").alias("origin"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(25).cast("long"))).alias("destination"))
    found = RoadGraph.build(D.links(spark, d), z).with_cost("distance").paths(pairs)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("origin", "destination", text("links"), text("nodes"))


@query(f"WITH {D.LINKS_SQL}, {labels_sql()} SELECT origin, node AS destination, round(cost, 6) AS cost, round(cost / 2, 6) AS free_flow_time FROM sp")
def saved_graph_skims(spark: SparkSession, d: str) -> DataFrame:
    """A contracted graph, saved, read again and skimmed."""
    G.checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/graph-{uuid.uuid4().hex[:12]}"
    road_graph(spark, d).with_skims("free_flow_time").save(path)
    return RoadGraph.read(spark, path).skims().select("origin", "destination", *r6("cost", "free_flow_time"))


@query("SELECT unnest(['capacity', 'distance', 'free_flow_time']) AS field")
def available_skims(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in road_graph(spark, d).available_skims()], "field string")


@query(f"WITH {D.LINKS_SQL}, m AS (SELECT e.*, CASE WHEN link_id % 3 = 0 THEN 'ct' WHEN link_id % 3 = 1 THEN 'c' ELSE 'tw' END AS modes FROM edges e) SELECT mode, link_id, CAST(direction AS BIGINT) AS direction, tail, head FROM m JOIN (SELECT unnest(['c', 't', 'w']) AS mode) k ON contains(m.modes, k.mode) WHERE link_id % 7 <> 0")
def mode_graphs(spark: SparkSession, d: str) -> DataFrame:
    links = D.links(spark, d).withColumn("modes", F.when(F.col("link_id") % 3 == 0, "ct").when(F.col("link_id") % 3 == 1, "c").otherwise("tw"))
    gone = [r[0] for r in links.where("link_id % 7 = 0").select("link_id").collect()]
    out = None
    for mode, g in build_graphs(links, D.zones(spark, d), ["c", "t", "w"], ("distance",)).items():
        one = g.without(gone).edges.select(F.lit(mode).alias("mode"), "link_id", F.col("direction").cast("long").alias("direction"), "tail", "head")
        out = one if out is None else out.union(one)
    return out


ROADS_SQL = """roads AS (SELECT o_orderkey AS link_id, o_custkey AS a_node, 100000 + o_orderkey % 997 AS b_node, 0 AS direction, CAST(o_orderkey % 100 AS DOUBLE) AS distance FROM orders),
ends AS (SELECT a_node AS node FROM roads UNION SELECT b_node FROM roads), places AS (SELECT node, node % 10 = 0 AS is_centroid, CAST(node * 31 % 10007 AS DOUBLE) AS x, CAST(node AS DOUBLE) AS y FROM ends)"""


def _roads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    roads = D.table(spark, d, "orders").select(k.alias("link_id"), F.col("o_custkey").alias("a_node"), (100_000 + k % 997).alias("b_node"), F.lit(0).alias("direction"), (k % 100).cast("double").alias("distance"))
    nodes = roads.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
    return roads, nodes.select("node", (F.col("node") % 10 == 0).alias("is_centroid"), (F.col("node") * 31 % 10007).cast("double").alias("x"), F.col("node").cast("double").alias("y"))


@query(f"WITH {ROADS_SQL}, l AS (SELECT * FROM roads WHERE link_id % 3 <> 0 AND a_node % 4 <> 0) SELECT node FROM places WHERE is_centroid OR node IN (SELECT a_node FROM l UNION SELECT b_node FROM l)")
def nodes_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    roads, nodes = _roads(spark, d)
    return U.delete_links(roads, nodes, roads.where("link_id % 3 = 0 or a_node % 4 = 0"))[1].select("node")


@query(f"WITH {ROADS_SQL} SELECT link_id, a_node, b_node, distance FROM roads UNION ALL SELECT (SELECT max(link_id) FROM roads) + row_number() OVER (ORDER BY link_id), a_node, b_node, distance FROM roads WHERE link_id % 50 = 0")
def links_copied(spark: SparkSession, d: str) -> DataFrame:
    roads, _ = _roads(spark, d)
    return U.copy_links(roads, roads.where("link_id % 50 = 0")).select("link_id", "a_node", "b_node", "distance")


@query(f"WITH {ROADS_SQL} SELECT link_id, CASE WHEN a_node % 2 = 0 THEN a_node + 1000000 ELSE a_node END AS a_node, CASE WHEN b_node % 2 = 0 THEN b_node + 1000000 ELSE b_node END AS b_node FROM roads")
def nodes_renumbered(spark: SparkSession, d: str) -> DataFrame:
    roads, nodes = _roads(spark, d)
    new = nodes.where("node % 2 = 0").select("node", (F.col("node") + 1_000_000).alias("to"))
    return U.renumber_nodes(nodes, roads, new)[1].select("link_id", "a_node", "b_node")


@query(f"""WITH {ROADS_SQL}, m AS (SELECT node, CASE WHEN node % 3 = 0 THEN x + 0.5 ELSE x END AS x, CASE WHEN node % 3 = 0 THEN y + 0.25 ELSE y END AS y FROM places)
SELECT link_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM roads JOIN m a ON a.node = a_node JOIN m b ON b.node = b_node""")
def nodes_moved(spark: SparkSession, d: str) -> DataFrame:
    roads, nodes = _roads(spark, d)
    lines = roads
    for end, k in (("a_node", 1), ("b_node", 2)):
        lines = lines.join(nodes.select(F.col("node").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), end)
    places = nodes.where("node % 3 = 0").select("node", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"))
    return U.move_nodes(nodes, lines, places)[1].select("link_id", *r6("distance"))


@query(f"WITH {ROADS_SQL} SELECT 'links' AS what, count(*) AS n FROM roads UNION ALL SELECT 'nodes', count(*) FROM places UNION ALL SELECT 'centroids', count(*) FROM places WHERE is_centroid")
def network_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.counts(*_roads(spark, d))


@query("SELECT p_partkey AS link_id, replace(replace('abc', 'b', ''), 'x', '') || CASE WHEN p_size % 2 = 0 THEN 'd' ELSE '' END AS modes FROM part")
def modes_deleted(spark: SparkSession, d: str) -> DataFrame:
    links = D.table(spark, d, "part").select(F.col("p_partkey").alias("link_id"), F.when(F.col("p_size") % 2 == 0, "abcd").otherwise("abc").alias("modes"))
    return U.delete_modes(spark.createDataFrame([(m,) for m in "abcdx"], "mode string"), links, ["b", "x"])[1]


@query(f"""{POINTS}, z AS (SELECT k + 1 AS zone, (k % 5) * 100 + 0.37 AS x0, (k // 5) * 100 + 0.41 AS y0 FROM (SELECT unnest(range(25)) AS k)),
r AS (SELECT zone, id AS node, sqrt(pow(x - x0 - 50, 2) + pow(y - y0 - 50, 2)) AS dist FROM cus JOIN z ON x > x0 AND x < x0 + 100 AND y > y0 AND y < y0 + 100),
k AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY dist, node) AS rk FROM r) SELECT zone, node, round(dist, 6) AS distance FROM k WHERE rk <= 3""")
def nearest_in_zone(spark: SparkSession, d: str) -> DataFrame:
    z = _squares(spark).select("*", (F.col("ring")[0]["x"] + 50).alias("x"), (F.col("ring")[0]["y"] + 50).alias("y"))
    return P.nearest_in_zone(z, cus(spark, d), 3, 100.0).select("zone", "node", *r6("distance"))


_TYPED_SQL = """typed AS (SELECT l_orderkey * 10 + l_linenumber AS link_id, l_partkey AS a_node, l_suppkey AS b_node, CASE l_linenumber % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'cw' ELSE 'w' END AS modes,
  CASE WHEN l_orderkey % 2000 = 0 THEN 'motorway' WHEN l_orderkey % 2 = 0 THEN 'street' ELSE 'path' END AS link_type, CAST(CASE WHEN l_orderkey % 3000 = 1 THEN 60000 ELSE 800 END AS DOUBLE) AS capacity FROM lineitem)"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(k % 2000 == 0, "motorway").when(k % 2 == 0, "street").otherwise("path")
    return D.table(spark, d, "lineitem").select((k * 10 + n).alias("link_id"), F.col("l_partkey").alias("a_node"), F.col("l_suppkey").alias("b_node"), F.when(n % 3 == 0, "c").when(n % 3 == 1, "cw").otherwise("w").alias("modes"), kind.alias("link_type"), F.when(k % 3000 == 1, 60000.0).otherwise(800.0).alias("capacity"))


@query(f"""WITH {_TYPED_SQL}, ok AS (SELECT * FROM typed WHERE contains(modes, 'c') AND link_type IN ('street', 'motorway')), bad AS (SELECT * FROM typed WHERE link_type = 'motorway' OR capacity >= 50000)
SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey IN (SELECT a_node FROM ok UNION SELECT b_node FROM ok) AND p_partkey NOT IN (SELECT a_node FROM bad UNION SELECT b_node FROM bad)""")
def eligible_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = D.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return P.eligible_nodes(nodes, _typed(spark, d), "c", ["street", "motorway"], motorways=False)


@query(f"""{POINTS}, n AS (SELECT a.id AS zone, b.id AS node, {DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rk FROM sup a CROSS JOIN cus b),
p AS (SELECT zone, node, dist FROM n WHERE rk <= 2), old AS (SELECT zone * 10 + rk AS link_id, zone, node, dist FROM n WHERE rk IN (1, 3))
SELECT link_id, o.zone AS a_node, o.node AS b_node, CASE WHEN p.zone IS NULL THEN 'w' ELSE 'cw' END AS modes, round(o.dist, 6) AS distance FROM old o LEFT JOIN p ON p.zone = o.zone AND p.node = o.node
UNION ALL SELECT (SELECT max(link_id) FROM old) + row_number() OVER (ORDER BY p.zone, p.node), p.zone, p.node, 'c', round(p.dist, 6) FROM p LEFT JOIN old o ON p.zone = o.zone AND p.node = o.node WHERE o.zone IS NULL""")
def connectors_inserted(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest nodes of each zone joined for cars, where the nearest and the third are joined for walkers already."""
    near = P.nearest(sup(spark, d), cus(spark, d), 3)
    links = near.where("rank <> 2").select((F.col("a") * 10 + F.col("rank")).alias("link_id"), F.col("a").alias("a_node"), F.col("b").alias("b_node"), F.lit(0).alias("direction"), F.lit("w").alias("modes"), F.lit("centroid_connector").alias("link_type"), "distance")
    pairs = near.where("rank <= 2").select(F.col("a").alias("zone"), F.col("b").alias("node"), "distance")
    return P.with_connectors(links, pairs, "c").select("link_id", "a_node", "b_node", "modes", *r6("distance"))


@query(f"WITH {D.SCHEDULE_SQL}, p AS (SELECT trip, seq, stop, lead(stop) OVER (PARTITION BY trip ORDER BY seq) AS next FROM schedule), k AS (SELECT *, row_number() OVER (PARTITION BY trip, stop, next ORDER BY seq) AS rn FROM p WHERE next IS NOT NULL) SELECT trip, seq, stop, next FROM k WHERE rn = 1")
def stop_pairs(spark: SparkSession, d: str) -> DataFrame:
    return T.stop_pairs(D.schedule(spark, d))


@query(f"WITH {D.SCHEDULE_SQL}, f AS (SELECT pattern, trip, arg_min(departure, seq) AS first FROM schedule GROUP BY pattern, trip) SELECT pattern, trip, row_number() OVER (PARTITION BY pattern ORDER BY first, trip) - 1 AS position FROM f")
def trips_in_order(spark: SparkSession, d: str) -> DataFrame:
    return T.in_order(D.schedule(spark, d))


@query("SELECT p_partkey AS link_id, CASE p_size % 4 WHEN 0 THEN 'ct' WHEN 1 THEN 'b' WHEN 2 THEN 'bctw' ELSE 'bctw' END AS modes FROM part")
def highway_modes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 4
    links = D.table(spark, d, "part").select(F.col("p_partkey").alias("link_id"), F.when(n == 0, "motorway").when(n == 1, "cycleway").when(n == 2, "primary").otherwise("unknown_road").alias("link_type"))
    return S.highway_modes(links).select("link_id", "modes")


@query("""WITH RECURSIVE g AS (SELECT DISTINCT 'u' || (c_custkey % 40) AS use, CASE WHEN c_custkey % 3 = 0 THEN 'u' || (c_custkey % 40 + 1 + c_nationkey % 3) ELSE 'm' || c_nationkey END AS part FROM customer),
w AS (SELECT use, part FROM g UNION SELECT w.use, g.part FROM w JOIN g ON g.use = w.part) SELECT DISTINCT use, part AS mode FROM w WHERE part NOT IN (SELECT use FROM g)""")
def use_groups_expanded(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    part = F.when(k % 3 == 0, F.concat(F.lit("u"), (k % 40 + 1 + n % 3).cast("string"))).otherwise(F.concat(F.lit("m"), n.cast("string")))
    return S.expand_uses(D.table(spark, d, "customer").select(F.concat(F.lit("u"), (k % 40).cast("string")).alias("use"), part.alias("part")))


@query("""WITH l AS (SELECT l_orderkey AS link_id, l_partkey AS a_node, l_suppkey AS b_node, CASE WHEN l_orderkey % 500 = 0 THEN '' ELSE 'c' END AS modes, CAST(l_quantity - 1 AS DOUBLE) AS distance FROM lineitem WHERE l_linenumber = 1), n AS (SELECT p_partkey AS node FROM part WHERE p_size <> 7)
SELECT DISTINCT 'link without a node' AS problem, CAST(link_id AS VARCHAR) AS key, 'error' AS severity FROM l WHERE a_node NOT IN (SELECT node FROM n) OR b_node NOT IN (SELECT node FROM n)
UNION ALL SELECT 'repeated link', CAST(link_id AS VARCHAR), 'error' FROM l GROUP BY link_id HAVING count(*) > 1
UNION ALL SELECT 'link without a mode', CAST(link_id AS VARCHAR), 'warning' FROM l WHERE modes = '' UNION ALL SELECT 'link without a length', CAST(link_id AS VARCHAR), 'warning' FROM l WHERE distance <= 0
UNION ALL SELECT 'link to its own node', CAST(link_id AS VARCHAR), 'warning' FROM l WHERE a_node = b_node UNION ALL SELECT 'node without a link', CAST(node AS VARCHAR), 'warning' FROM n WHERE node NOT IN (SELECT a_node FROM l UNION SELECT b_node FROM l)""")
def layer_problems(spark: SparkSession, d: str) -> DataFrame:
    li = D.table(spark, d, "lineitem").where("l_linenumber = 1")
    links = li.select(F.col("l_orderkey").alias("link_id"), F.col("l_partkey").alias("a_node"), F.col("l_suppkey").alias("b_node"), F.when(F.col("l_orderkey") % 500 == 0, "").otherwise("c").alias("modes"), (F.col("l_quantity") - 1).alias("distance"))
    return S.layer_problems(links, D.table(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("node")))


@query(f"WITH {D.LINKS_SQL} SELECT o_orderkey AS pattern, CAST(s AS BIGINT) AS seq, l.link_id, round(l.distance, 6) AS distance FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) JOIN links l ON l.link_id = (o_orderkey + s * 5) % (SELECT count(*) FROM links) + 1")
def route_link_distances(spark: SparkSession, d: str) -> DataFrame:
    links = D.links(spark, d)
    n = links.count()
    steps = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("pattern"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("seq"))
    steps = steps.withColumn("link_id", (F.col("pattern") + F.col("seq") * 5) % n + 1).withColumn("distance", F.lit(0.0))
    return U.route_link_distances(steps, links).select("pattern", "seq", "link_id", *r6("distance"))


_CALLS_SQL = f"""WITH {D.SCHEDULE_SQL}, c AS (SELECT pattern AS route, trip, list(stop ORDER BY seq, stop) AS calls FROM schedule GROUP BY ALL),
p AS (SELECT route, calls, count(*) AS n_trips, row_number() OVER (ORDER BY route, calls) AS pattern_id FROM c GROUP BY route, calls)"""


def _system(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The derived timetable as a system, saved and read again."""
    G.checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/system-{uuid.uuid4().hex[:12]}"
    stops = spark.range(40).select(F.col("id").alias("stop"), (F.col("id") * 37.5 % 500).alias("x"), (F.col("id") * 71.25 % 500).alias("y"), F.concat(F.lit("stop "), F.col("id").cast("string")).alias("name"))
    Y.save_system(Y.system_of(D.schedule(spark, d), stops, _squares(spark)), path)
    return Y.read_system(spark, path)


@query(f"{_CALLS_SQL} SELECT pattern_id, dense_rank() OVER (ORDER BY route) AS route_id, n_trips, len(calls) AS n_stops FROM p")
def transit_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _system(spark, d)["patterns"].select("pattern_id", "route_id", "n_trips", F.col("n_stops").cast("long").alias("n_stops"))


@query(f"{_CALLS_SQL} SELECT pattern_id, s.trip, CAST(seq AS BIGINT) AS seq, stop, CAST(arrival AS BIGINT) AS arrival, CAST(departure AS BIGINT) AS departure FROM schedule s JOIN c ON c.trip = s.trip AND c.route = s.pattern JOIN p ON p.route = c.route AND p.calls = c.calls")
def transit_system_calls(spark: SparkSession, d: str) -> DataFrame:
    return Y.calls_of(_system(spark, d)).select("pattern_id", "trip", *[F.col(c).cast("long").alias(c) for c in ("seq", "stop", "arrival", "departure")])


@query(f"""WITH {D.SCHEDULE_SQL} SELECT trip AS trip_id, lpad(CAST(arrival // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(arrival // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(arrival % 60 AS VARCHAR), 2, '0') AS arrival_time, stop AS stop_id, CAST(seq AS BIGINT) AS stop_sequence FROM schedule""")
def feed_stop_times(spark: SparkSession, d: str) -> DataFrame:
    return Y.feed_tables(_system(spark, d))["stop_times"].select("trip_id", "arrival_time", "stop_id", F.col("stop_sequence").cast("long").alias("stop_sequence"))


@query("""WITH s AS (SELECT k AS stop, (k * 37.5) % 500 AS x, (k * 71.25) % 500 AS y FROM (SELECT unnest(range(40)) AS k)), z AS (SELECT k + 1 AS zone, (k % 5) * 100 + 0.37 AS x0, (k // 5) * 100 + 0.41 AS y0 FROM (SELECT unnest(range(25)) AS k)),
r AS (SELECT stop, zone, round(sqrt(pow(greatest(x0 - x, 0, x - x0 - 100), 2) + pow(greatest(y0 - y, 0, y - y0 - 100), 2)), 9) AS dist FROM s CROSS JOIN z) SELECT stop, CAST(arg_min(zone, (dist, zone)) AS BIGINT) AS zone FROM r GROUP BY stop""")
def stop_zones(spark: SparkSession, d: str) -> DataFrame:
    return _system(spark, d)["stops"].select("stop", "zone")
