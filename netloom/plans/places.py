"""Queries over points, stops and network upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import scalars as C
from netloom.operators import network as N
from netloom.operators import spatial as P
from netloom.plans.network import DELAUNAY_SQL, r6, scattered
from netloom.plans.registry import query
from netloom.sources import derived as D

POINTS = f"WITH {D.points_sql('sup', 'supplier', 's_suppkey')}, {D.points_sql('cus', 'customer', 'c_custkey')}"
DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"


def sup(spark: SparkSession, d: str) -> DataFrame:
    return D.points(spark, d, "supplier", "s_suppkey")


def cus(spark: SparkSession, d: str) -> DataFrame:
    return D.points(spark, d, "customer", "c_custkey")


@query(f"{POINTS}, r AS (SELECT a.id AS zone, b.id AS node, {DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rk FROM sup a CROSS JOIN cus b) SELECT zone, node, round(dist, 6) AS distance FROM r WHERE rk <= 3")
def knn_connectors(spark: SparkSession, d: str) -> DataFrame:
    return P.connectors(sup(spark, d), cus(spark, d), 3).select("zone", "node", *r6("distance"))


@query(f"{POINTS} SELECT a.id AS a, b.id AS b, round({DIST}, 6) AS distance FROM sup a CROSS JOIN cus b WHERE {DIST} <= 20")
def radius_connectors(spark: SparkSession, d: str) -> DataFrame:
    return P.within_radius(sup(spark, d), cus(spark, d), 20.0).select("a", "b", *r6("distance"))


@query(f"{POINTS}, r AS (SELECT a.id AS zone, b.id AS stop, {DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rk FROM sup a CROSS JOIN cus b WHERE {DIST} <= 60) SELECT zone, stop, round(dist, 6) AS distance FROM r WHERE rk <= 4")
def max_connectors_per_zone(spark: SparkSession, d: str) -> DataFrame:
    near = P.nearest(sup(spark, d), cus(spark, d), 4, bound=60.0)
    return near.select(F.col("a").alias("zone"), F.col("b").alias("stop"), *r6("distance"))


@query(f"{POINTS}, r AS (SELECT a.id, min({DIST}) AS r FROM sup a JOIN sup b ON a.id <> b.id GROUP BY a.id) SELECT b.id AS stop, a.id AS zone, round({DIST}, 6) AS distance FROM sup a JOIN r USING (id) CROSS JOIN cus b WHERE {DIST} <= r.r")
def overlap_regions(spark: SparkSession, d: str) -> DataFrame:
    return P.overlapping_regions(sup(spark, d), cus(spark, d)).select("stop", "zone", *r6("distance"))


@query(f"{POINTS}, r AS (SELECT a.id, b.id AS zone, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rk FROM cus a CROSS JOIN sup b) SELECT id, zone FROM r WHERE rk = 1")
def nearest_zone(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest(cus(spark, d), sup(spark, d)).select(F.col("a").alias("id"), F.col("b").alias("zone"))


def _squares(spark: SparkSession) -> DataFrame:
    """Twenty-five slanted zones of a square of 500."""
    i, j = F.col("id") % 5 * 100 + 0.37, F.floor(F.col("id") / 5) * 100 + 0.41
    corner = lambda a, b: F.struct((i + a).alias("x"), (j + b).alias("y"))
    return spark.range(25).select((F.col("id") + 1).alias("zone"), F.array(corner(0, 0), corner(100, 0), corner(100, 100), corner(0, 100), corner(0, 0)).alias("ring"))


@query(f"{POINTS} SELECT id, CAST(floor((x - 0.37) / 100) + 5 * floor((y - 0.41) / 100) + 1 AS BIGINT) AS zone FROM cus WHERE x - 0.37 BETWEEN 0 AND 500 AND y - 0.41 BETWEEN 0 AND 500")
def point_in_zone(spark: SparkSession, d: str) -> DataFrame:
    return P.points_in_zones(cus(spark, d), _squares(spark), 100.0)


@query(f"{POINTS} SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cus")
def network_extent(spark: SparkSession, d: str) -> DataFrame:
    return P.extent(cus(spark, d))


@query()
def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(P.convex_hull(cus(spark, d)), "x double, y double")


SEG_SQL = "seg AS (SELECT id AS link_id, x AS x1, y AS y1, x + 40 AS x2, y + (id % 7) * 5 AS y2 FROM sup)"
NEAR_SQL = f"""{SEG_SQL}, t AS (SELECT c.id, link_id, x1, y1, x2, y2, x, y, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS share FROM cus c CROSS JOIN seg),
near AS (SELECT id, link_id, sqrt(pow(x - (x1 + share * (x2 - x1)), 2) + pow(y - (y1 + share * (y2 - y1)), 2)) AS dist, share FROM t)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return sup(spark, d).select(F.col("id").alias("link_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 40).alias("x2"), (F.col("y") + F.col("id") % 7 * 5).alias("y2"))


@query(f"{POINTS}, {NEAR_SQL} SELECT id, link_id, round(dist, 6) AS distance, round(share, 6) AS share FROM near WHERE dist <= 30")
def stops_near_links(spark: SparkSession, d: str) -> DataFrame:
    return P.stops_near_links(cus(spark, d), _segments(spark, d), 30.0).select("id", "link_id", *r6("distance", "share"))


@query(f"""{POINTS}, {NEAR_SQL}, m AS (SELECT id, min(dist) AS dm FROM near WHERE dist <= 100 GROUP BY id), n AS (SELECT id, count(*) AS n FROM near JOIN m USING (id) WHERE dist <= dm + 0.001 GROUP BY id)
SELECT c.id, CASE WHEN dm <= 25 AND n > 1 THEN 'ambiguous' WHEN dm <= 25 THEN 'matched' WHEN dm <= 100 THEN 'near-model' ELSE 'outside' END AS status, round(dm, 6) AS distance FROM cus c LEFT JOIN m USING (id) LEFT JOIN n USING (id)""")
def stop_status(spark: SparkSession, d: str) -> DataFrame:
    return P.status_of_stops(cus(spark, d), _segments(spark, d)).select("id", "status", *r6("distance"))


@query(f"""{POINTS}, {NEAR_SQL}, m AS (SELECT id, min(dist) AS dm FROM near WHERE dist <= 100 GROUP BY id), n AS (SELECT id, count(*) AS n FROM near JOIN m USING (id) WHERE dist <= dm + 0.001 GROUP BY id)
SELECT CASE WHEN dm <= 25 AND n > 1 THEN 'ambiguous' WHEN dm <= 25 THEN 'matched' WHEN dm <= 100 THEN 'near-model' ELSE 'outside' END AS status, count(*) AS n FROM cus c LEFT JOIN m USING (id) LEFT JOIN n USING (id) GROUP BY 1""")
def stop_status_counts(spark: SparkSession, d: str) -> DataFrame:
    from netloom.operators.timetable import histogram

    return histogram(P.status_of_stops(cus(spark, d), _segments(spark, d)), "status")


@query(f"""{POINTS}, {NEAR_SQL}, m AS (SELECT id, min(dist) AS dm FROM near GROUP BY id), c AS (SELECT id % 100 AS pattern, id // 100 AS seq, dm <= 25 AS ok FROM m),
e AS (SELECT pattern, min(seq) FILTER (WHERE ok) AS f, max(seq) FILTER (WHERE ok) AS l, count(*) FILTER (WHERE ok) AS kept, count(*) AS n FROM c GROUP BY pattern)
SELECT pattern, f AS "first", l AS "last", kept, CASE WHEN kept < 2 THEN 'insufficient' WHEN kept < l - f + 1 THEN 'internal-gap' WHEN kept = n THEN 'fully-covered' ELSE 'trim-covered' END AS decision FROM e""")
def coverage_decision(spark: SparkSession, d: str) -> DataFrame:
    stops = cus(spark, d)
    status = P.status_of_stops(stops, _segments(spark, d))
    calls = stops.select((F.col("id") % 100).alias("pattern"), F.floor(F.col("id") / 100).alias("seq"), F.col("id").alias("stop"))
    return P.coverage(calls, status)


@query(f"{POINTS}, {NEAR_SQL}, ok AS (SELECT DISTINCT link_id, round(share * 200) AS cut FROM near WHERE dist <= 10), k AS (SELECT link_id, cut FROM ok WHERE cut > 1 AND cut < 199 UNION ALL SELECT link_id, 0 FROM seg UNION ALL SELECT link_id, 200 FROM seg), w AS (SELECT link_id, cut, lead(cut) OVER (PARTITION BY link_id ORDER BY cut) AS e, row_number() OVER (PARTITION BY link_id ORDER BY cut) - 1 AS seq FROM k) SELECT link_id, CAST(seq AS INTEGER) AS seq, CAST(cut AS DOUBLE) AS start, CAST(e AS DOUBLE) AS \"end\" FROM w WHERE e IS NOT NULL")
def split_links(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d)
    near = P.stops_near_links(cus(spark, d), seg, 10.0)
    return P.split_links(seg.select("link_id", F.lit(200.0).alias("length")), near)


@query("SELECT s_suppkey AS zone, CAST(greatest(2, least(4, round((s_suppkey * 37 % 3000) / 625.0))) + CASE WHEN abs(s_acctbal) >= (SELECT quantile_cont(abs(s_acctbal), 0.75) FROM supplier) THEN 1 ELSE 0 END AS INTEGER) AS target FROM supplier")
def spread_targets(spark: SparkSession, d: str) -> DataFrame:
    z = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("zone"), (F.col("s_suppkey") * 37 % 3000).cast("double").alias("perimeter"), F.abs("s_acctbal").alias("demand"))
    return P.spread_targets(z)


@query("SELECT p_partkey AS id, round(2 * 6367000.0 * asin(sqrt(pow(sin(radians(dlat) / 2), 2) + cos(radians(lat)) * cos(radians(lat + dlat)) * pow(sin(radians(dlon) / 2), 2))), 4) AS metres FROM (SELECT p_partkey, CAST(p_partkey % 80 AS DOUBLE) AS lat, CAST(p_size AS DOUBLE) / 10 AS dlat, CAST(p_partkey % 13 AS DOUBLE) / 10 AS dlon FROM part)")
def haversine_distance(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 80).cast("double").alias("lat"), (F.col("p_size") / 10).alias("dlat"), (F.col("p_partkey") % 13 / 10).alias("dlon"))
    return p.select(F.col("p_partkey").alias("id"), F.round(C.haversine(F.lit(0.0), F.col("lat"), F.col("dlon"), F.col("lat") + F.col("dlat")), 4).alias("metres"))


@query("SELECT p_partkey AS id, round(degrees(atan2(abs(CAST(p_size AS DOUBLE) - 25.5), abs(CAST(p_partkey % 50 AS DOUBLE) - 20))), 6) AS bearing FROM part")
def line_bearing(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(C.bearing(F.lit(20.0), F.lit(25.5), (F.col("p_partkey") % 50).cast("double"), F.col("p_size").cast("double")), 6).alias("bearing"))


@query("SELECT o_orderkey AS id, CAST((o_orderkey % 27) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 53 AS INTEGER) AS seconds FROM orders")
def time_to_seconds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(k.alias("id"), C.to_seconds(F.format_string("%02d:%02d:%02d", k % 27, k % 60, k % 53)).alias("seconds"))


@query("SELECT o_orderkey AS id, CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, ' ELSE (s // 86400) || ' days, ' END || CAST(s % 86400 // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT o_orderkey, o_orderkey * 7 % 200000 AS s FROM orders)")
def time_string(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.to_time_string(F.col("o_orderkey") * 7 % 200000).alias("clock"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN round(p_size * 1000.0, 6) WHEN 1 THEN round(CAST(p_size AS DOUBLE), 6) ELSE round(CAST(p_size AS DOUBLE), 6) END AS metres, round(p_size / 60.0, 6) AS minutes FROM part")
def visum_units(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "part").withColumn("t", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("km"), F.lit("m"), F.lit(" meters")), (F.col("p_partkey") % 3 + 1).cast("int"))))
    return p.select(F.col("p_partkey").alias("id"), F.round(C.with_unit(F.col("t"), "length"), 6).alias("metres"), F.round(C.with_unit(F.concat(F.col("p_size").cast("string"), F.lit("s")), "time"), 6).alias("minutes"))


MODES_SQL = "ml AS (SELECT p_partkey AS link_id, p_partkey % 50 AS a_node, p_size AS b_node, substr(lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), 1, 4) AS modes, substr(p_brand, 1, 1) AS link_type FROM part), ch AS (SELECT *, unnest(string_split(modes, '')) AS m FROM ml)"


def _mode_links(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("link_id"), (F.col("p_partkey") % 50).alias("a_node"), F.col("p_size").cast("long").alias("b_node"), F.substring(F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), 1, 4).alias("modes"), F.substring("p_brand", 1, 1).alias("link_type"))


@query(f"WITH {MODES_SQL} SELECT a_node, CAST(b_node AS BIGINT) AS b_node, string_agg(DISTINCT m, '' ORDER BY m) AS modes FROM ch WHERE m <> '' GROUP BY a_node, b_node")
def mode_union(spark: SparkSession, d: str) -> DataFrame:
    return N.mode_union(_mode_links(spark, d))


@query(f"WITH {MODES_SQL}, e AS (SELECT a_node AS node, m, link_type FROM ch UNION ALL SELECT b_node, m, link_type FROM ch) SELECT node, string_agg(DISTINCT m, '' ORDER BY m) AS modes, string_agg(DISTINCT link_type, '' ORDER BY link_type) AS link_types FROM e WHERE m <> '' GROUP BY node")
def node_modes(spark: SparkSession, d: str) -> DataFrame:
    return N.node_modes(_mode_links(spark, d))


GM_SQL = "g AS (SELECT p_partkey AS link_id, p_partkey % 20 AS f, (p_partkey * 7 + p_size) % 20 AS t, CAST(1 + p_size % 3 AS DOUBLE) AS lanes, CAST(p_size * 100 AS DOUBLE) AS capacity FROM part), gm AS (SELECT * FROM g WHERE f <> t)"


def _gmns(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("link_id"), (F.col("p_partkey") % 20).alias("from_node"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 20).alias("to_node"), (1 + F.col("p_size") % 3).cast("double").alias("lanes"), (F.col("p_size") * 100).cast("double").alias("capacity")).where("from_node <> to_node")


@query(f"""WITH {GM_SQL}, o AS (SELECT f, t, min(link_id) AS link_id, sum(lanes) AS lanes, sum(capacity) AS capacity FROM gm GROUP BY f, t)
SELECT a.link_id, a.f AS a_node, a.t AS b_node, CAST(CASE WHEN b.link_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS direction, a.lanes AS lanes_ab, a.capacity AS capacity_ab, b.lanes AS lanes_ba, b.capacity AS capacity_ba FROM o a LEFT JOIN o b ON a.f = b.t AND a.t = b.f WHERE b.link_id IS NULL OR a.link_id < b.link_id""")
def gmns_merge_parallel(spark: SparkSession, d: str) -> DataFrame:
    return N.merge_parallel(_gmns(spark, d))


@query(f"WITH {D.LINKS_SQL} SELECT link_id, a_node AS from_node_id, b_node AS to_node_id, round(distance / 1000, 6) AS length, 1 AS dir_flag FROM links WHERE direction >= 0 UNION ALL SELECT link_id, b_node, a_node, round(distance / 1000, 6), -1 FROM links WHERE direction <= 0")
def gmns_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.exported_rows(D.links(spark, d)).select("link_id", "from_node_id", "to_node_id", *r6("length"), "dir_flag")


@query("""WITH w AS (SELECT o_orderkey AS way, list(l_partkey ORDER BY l_linenumber, l_partkey) AS nodes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
e AS (SELECT way, unnest(nodes) AS node, unnest(range(len(nodes))) AS p, len(nodes) AS n FROM w), c AS (SELECT node FROM e GROUP BY node HAVING count(*) > 1),
m AS (SELECT e.*, node IN (SELECT node FROM c) AND p > 0 AND p < n - 1 AS cut FROM e), s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY p) AS seg FROM m),
a AS (SELECT way, p, node, seg FROM s UNION ALL SELECT way, p, node, seg - 1 FROM s WHERE cut)
SELECT way, CAST(seg AS BIGINT) AS seg, string_agg(CAST(node AS VARCHAR), ',' ORDER BY p) AS nodes FROM a GROUP BY way, seg""")
def osm_split_ways(spark: SparkSession, d: str) -> DataFrame:
    li = D.table(spark, d, "lineitem")
    ways = li.groupBy(F.col("l_orderkey").alias("way")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("nodes"))
    return N.split_ways(ways).select("way", "seg", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query("WITH a AS (SELECT lower(n_name) AS name FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT lower(n_name) AS name FROM nation WHERE n_nationkey % 4 <> 0) SELECT name, 'missing' AS state FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL SELECT name, 'unregistered' FROM (SELECT name FROM b EXCEPT SELECT name FROM a)")
def registry_reconcile(spark: SparkSession, d: str) -> DataFrame:
    n = D.table(spark, d, "nation").withColumnRenamed("n_name", "name")
    return N.reconcile(n.where("n_nationkey % 3 <> 0"), n.where("n_nationkey % 4 <> 0"))


@query(f"WITH {D.LINKS_SQL} SELECT chain, round(sum(distance), 6) AS distance, round(sum(speed * distance) / sum(distance), 6) AS speed, round(sum(capacity * distance) / sum(distance), 6) AS capacity, count(*) AS n FROM (SELECT *, link_id // 4 AS chain, 50 + link_id % 4 AS speed FROM links) GROUP BY chain HAVING CAST(max(speed) AS DOUBLE) / min(speed) <= 1.05")
def simplify_weighted_speed(spark: SparkSession, d: str) -> DataFrame:
    links = D.links(spark, d).withColumns({"speed": (50 + F.col("link_id") % 4).cast("double"), "lanes": F.lit(1), "link_type": F.lit("r")})
    chain = links.select("link_id", F.floor(F.col("link_id") / 4).alias("chain"))
    return N.simplified(links, chain, 1.05).select("chain", *r6("distance", "speed", "capacity"), "n")


@query(f"WITH {MODES_SQL}, bad AS (SELECT 'unknown mode' AS rule, m AS key FROM ch WHERE m <> '' AND m NOT IN ('s', 't', 'a', 'n', 'd') UNION SELECT 'no mode', CAST(link_id AS VARCHAR) FROM ml WHERE modes = '' UNION SELECT 'unknown link type', link_type FROM ml WHERE link_type <> 'B') SELECT DISTINCT rule, key FROM bad")
def network_violations(spark: SparkSession, d: str) -> DataFrame:
    links = _mode_links(spark, d).withColumn("direction", F.lit(1))
    nodes = links.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct().withColumn("is_centroid", F.lit(False))
    modes = spark.createDataFrame([(m,) for m in "stand"], "mode string")
    return N.violations(links, nodes, modes, spark.createDataFrame([("B",)], "link_type string"))


@query(f"WITH {DELAUNAY_SQL} SELECT a_node, b_node FROM dl")
def delaunay_edges(spark: SparkSession, d: str) -> DataFrame:
    from netloom.functions.delaunay import delaunay_edges as triangulate

    rows = scattered(spark, d).orderBy("id").collect()
    found = triangulate([(r.x, r.y) for r in rows])
    return spark.createDataFrame([(rows[i].id, rows[j].id) for i, j in found], "a_node long, b_node long")


def _grid(spark: SparkSession, n: int = 6) -> DataFrame:
    """A grid of straight two-way roads a hundred metres apart; every third row is a priority road."""
    rows = []
    for i in range(n):
        for j in range(n):
            a = i * n + j + 1
            if j + 1 < n:
                rows.append((len(rows) + 1, a, a + 1, 0, [(100.0 * j, 100.0 * i), (100.0 * j + 100, 100.0 * i)], "bt", i % 3 == 0))
            if i + 1 < n:
                rows.append((len(rows) + 1, a, a + n, 0, [(100.0 * j, 100.0 * i), (100.0 * j, 100.0 * i + 100)], "b", False))
    return spark.createDataFrame(rows, "link_id long, a_node long, b_node long, direction int, points array<struct<x:double,y:double>>, modes string, priority boolean")


@query()
def match_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of four stops by part key on a grid of roads, some with a shape."""
    from netloom.operators import map_matching as MM

    p = D.table(spark, d, "part").select("p_partkey", "p_size")
    stop = lambda k: F.struct(((F.col("p_partkey") * 37 + 130 * k) % 500).cast("double").alias("x"), ((F.col("p_size") * 13 + 70 * k) % 520).cast("double").alias("y"))
    stops = F.array(*[stop(k) for k in range(4)])
    patterns = p.select(F.col("p_partkey").alias("pattern"), stops.alias("stops"), F.when(F.col("p_partkey") % 2 == 0, stops).alias("shape"), F.lit("b").alias("mode"))
    return MM.match_patterns(spark, _grid(spark), patterns).select("pattern", "accepted", "reason", "failed_at", F.array_join(F.transform("links", lambda x: x.cast("string")), ",").alias("links"), F.round("length", 4).alias("length"))


@query("SELECT z AS zone, node FROM (SELECT s_suppkey % 10 AS z, s_suppkey AS node, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey * 61 % 1009, s_suppkey) AS rk FROM supplier) WHERE rk <= 3")
def spread_connectors(spark: SparkSession, d: str) -> DataFrame:
    """Candidates so far apart that the spacing never binds."""
    from netloom.operators import map_matching as MM

    k = F.col("s_suppkey")
    c = D.table(spark, d, "supplier").select((k % 10).alias("zone"), k.alias("node"), (k * 1000.0).alias("x"), F.lit(0.0).alias("y"), (k * 61 % 1009).cast("double").alias("distance"))
    return MM.spread(spark.range(10).select(F.col("id").alias("zone"), F.lit(3).alias("target")), c)


#: A segment meets the box where its part within the x range and its part within the y range overlap.
_BOX_SQL = """s AS (SELECT link_id, x1, y1, x2, y2, x1 > 200.5 AND x1 < 300.5 AND y1 > 150.5 AND y1 < 650.5 AS a, x2 > 200.5 AND x2 < 300.5 AND y2 > 150.5 AND y2 < 650.5 AS b,
  (200.5 - x1) / (x2 - x1) AS tx0, (300.5 - x1) / (x2 - x1) AS tx1, CASE WHEN y2 = y1 THEN CASE WHEN y1 > 150.5 AND y1 < 650.5 THEN -9 ELSE 9 END ELSE (150.5 - y1) / (y2 - y1) END AS ty0,
  CASE WHEN y2 = y1 THEN 9 ELSE (650.5 - y1) / (y2 - y1) END AS ty1 FROM seg)"""


@query(f"{POINTS}, {SEG_SQL.replace('x + 40', 'x + 400')}, {_BOX_SQL} SELECT link_id, CASE WHEN a AND b THEN 'inside' WHEN greatest(0, tx0, least(ty0, ty1)) <= least(1, tx1, greatest(ty0, ty1)) THEN 'crossing' ELSE 'outside' END AS kind FROM s")
def crossing_links(spark: SparkSession, d: str) -> DataFrame:
    return P.crossing(_segments(spark, d).withColumn("x2", F.col("x1") + 400), [(200.5, 150.5), (300.5, 150.5), (300.5, 650.5), (200.5, 650.5), (200.5, 150.5)])


@query(f"""{POINTS}, z AS (SELECT k + 1 AS zone, (k % 5) * 100 + 0.37 AS x0, (k // 5) * 100 + 0.41 AS y0 FROM (SELECT unnest(range(25)) AS k)),
r AS (SELECT id, zone, sqrt(pow(greatest(x0 - x, 0, x - x0 - 100), 2) + pow(greatest(y0 - y, 0, y - y0 - 100), 2)) AS dist FROM cus CROSS JOIN z)
SELECT id, CAST(arg_min(zone, (dist, zone)) AS BIGINT) AS zone FROM (SELECT id, zone, round(dist, 9) AS dist FROM r) GROUP BY id""")
def closest_zone(spark: SparkSession, d: str) -> DataFrame:
    return P.closest_zone(cus(spark, d), _squares(spark), 100.0)


@query(f"{POINTS}, m AS (SELECT id, x, y, CASE id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'w' ELSE 'cw' END AS modes FROM cus), k AS (SELECT unnest(['c', 'w']) AS mode), r AS (SELECT a.id AS zone, b.id AS node, mode, {DIST} AS dist, row_number() OVER (PARTITION BY a.id, mode ORDER BY {DIST}, b.id) AS rk FROM sup a CROSS JOIN m b JOIN k ON contains(b.modes, mode)) SELECT zone, node, round(min(dist), 6) AS distance, string_agg(mode, '' ORDER BY mode) AS modes FROM r WHERE rk = 1 GROUP BY zone, node")
def mode_connectors(spark: SparkSession, d: str) -> DataFrame:
    nodes = cus(spark, d).withColumn("modes", F.when(F.col("id") % 3 == 0, "c").when(F.col("id") % 3 == 1, "w").otherwise("cw"))
    return P.mode_connectors(sup(spark, d), nodes, ["c", "w"]).select("zone", "node", *r6("distance"), "modes")


@query("""WITH j AS (SELECT o_orderkey AS trip, o_orderkey % 5 AS pattern, CAST(o_orderkey * 617 % 86400 AS INTEGER) AS start, CAST(o_orderkey % 3 AS INTEGER) AS f FROM orders),
p AS (SELECT p AS pattern, CAST(s AS INTEGER) AS seq, p * 10 + s AS stop, 300 * s AS arr, 300 * s + 30 AS dep FROM (SELECT unnest(range(5)) AS p) CROSS JOIN (SELECT unnest(range(7)) AS s)),
t AS (SELECT j.pattern, trip, seq - f AS seq, stop, (start + arr - (300 * f + 30)) AS a, (start + dep - (300 * f + 30)) AS d FROM j JOIN p ON j.pattern = p.pattern AND seq BETWEEN f AND 6)
SELECT pattern, trip, CAST(seq AS INTEGER) AS seq, stop, CAST(a AS INTEGER) AS arrival, CAST(d AS INTEGER) AS departure FROM t""")
def visum_schedule(spark: SparkSession, d: str) -> DataFrame:
    from netloom.sources.networks import visum_schedule as schedule

    k = F.col("o_orderkey")
    j = D.table(spark, d, "orders").select(k.alias("trip"), (k % 5).alias("pattern"), (k * 617 % 86400).alias("dep"), (k % 3).cast("int").alias("from_seq"), F.lit(6).alias("to_seq"))
    p = spark.range(5).select(F.col("id").alias("pattern"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq")).select("pattern", "seq", (F.col("pattern") * 10 + F.col("seq")).alias("stop"), (300 * F.col("seq")).alias("arr"), (300 * F.col("seq") + 30).alias("dep"))
    return schedule(j, p)
