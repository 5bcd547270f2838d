"""Queries over the derived network: expansion, searches, loading, equilibrium."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import assignment as A
from netloom.operators import graph as G
from netloom.operators import outcomes as O
from netloom.plans.registry import query
from netloom.sources import derived as D

ROUNDS = 8  # the derived network's labels settle in six


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.directed(D.links(spark, d))


def graph(spark: SparkSession, d: str, fields: tuple[str, ...] = ()):
    return G.arrays(edges(spark, d), D.zones(spark, d), "distance", fields)


def labels_sql(name: str = "sp", source: str = "edges", cost: str = "distance", blocked: bool = False) -> str:
    """Shortest-path labels by rounds of relaxation: (origin, node, cost, pred_node, link_id, direction)."""
    out = [f"{name}0 AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS origin, CAST(n_nationkey + 1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost, CAST(NULL AS BIGINT) AS pred_node, CAST(NULL AS BIGINT) AS link_id, CAST(NULL AS INTEGER) AS direction FROM nation)"]
    stop = "AND l.node = l.origin" if blocked else ""
    for k in range(1, (2 if blocked else ROUNDS) + 1):
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT origin, node, cost, pred_node, link_id, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY cost, pred_node, link_id, direction) AS rn FROM (
    SELECT * FROM {name}{k - 1} UNION ALL
    SELECT l.origin, e.head, l.cost + e.{cost}, e.tail, e.link_id, e.direction FROM {name}{k - 1} l JOIN {source} e ON l.node = e.tail {stop}) ) WHERE rn = 1)""")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}{k})")
    return ",\n".join(out)


#: Each pair's path as rows, from the destination back.
WALK_SQL = """walk AS (
  SELECT origin, node AS destination, node, pred_node, link_id, direction, cost FROM sp WHERE node <> origin
  UNION ALL
  SELECT w.origin, w.destination, s.node, s.pred_node, s.link_id, s.direction, s.cost FROM walk w JOIN sp s ON s.origin = w.origin AND s.node = w.pred_node WHERE s.node <> s.origin
)"""
FLOWS_SQL = f"WITH RECURSIVE {D.LINKS_SQL}, {D.TRIPS_SQL}, {labels_sql()}, {WALK_SQL}"


@query(f"WITH {D.LINKS_SQL} SELECT link_id, CAST(direction AS BIGINT) AS direction, tail, head, round(distance, 6) AS distance, round(free_flow_time, 6) AS free_flow_time, capacity FROM edges")
def directed_expand(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("link_id", F.col("direction").cast("long").alias("direction"), "tail", "head", *r6("distance", "free_flow_time"), "capacity")


@query(f"WITH {D.LINKS_SQL}, n AS (SELECT tail AS node FROM edges UNION SELECT head FROM edges) SELECT node, row_number() OVER (ORDER BY node) - 1 AS position, true AS is_zone FROM n")
def node_index(spark: SparkSession, d: str) -> DataFrame:
    return G.node_index(edges(spark, d), D.zones(spark, d))


@query(f"WITH {D.LINKS_SQL} SELECT link_id, CAST(direction AS BIGINT) AS direction, row_number() OVER (ORDER BY link_id, direction DESC) - 1 AS supernet_id FROM edges")
def supernet_ids(spark: SparkSession, d: str) -> DataFrame:
    return G.supernet_ids(edges(spark, d)).select("link_id", F.col("direction").cast("long").alias("direction"), "supernet_id")


@query(f"WITH {D.LINKS_SQL} SELECT link_id, a_node, b_node FROM links WHERE link_id % 5 <> 0")
def exclude_links(spark: SparkSession, d: str) -> DataFrame:
    links = D.links(spark, d)
    return G.exclude_links(links, links.where("link_id % 5 = 0")).select("link_id", "a_node", "b_node")


@query(f"WITH {D.LINKS_SQL} SELECT link_id, a_node, b_node, CASE WHEN link_id % 3 = 0 THEN 'ct' WHEN link_id % 3 = 1 THEN 'c' ELSE 'tw' END AS modes FROM links WHERE link_id % 3 <> 1")
def mode_filter(spark: SparkSession, d: str) -> DataFrame:
    modes = F.when(F.col("link_id") % 3 == 0, "ct").when(F.col("link_id") % 3 == 1, "c").otherwise("tw")
    return G.for_mode(D.links(spark, d).withColumn("modes", modes), "t").select("link_id", "a_node", "b_node", "modes")


@query(f"WITH {D.LINKS_SQL} SELECT link_id, CAST(direction AS BIGINT) AS direction, round(CASE WHEN direction = 1 THEN distance ELSE distance * 2 END, 6) AS time FROM edges")
def ab_ba_suffix_resolution(spark: SparkSession, d: str) -> DataFrame:
    links = G.validate_links(D.links(spark, d).withColumn("Time_AB", F.col("distance")).withColumn("Time_BA", F.col("distance") * 2))
    return G.directed(links).select("link_id", F.col("direction").cast("long").alias("direction"), *r6("time"))


@query(f"WITH {D.LINKS_SQL} SELECT link_id, b_node AS a_node, a_node AS b_node FROM links")
def reverse_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.reverse(D.links(spark, d)).select("link_id", "a_node", "b_node")


@query(f"WITH {D.LINKS_SQL}, {labels_sql()} SELECT origin, node AS destination, round(cost, 6) AS cost FROM sp")
def sssp_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.skims(spark, graph(spark, d), D.zones(spark, d), []).select("origin", "destination", *r6("cost"))


@query(f"WITH {D.LINKS_SQL}, {labels_sql()} SELECT origin, node, round(cost, 6) AS cost, pred_node, link_id, CAST(direction AS BIGINT) AS direction FROM sp")
def sssp_trees(spark: SparkSession, d: str) -> DataFrame:
    return G.trees(spark, graph(spark, d), D.zones(spark, d).withColumnRenamed("zone", "origin")).select("origin", "node", *r6("cost"), "pred_node", "link_id", "direction")


@query(f"WITH {D.LINKS_SQL}, {labels_sql()} SELECT origin, node, round(cost, 6) AS cost, pred_node, link_id FROM sp")
def sssp_relational(spark: SparkSession, d: str) -> DataFrame:
    return G.min_plus(edges(spark, d), D.zones(spark, d).withColumnRenamed("zone", "origin"), "distance").select("origin", "node", *r6("cost"), "pred_node", "link_id")


@query(f"WITH {D.LINKS_SQL}, {labels_sql(blocked=True)} SELECT origin, node AS destination, round(cost, 6) AS cost FROM sp")
def sssp_blocked_centroids(spark: SparkSession, d: str) -> DataFrame:
    return G.skims(spark, graph(spark, d), D.zones(spark, d), [], blocked=True).where("cost < double('inf')").select("origin", "destination", *r6("cost"))


@query(f"""WITH RECURSIVE {D.LINKS_SQL}, {labels_sql()}, {WALK_SQL}
SELECT origin, destination, round(sum(e.free_flow_time), 6) AS free_flow_time, round(sum(e.capacity), 6) AS capacity FROM walk w JOIN edges e USING (link_id, direction) GROUP BY origin, destination""")
def skim_two_fields(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d, ("free_flow_time", "capacity"))
    return G.skims(spark, g, D.zones(spark, d), ["free_flow_time", "capacity"]).where("origin <> destination").select("origin", "destination", *r6("free_flow_time", "capacity"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    z = D.zones(spark, d)
    return z.select(F.col("zone").alias("origin"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(25).cast("long"))).alias("destination"))


@query(f"""WITH RECURSIVE {D.LINKS_SQL}, {labels_sql()}, {WALK_SQL}
SELECT origin, destination, string_agg(CAST(link_id * direction AS VARCHAR), ',' ORDER BY cost) AS links, string_agg(CAST(node AS VARCHAR), ',' ORDER BY cost) AS nodes FROM walk GROUP BY origin, destination""")
def path_links(spark: SparkSession, d: str) -> DataFrame:
    p = G.paths(spark, graph(spark, d), pairs(spark, d)).where("path is not null")
    return p.select("origin", "destination", F.array_join(F.transform("path", lambda s: (s["link_id"] * s["direction"]).cast("string")), ",").alias("links"), F.array_join(F.transform("path", lambda s: s["node"].cast("string")), ",").alias("nodes"))


@query(f"WITH RECURSIVE {D.LINKS_SQL}, {labels_sql()}, {WALK_SQL} SELECT origin, destination, node, round(cost, 6) AS milepost FROM walk")
def path_mileposts(spark: SparkSession, d: str) -> DataFrame:
    p = G.paths(spark, graph(spark, d), pairs(spark, d)).where("path is not null")
    return p.select("origin", "destination", F.explode("path").alias("s")).select("origin", "destination", "s.node", F.round("s.milepost", 6).alias("milepost"))


_HALF = "SELECT * FROM edges WHERE direction = 1 AND link_id % 2 = 0"


@query(f"""WITH RECURSIVE {D.LINKS_SQL}, half AS ({_HALF}), reach AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS origin, CAST(n_nationkey + 1 AS BIGINT) AS node FROM nation UNION SELECT r.origin, h.head FROM reach r JOIN half h ON h.tail = r.node)
SELECT a.n_nationkey + 1 AS origin, b.n_nationkey + 1 AS destination FROM nation a CROSS JOIN nation b
WHERE NOT EXISTS (SELECT 1 FROM reach WHERE origin = a.n_nationkey + 1 AND node = b.n_nationkey + 1)""")
def disconnected_pairs(spark: SparkSession, d: str) -> DataFrame:
    half = edges(spark, d).where("direction = 1 and link_id % 2 = 0")
    return G.disconnected(spark, G.arrays(half, D.zones(spark, d), "distance"), D.zones(spark, d))


@query(f"""WITH {D.LINKS_SQL}, half AS (SELECT * FROM edges WHERE direction = 1 AND link_id % 2 = 0), {labels_sql("sp", "half")} SELECT origin, node AS destination FROM sp WHERE node <> origin""")
def reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    half = edges(spark, d).where("direction = 1 and link_id % 2 = 0")
    found = G.skims(spark, G.arrays(half, D.zones(spark, d), "distance"), D.zones(spark, d), [])
    return found.where("origin <> destination and cost < double('inf')").select("origin", "destination")


def _flows(weights: str, where: str = "") -> str:
    return f"""{FLOWS_SQL}, f AS (SELECT link_id, direction, {weights} FROM walk JOIN od USING (origin, destination) {where} GROUP BY link_id, direction)"""


@query(f"""{_flows("sum(trips) AS v")}
SELECT l.link_id, round(coalesce(sum(CASE WHEN f.direction = 1 THEN v END), 0), 6) AS trips_ab, round(coalesce(sum(CASE WHEN f.direction = -1 THEN v END), 0), 6) AS trips_ba, round(coalesce(sum(v), 0), 6) AS trips_tot
FROM links l LEFT JOIN f ON l.link_id = f.link_id GROUP BY l.link_id""")
def aon_link_flows(spark: SparkSession, d: str) -> DataFrame:
    flows = A.all_or_nothing(spark, graph(spark, d), D.demand(spark, d), ["trips"])
    return A.link_results(flows, D.links(spark, d), ["trips"]).select("link_id", *r6("trips_ab", "trips_ba", "trips_tot"))


@query(f"{_flows('sum(trips) AS v')} SELECT link_id, CAST(direction AS BIGINT) AS direction, round(v, 6) AS trips FROM f")
def aon_by_joins(spark: SparkSession, d: str) -> DataFrame:
    return A.all_or_nothing_by_joins(edges(spark, d), D.demand(spark, d), ["trips"], "distance").select("link_id", F.col("direction").cast("long").alias("direction"), *r6("trips"))


_CLASSES = {"AUTOMOBILE": 1.0, "BUILDING": 1.5, "MACHINERY": 2.0}


@query(f"""{FLOWS_SQL}, c AS (SELECT origin, destination, {", ".join(f"sum(CASE WHEN c_mktsegment = '{s}' THEN trips ELSE 0 END) AS {s.lower()}" for s in _CLASSES)} FROM trips GROUP BY origin, destination)
SELECT link_id, CAST(direction AS BIGINT) AS direction, {", ".join(f"round(sum({s.lower()}), 6) AS {s.lower()}" for s in _CLASSES)}, round({" + ".join(f"{p} * sum({s.lower()})" for s, p in _CLASSES.items())}, 6) AS pce
FROM walk JOIN c USING (origin, destination) GROUP BY link_id, direction""")
def aon_multiclass_pce(spark: SparkSession, d: str) -> DataFrame:
    rows = D.trips(spark, d, "c_mktsegment")
    od = rows.groupBy("origin", "destination").agg(*[F.sum(F.when(F.col("c_mktsegment") == s, F.col("trips")).otherwise(0.0)).alias(s.lower()) for s in _CLASSES])
    names = [s.lower() for s in _CLASSES]
    flows = A.all_or_nothing(spark, graph(spark, d), od, names)
    return flows.select("link_id", "direction", *r6(*names), F.round(sum(F.col(s.lower()) * p for s, p in _CLASSES.items()), 6).alias("pce"))


_SETS = {"east": [(3, 0), (11, 0)], "west": [(7, 1)]}
_SETS_SQL = "sets AS (SELECT * FROM (VALUES ('east', 3, 1), ('east', 3, -1), ('east', 11, 1), ('east', 11, -1), ('west', 7, 1)) AS t(s, link_id, direction)), hit AS (SELECT DISTINCT s, origin, destination FROM walk JOIN sets USING (link_id, direction))"


@query(f"""{FLOWS_SQL}, {_SETS_SQL} SELECT s AS "set", origin, destination, round(trips, 6) AS trips FROM hit JOIN od USING (origin, destination)""")
def select_link_od(spark: SparkSession, d: str) -> DataFrame:
    return A.select_link(spark, graph(spark, d), D.demand(spark, d), ["trips"], _SETS)[0].select("set", "origin", "destination", *r6("trips"))


@query(f"""{FLOWS_SQL}, {_SETS_SQL} SELECT s AS "set", link_id, CAST(direction AS BIGINT) AS direction, round(sum(trips), 6) AS trips FROM hit JOIN od USING (origin, destination) JOIN walk USING (origin, destination) GROUP BY ALL""")
def select_link_flows(spark: SparkSession, d: str) -> DataFrame:
    return A.select_link(spark, graph(spark, d), D.demand(spark, d), ["trips"], _SETS)[1].select("set", "link_id", "direction", *r6("trips"))


SCALE = {"msa": 100.0}


def equilibrium(spark: SparkSession, d: str, algorithm: str, **more) -> A.Equilibrium:
    total = D.demand(spark, d)
    n = total.agg(F.sum("trips")).first()[0] or 1.0
    od = total.select("origin", "destination", (F.col("trips") * F.lit(15241.35 / n)).alias("trips"))
    return A.assign(spark, edges(spark, d), D.zones(spark, d), od, [A.TrafficClass("car", "trips")], algorithm, **more)


def _report(algorithm: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = equilibrium(spark, d, algorithm, max_iterations=60, gap=1e-3)
        return found.to_df(spark).select("link_id", "direction", *r6("car", "time", "voc"))

    run.__name__ = f"{algorithm}_equilibrium"
    return query()(run)


msa_equilibrium, fw_equilibrium, cfw_equilibrium, bfw_equilibrium = map(_report, ("msa", "fw", "cfw", "bfw"))


@query()
def equilibrium_report(spark: SparkSession, d: str) -> DataFrame:
    return equilibrium(spark, d, "bfw", max_iterations=20, gap=1e-3).report_df(spark).drop("seconds")


_LOADED = "SELECT e.link_id, e.direction, coalesce(sum(trips), 0) / 100.0 AS flow FROM edges e LEFT JOIN (SELECT w.link_id, w.direction, o.trips FROM walk w JOIN od o USING (origin, destination)) x ON x.link_id = e.link_id AND x.direction = e.direction GROUP BY e.link_id, e.direction"


@query(f"""WITH RECURSIVE {D.LINKS_SQL}, {D.TRIPS_SQL}, {labels_sql("sp", "edges", "free_flow_time")}, {WALK_SQL}, y1 AS ({_LOADED}),
e2 AS (SELECT e.*, free_flow_time * (1 + 0.15 * pow(flow / capacity, 4)) AS t FROM edges e JOIN y1 USING (link_id, direction)),
{labels_sql("q", "e2", "t")}, walk2 AS (
  SELECT origin, node AS destination, pred_node, link_id, direction FROM q WHERE node <> origin
  UNION ALL SELECT w.origin, w.destination, s.pred_node, s.link_id, s.direction FROM walk2 w JOIN q s ON s.origin = w.origin AND s.node = w.pred_node WHERE s.node <> s.origin),
y2 AS (SELECT link_id, direction, sum(trips) / 100.0 AS flow FROM walk2 JOIN od USING (origin, destination) GROUP BY link_id, direction)
SELECT y1.link_id, CAST(y1.direction AS BIGINT) AS direction, round(0.5 * y1.flow + 0.5 * coalesce(y2.flow, 0), 6) AS flow FROM y1 LEFT JOIN y2 ON y1.link_id = y2.link_id AND y1.direction = y2.direction""")
def msa_2_iterations(spark: SparkSession, d: str) -> DataFrame:
    found = A.assign(spark, edges(spark, d), D.zones(spark, d), D.demand(spark, d, 100.0), [A.TrafficClass("flow", "trips")], "msa", max_iterations=2, gap=0.0)
    return found.to_df(spark).select("link_id", "direction", *r6("flow"))


#: Demand is divided by a number that keeps shares of capacity off the ties of a sixth decimal.
_OFF = 101.37
_EDGE_FLOWS = f"""{_flows(f"sum(trips) / CAST({_OFF} AS DOUBLE) AS v")}, e AS (SELECT e.*, coalesce(v, 0) AS v, free_flow_time * (1 + 0.15 * pow(coalesce(v, 0) / capacity, 4)) AS t, CAST(e.link_id % 7 AS DOUBLE) AS p
  FROM edges e LEFT JOIN f ON e.link_id = f.link_id AND e.direction = f.direction)"""


def edge_flows(spark: SparkSession, d: str) -> DataFrame:
    from netloom.functions.vdf import vdf

    flows = A.all_or_nothing(spark, graph(spark, d), D.demand(spark, d), ["trips"])
    e = edges(spark, d).join(flows.select("link_id", "direction", (F.col("trips") / F.lit(_OFF)).alias("pce")), ["link_id", "direction"], "left").fillna(0.0, ["pce"])
    e = e.withColumn("time", vdf("bpr").value(F.col("pce"), F.col("capacity"), F.col("free_flow_time"), 0.15, 4.0))
    return e.withColumn("free_time", F.col("free_flow_time")).withColumn("preload", (F.col("link_id") % 7).cast("double"))


def _pivot(column: str, name: str, both: str) -> str:
    ab, ba = (f"max(CASE WHEN direction = {way} THEN {column} END)" for way in (1, -1))
    one = f"coalesce({ab}, 0) + coalesce({ba}, 0)" if both == "tot" else f"greatest({ab}, {ba})"
    return f"round({ab}, 6) AS {name}_AB, round({ba}, 6) AS {name}_BA, round({one}, 6) AS {name}_{both}"


@query(f"""{_EDGE_FLOWS} SELECT link_id, {_pivot("p", "Preload", "tot")}, {_pivot("t", "Congested_Time", "Max")}, {_pivot("t / free_flow_time", "Delay_factor", "Max")}, {_pivot("v / capacity", "VOC", "max")}, {_pivot("v", "PCE", "tot")} FROM e GROUP BY link_id""")
def result_pivot_voc_delay(spark: SparkSession, d: str) -> DataFrame:
    out = O.link_outcomes(edge_flows(spark, d))
    return out.select("link_id", *r6(*out.columns[1:]))


@query(f"""{_EDGE_FLOWS}, x AS (SELECT link_id, round(sum(CASE WHEN direction = 1 THEN v ELSE 0 END), 6) AS pce_ab, round(sum(CASE WHEN direction = -1 THEN v ELSE 0 END), 6) AS pce_ba, round(sum(v), 6) AS pce_tot FROM e GROUP BY link_id) SELECT * FROM x WHERE pce_tot > 0""")
def results_without_zero_flows(spark: SparkSession, d: str) -> DataFrame:
    return O.class_flows(edge_flows(spark, d), ["pce"]).where("pce_tot > 0").select("link_id", *r6("pce_ab", "pce_ba", "pce_tot"))


@query(f"""{FLOWS_SQL}, {_SETS_SQL} SELECT origin, destination, round(sum(CASE WHEN s = 'east' THEN trips ELSE 0 END), 6) AS east_trips, round(sum(CASE WHEN s = 'west' THEN trips ELSE 0 END), 6) AS west_trips FROM hit JOIN od USING (origin, destination) GROUP BY ALL""")
def select_link_matrices(spark: SparkSession, d: str) -> DataFrame:
    od, _ = A.select_link(spark, graph(spark, d), D.demand(spark, d), ["trips"], _SETS)
    return O.select_link_cores(od, ["trips"]).select("origin", "destination", *r6("east_trips", "west_trips"))


@query(f"""{FLOWS_SQL}, {_SETS_SQL}, v AS (SELECT s, link_id, direction, sum(trips) AS v FROM hit JOIN od USING (origin, destination) JOIN walk USING (origin, destination) GROUP BY ALL)
SELECT link_id, {", ".join(f"round(sum(CASE WHEN s = '{s}' AND direction IN ({ways}) THEN v ELSE 0 END), 6) AS {s}_trips_{side}" for s in ("east", "west") for ways, side in (("1", "ab"), ("-1", "ba"), ("1, -1", "tot")))} FROM v GROUP BY link_id""")
def select_link_table(spark: SparkSession, d: str) -> DataFrame:
    _, flows = A.select_link(spark, graph(spark, d), D.demand(spark, d), ["trips"], _SETS)
    out = O.select_link_flows(flows, ["trips"])
    return out.select("link_id", *r6(*out.columns[1:]))


@query(f"""WITH {D.LINKS_SQL}, {labels_sql("sp")}, {labels_sql("q", cost="free_flow_time")} SELECT origin, node AS destination, round(sp.cost, 6) AS cost_final, round(0.5 * (sp.cost + q.cost), 6) AS cost_blended FROM sp JOIN q USING (origin, node)""")
def skims_final_and_blended(spark: SparkSession, d: str) -> DataFrame:
    final = G.skims(spark, graph(spark, d), D.zones(spark, d), [])
    first = G.skims(spark, G.arrays(edges(spark, d), D.zones(spark, d), "free_flow_time"), D.zones(spark, d), [])
    return O.all_skims(final, O.blend(first, final, 0.5), "all").select("origin", "destination", *r6("cost_final", "cost_blended"))


@query(f"""{_flows(f"sum(trips) / CAST({_OFF} AS DOUBLE) AS v")}, x AS (SELECT e.link_id, e.direction, v, free_flow_time AS t, free_flow_time * (1 + 0.15 * pow(v / capacity, 4)) AS t1, v * (0.7 + 0.1 * (e.link_id % 3)) AS y FROM edges e JOIN f ON e.link_id = f.link_id AND e.direction = f.direction)
SELECT round(abs(sum(t1 * v) - sum(t1 * y)) / sum(t1 * v), 6) AS rgap FROM x""")
def relative_gap(spark: SparkSession, d: str) -> DataFrame:
    e = edge_flows(spark, d).where("pce > 0").withColumn("flow", F.col("pce")).withColumn("best", F.col("pce") * (0.7 + 0.1 * (F.col("link_id") % 3)))
    return A.relative_gap(e).select(*r6("rgap"))


@query(f"WITH {D.LINKS_SQL} SELECT e.link_id, CAST(e.direction AS BIGINT) AS direction, CAST(CASE WHEN e.link_id % 4 = 0 THEN e.link_id * 2.5 ELSE 0 END AS DOUBLE) AS preload FROM edges e")
def preload_merge(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    preload = e.where("link_id % 4 = 0").select("link_id", "direction", (F.col("link_id") * 2.5).alias("preload"))
    return A.merged_preload(e, preload).select("link_id", F.col("direction").cast("long").alias("direction"), "preload")


_VDFS = {
    "bpr": ((0.15, 4.0), "t0 * (1 + 0.15 * pow(x, 4))", "t0 * 0.15 * 4 * pow(x, 3) / c"),
    "bpr2": ((0.15, 4.0), "t0 * (1 + 0.15 * CASE WHEN x > 1 THEN pow(x, 8) ELSE pow(x, 4) END)", "t0 * 0.15 * CASE WHEN x > 1 THEN 8 * pow(x, 7) ELSE 4 * pow(x, 3) END / c"),
    "conical": ((9.0, 1.06), "t0 * (sqrt(81 * (1 - x) * (1 - x) + 1.06 * 1.06) - 9 * (1 - x) - 1.06 + 2)", "t0 * (9 / c - 81 * (1 - x) / (c * sqrt(81 * (1 - x) * (1 - x) + 1.06 * 1.06)))"),
    "inrets": ((0.95,), "CASE WHEN x <= 1 THEN t0 * (1.1 - 0.95 * x) / (1.1 - x) ELSE t0 * ((1.1 - 0.95) / 0.1) * x * x END", "CASE WHEN x <= 1 THEN t0 * -110 * (0.95 - 1) * c / ((11 * c - 10 * v) * (11 * c - 10 * v)) ELSE t0 * -20 * (0.95 - 1.1) * v / (c * c) END"),
    "akcelik": ((0.25, 8.0), "t0 + 0.25 * (x - 1 + sqrt((x - 1) * (x - 1) + 8 * x / c))", "0.25 * (1 / c + (2 * (x - 1) / c + 8 / (c * c)) / (2 * sqrt((x - 1) * (x - 1) + 8 * x / c)))"),
}


def _vdf(name: str, slope: bool):
    parameters, value, gradient = _VDFS[name]
    base = "SELECT *, v / c AS x FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, l_quantity AS v, CAST(l_orderkey % 17 AS DOUBLE) + CAST(20.137 AS DOUBLE) AS c, CAST(l_partkey % 9 AS DOUBLE) + CAST(1.0913 AS DOUBLE) AS t0 FROM lineitem)"

    def run(spark: SparkSession, d: str) -> DataFrame:
        from netloom.functions.vdf import vdf

        li = D.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").alias("v"), ((F.col("l_orderkey") % 17).cast("double") + 20.137).alias("c"), ((F.col("l_partkey") % 9).cast("double") + 1.0913).alias("t0"))
        f = vdf(name)
        got = (f.slope if slope else f.value)(F.col("v"), F.col("c"), F.col("t0"), *parameters)
        return li.select("l_orderkey", "n", F.round(got, 6).alias("value"))

    run.__name__ = f"vdf_{name}" + "_derivative" * slope
    return query(f"SELECT l_orderkey, n, round(CASE WHEN v <= 0 THEN t0 ELSE {gradient if slope else value} END, 6) AS value FROM ({base})")(run)


for _name in _VDFS:
    _vdf(_name, False)
    _vdf(_name, True)


@query()
def congested_skims(spark: SparkSession, d: str) -> DataFrame:
    found = equilibrium(spark, d, "bfw", max_iterations=10, gap=1e-3)
    return A.congested_skims(spark, found, D.zones(spark, d)).select("origin", "destination", *r6("cost", "congested_time"))


@query(f"WITH {D.TRIPS_SQL} SELECT 'car' AS class, CAST(1.5 AS DOUBLE) AS pce, CAST(10 AS DOUBLE) AS vot, round(sum(trips), 6) AS total FROM od")
def class_info(spark: SparkSession, d: str) -> DataFrame:
    return A.class_info(D.demand(spark, d), [A.TrafficClass("car", "trips", 1.5, 10.0)]).select("class", "pce", "vot", *r6("total"))


#: A triangle of zones is Delaunay if its circle holds no other zone; its turn says on which side the determinant is inside.
DELAUNAY_SQL = """pts AS (SELECT n_nationkey + 1 AS z, CAST((pow(n_nationkey, 3) * 31 + n_nationkey * 17) % 1009 AS DOUBLE) AS x, CAST((pow(n_nationkey, 2) * 29 + n_nationkey * 53) % 1013 AS DOUBLE) AS y FROM nation),
tri AS (SELECT a.z AS a, b.z AS b, c.z AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, sign((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS turn FROM pts a JOIN pts b ON a.z < b.z JOIN pts c ON b.z < c.z),
held AS (SELECT DISTINCT t.a, t.b, t.c FROM tri t JOIN pts d ON d.z NOT IN (t.a, t.b, t.c) WHERE turn <> 0 AND turn * (
  (ax - x) * ((by_ - y) * (pow(cx - x, 2) + pow(cy - y, 2)) - (cy - y) * (pow(bx - x, 2) + pow(by_ - y, 2))) - (ay - y) * ((bx - x) * (pow(cx - x, 2) + pow(cy - y, 2)) - (cx - x) * (pow(bx - x, 2) + pow(by_ - y, 2)))
  + (pow(ax - x, 2) + pow(ay - y, 2)) * ((bx - x) * (cy - y) - (cx - x) * (by_ - y))) > 0),
good AS (SELECT a, b, c FROM tri WHERE turn <> 0 EXCEPT SELECT a, b, c FROM held),
dl AS (SELECT row_number() OVER (ORDER BY a_node, b_node) AS link_id, * FROM (SELECT a AS a_node, b AS b_node FROM good UNION SELECT b, c FROM good UNION SELECT a, c FROM good)),
dd AS (SELECT link_id, a_node, b_node, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS distance FROM dl JOIN pts p ON p.z = a_node JOIN pts q ON q.z = b_node),
de AS (SELECT link_id, 1 AS direction, a_node AS tail, b_node AS head, distance FROM dd UNION ALL SELECT link_id, -1, b_node, a_node, distance FROM dd)"""


def scattered(spark: SparkSession, d: str) -> DataFrame:
    """id, x, y: nations spread so that no two paths between them are of one length."""
    k = F.col("n_nationkey").cast("long")
    return D.table(spark, d, "nation").select((k + 1).alias("id"), ((k * k * k * 31 + k * 17) % 1009).cast("double").alias("x"), ((k * k * 29 + k * 53) % 1013).cast("double").alias("y"))


@query(f"""WITH RECURSIVE {DELAUNAY_SQL}, {D.TRIPS_SQL}, {labels_sql("sp", "de")}, {WALK_SQL}, f AS (SELECT link_id, sum(trips) AS v FROM walk JOIN od USING (origin, destination) GROUP BY link_id)
SELECT a_node, b_node, round(distance, 6) AS distance, round(coalesce(v, 0), 6) AS flow FROM dd LEFT JOIN f USING (link_id)""")
def delaunay_assignment(spark: SparkSession, d: str) -> DataFrame:
    z = scattered(spark, d).select(F.col("id").alias("zone"), "x", "y")
    return A.delaunay_assignment(spark, z, D.demand(spark, d), "trips").select("a_node", "b_node", *r6("distance", "flow"))


@query(f"""WITH {D.TRIPS_SQL}, n AS (SELECT 15241.35 / sum(trips) AS s FROM od), o AS (SELECT origin AS zone, sum(trips) AS v FROM od GROUP BY 1), i AS (SELECT destination AS zone, sum(trips) AS v FROM od GROUP BY 1)
SELECT algorithm, n_nationkey + 1 AS zone, round((coalesce(o.v, 0) - coalesce(i.v, 0)) * s, 3) AS balance FROM nation CROSS JOIN n CROSS JOIN (SELECT unnest(['msa', 'fw', 'cfw', 'bfw']) AS algorithm) LEFT JOIN o ON o.zone = n_nationkey + 1 LEFT JOIN i ON i.zone = n_nationkey + 1""")
def equilibrium_balance(spark: SparkSession, d: str) -> DataFrame:
    """What leaves each node less what enters it, in each algorithm's flows: the node's own demand."""
    out = None
    for algorithm in ("msa", "fw", "cfw", "bfw"):
        flows = equilibrium(spark, d, algorithm, max_iterations=8, gap=1e-6).to_df(spark).join(edges(spark, d), ["link_id", "direction"])
        both = flows.select(F.col("tail").alias("zone"), F.col("car").alias("v")).union(flows.select("head", -F.col("car")))
        one = both.groupBy("zone").agg((F.round(F.sum("v"), 3) + 0.0).alias("balance")).select(F.lit(algorithm).alias("algorithm"), "zone", "balance")
        out = one if out is None else out.union(one)
    return out
