"""Queries over origin-destination tables: matrices, fitting, gravity, route choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import distribution as DS
from netloom.operators import graph as G
from netloom.operators import matrix as M
from netloom.operators import route_choice as RC
from netloom.plans.network import edges, graph, labels_sql, r6
from netloom.plans.registry import query
from netloom.sources import derived as D

_FLAGS = ("A", "N", "R")
_CORES_SQL = ", ".join(f"sum(CASE WHEN l_returnflag = '{f}' THEN trips ELSE 0 END) AS {f.lower()}" for f in _FLAGS)
CUBE_SQL = f"WITH {D.TRIPS_SQL}, cube AS (SELECT origin, destination, {_CORES_SQL} FROM trips GROUP BY origin, destination)"


def cube(spark: SparkSession, d: str) -> DataFrame:
    rows = D.trips(spark, d, "l_returnflag")
    return rows.groupBy("origin", "destination").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("trips")).otherwise(0.0)).alias(f.lower()) for f in _FLAGS])


@query(f"WITH {D.TRIPS_SQL} SELECT origin, destination, round(trips, 6) AS trips FROM od")
def od_from_trip_list(spark: SparkSession, d: str) -> DataFrame:
    rows = D.trips(spark, d).withColumnsRenamed({"origin": "o", "destination": "d"})
    return M.from_trip_list(rows, "o", "d", ["trips"]).select("origin", "destination", *r6("trips"))


@query(f"WITH {D.TRIPS_SQL} SELECT DISTINCT zone FROM (SELECT origin AS zone FROM od UNION ALL SELECT destination FROM od)")
def od_zone_index(spark: SparkSession, d: str) -> DataFrame:
    return M.zone_index(D.demand(spark, d))


@query(f"{CUBE_SQL} SELECT origin AS zone, round(sum(a), 6) AS a, round(sum(n), 6) AS n, round(sum(r), 6) AS r FROM cube GROUP BY origin")
def od_row_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.totals(cube(spark, d), "origin").select("zone", *r6("a", "n", "r"))


@query(f"{CUBE_SQL} SELECT destination AS zone, round(sum(a), 6) AS a, round(sum(n), 6) AS n, round(sum(r), 6) AS r FROM cube GROUP BY destination")
def od_col_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.totals(cube(spark, d), "destination").select("zone", *r6("a", "n", "r"))


@query(f"{CUBE_SQL} SELECT origin, destination, round(r, 6) AS returned, round(a, 6) AS accepted FROM cube")
def od_project_cores(spark: SparkSession, d: str) -> DataFrame:
    return M.project(cube(spark, d), ["r", "a"], ["returned", "accepted"]).select("origin", "destination", *r6("returned", "accepted"))


@query(f"WITH {D.TRIPS_SQL}, x AS (SELECT origin, destination, trips AS north FROM od WHERE origin <= 12), y AS (SELECT origin, destination, trips * 2 AS west FROM od WHERE destination <= 12) SELECT coalesce(x.origin, y.origin) AS origin, coalesce(x.destination, y.destination) AS destination, round(coalesce(north, 0), 6) AS north, round(coalesce(west, 0), 6) AS west FROM x FULL JOIN y ON x.origin = y.origin AND x.destination = y.destination")
def od_full_join_demand(spark: SparkSession, d: str) -> DataFrame:
    od = D.demand(spark, d)
    one, two = od.where("origin <= 12").withColumnRenamed("trips", "north"), od.where("destination <= 12").select("origin", "destination", (F.col("trips") * 2).alias("west"), F.lit(1).alias("count"))
    return M.merge_demand([one, two]).select("origin", "destination", *r6("north", "west"))


@query(f"WITH {D.TRIPS_SQL} SELECT origin, destination, round(CASE WHEN (origin + destination) % 3 = 0 THEN 0 ELSE trips END, 6) AS trips FROM od")
def od_nan_to_num(spark: SparkSession, d: str) -> DataFrame:
    holes = D.demand(spark, d).withColumn("trips", F.when((F.col("origin") + F.col("destination")) % 3 == 0, F.lit(float("nan"))).otherwise(F.col("trips")))
    return M.nan_to_zero(holes).select("origin", "destination", *r6("trips"))


@query(f"WITH {D.TRIPS_SQL} SELECT origin, destination, round(trips, 6) AS trips FROM od WHERE (origin + destination) % 3 <> 0 AND trips <> 0")
def od_csv_nonzero(spark: SparkSession, d: str) -> DataFrame:
    holes = D.demand(spark, d).withColumn("trips", F.when((F.col("origin") + F.col("destination")) % 3 == 0, F.lit(0.0)).otherwise(F.col("trips")))
    return M.nonzero(holes).select("origin", "destination", *r6("trips"))


@query(f"WITH {D.TRIPS_SQL} SELECT origin + 100 AS origin, destination + 100 AS destination, round(trips, 6) AS trips FROM od")
def od_relabel(spark: SparkSession, d: str) -> DataFrame:
    return M.to_nodes(D.demand(spark, d), D.zones(spark, d).select("zone", (F.col("zone") + 100).alias("node"))).select("origin", "destination", *r6("trips"))


@query(f"{CUBE_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS core, round(sum({f}), 6) AS total, round(CASE WHEN count(*) < 900 THEN least(min({f}), 0) ELSE min({f}) END, 6) AS min, round(max({f}), 6) AS max, count(*) FILTER (WHERE {f} <> 0) AS nonzero FROM cube" for f in "anr"))
def matrix_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(cube(spark, d), 30).select("core", *r6("total", "min", "max"), "nonzero")


@query(f"{CUBE_SQL} " + " UNION ALL ".join(f"SELECT origin, destination, '{f}' AS core, round({f}, 6) AS value FROM cube WHERE {f} <> 0" for f in "anr"))
def matrix_melt(spark: SparkSession, d: str) -> DataFrame:
    return M.melt(cube(spark, d)).select("origin", "destination", "core", *r6("value"))


VECTORS_SQL = """vec AS (
  SELECT p.z AS zone, p.v AS "rows", a.v * (SELECT sum(v) FROM prod) / (SELECT sum(v) FROM attr) AS "columns" FROM prod p JOIN attr a ON p.z = a.z
)"""
GOALS_SQL = f"""prod AS (SELECT CAST(c_nationkey + 1 AS BIGINT) AS z, sum(abs(c_acctbal)) AS v FROM customer GROUP BY 1),
attr AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS z, coalesce(sum(abs(s_acctbal)), 0) + 1000 AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), {VECTORS_SQL}"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    p = D.table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).cast("long").alias("zone")).agg(F.sum(F.abs("c_acctbal")).alias("rows"))
    n = D.zones(spark, d).join(D.table(spark, d, "supplier").select((F.col("s_nationkey") + 1).cast("long").alias("zone"), F.abs("s_acctbal").alias("v")), "zone", "left").groupBy("zone").agg((F.coalesce(F.sum("v"), F.lit(0.0)) + 1000).alias("columns"))
    both = p.join(n, "zone")
    s = both.agg(F.sum("rows").alias("p")).first(), n.agg(F.sum("columns").alias("a")).first()
    pt = p.agg(F.sum("rows")).first()[0]
    return both.select("zone", "rows", (F.col("columns") * F.lit(pt / s[1].a)).alias("columns"))


def _ipf_sql(rounds: int, seed: str = "SELECT origin, destination, trips AS v FROM od", before: str = "", digits: int = 4) -> str:
    """Rounds of scaling rows, then columns."""
    out = [f"WITH {D.TRIPS_SQL}, {GOALS_SQL}{before}, x0 AS MATERIALIZED ({seed})"]
    for k in range(rounds):
        out.append(f"""r{k} AS (SELECT x.origin, x.destination, x.v * vec."rows" / sum(x.v) OVER (PARTITION BY x.origin) AS v FROM x{k} x JOIN vec ON vec.zone = x.origin)""")
        out.append(f"""x{k + 1} AS MATERIALIZED (SELECT x.origin, x.destination, x.v * vec."columns" / sum(x.v) OVER (PARTITION BY x.destination) AS v FROM r{k} x JOIN vec ON vec.zone = x.destination)""")
    return ", ".join(out) + f" SELECT origin, destination, round(v, {digits}) AS value FROM x{rounds}"


@query(_ipf_sql(3))
def ipf_3_iterations(spark: SparkSession, d: str) -> DataFrame:
    seed = D.demand(spark, d).withColumnRenamed("trips", "value")
    return DS.ipf(seed, vectors(spark, d), 3, 0.0).matrix.select("origin", "destination", F.round("value", 4).alias("value"))


@query(_ipf_sql(2))
def ipf_in_place(spark: SparkSession, d: str) -> DataFrame:
    seed, v = D.demand(spark, d).withColumnRenamed("trips", "value"), vectors(spark, d)
    rows, cols = v.select(F.col("zone").alias("origin"), F.col("rows").alias("p")), v.select(F.col("zone").alias("destination"), F.col("columns").alias("a"))
    return DS.ipf_in_place(seed, rows, cols, 2, 0.0).matrix.select("origin", "destination", F.round("value", 4).alias("value"))


@query(_ipf_sql(40, digits=2))
def ipf_converged(spark: SparkSession, d: str) -> DataFrame:
    """Fitted until factors differ from 1 by 1e-12 at most; the SQL runs far beyond that."""
    return DS.ipf(D.demand(spark, d).withColumnRenamed("trips", "value"), vectors(spark, d), tolerance=1e-12).matrix.select("origin", "destination", F.round("value", 2).alias("value"))


def impedance(spark: SparkSession, d: str) -> DataFrame:
    return G.skims(spark, graph(spark, d), D.zones(spark, d), []).where("origin <> destination").select("origin", "destination", "cost")


_GRAVITY = {"expo": (DS.GravityModel("EXPO", beta=0.05), "exp(-0.05 * cost)"), "power": (DS.GravityModel("POWER", alpha=1.2), "pow(cost, -1.2)"), "gamma": (DS.GravityModel("GAMMA", alpha=0.3, beta=0.04), "pow(cost, 0.3) * exp(-0.04 * cost)")}


def _gravity(name: str):
    model, sql = _GRAVITY[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return DS.gravity_seed(impedance(spark, d), vectors(spark, d), model, max_cost=80.0).select("origin", "destination", F.round("value", 4).alias("value"))

    run.__name__ = f"gravity_{name}"
    return query(f"""WITH {D.LINKS_SQL}, {GOALS_SQL}, {labels_sql()}, g AS (
  SELECT sp.origin, sp.node AS destination, CASE WHEN cost <= 80 THEN p."rows" * a."columns" * {sql} ELSE 0 END AS v FROM sp JOIN vec p ON p.zone = sp.origin JOIN vec a ON a.zone = sp.node WHERE sp.origin <> sp.node)
SELECT origin, destination, round(v * (SELECT sum("rows") FROM vec) / (SELECT sum(v) FROM g), 4) AS value FROM g""")(run)


for _n in _GRAVITY:
    _gravity(_n)


@query(_ipf_sql(60, """SELECT sp.origin, sp.node AS destination, p."rows" * a."columns" * exp(-0.05 * cost) AS v FROM sp JOIN vec p ON p.zone = sp.origin JOIN vec a ON a.zone = sp.node WHERE sp.origin <> sp.node""", f", {D.LINKS_SQL}, {labels_sql()}", 2))
def gravity_apply(spark: SparkSession, d: str) -> DataFrame:
    return DS.gravity(impedance(spark, d), vectors(spark, d), _GRAVITY["expo"][0], tolerance=1e-12).matrix.select("origin", "destination", F.round("value", 2).alias("value"))


@query("SELECT 'EXPO' AS function, CAST(0.05 AS DOUBLE) AS parameter UNION ALL SELECT 'POWER', 1.2")
def gravity_calibrate(spark: SparkSession, d: str) -> DataFrame:
    """Recovers the parameters of trips that models with known ones have made."""
    cost, v, out = impedance(spark, d).persist(), vectors(spark, d), []
    for name in ("expo", "power"):
        made = DS.gravity(cost, v, _GRAVITY[name][0]).matrix
        model, _ = DS.calibrate(made, cost, name, max_iterations=20, tolerance=1e-6)
        out.append((model.function, round(model.beta if name == "expo" else model.alpha, 3)))
    cost.unpersist()
    return spark.createDataFrame(out, "function string, parameter double")


#: All loopless routes of up to four links.
ROUTES_SQL = f"""WITH RECURSIVE {D.LINKS_SQL}, {D.TRIPS_SQL}, w AS (
  SELECT tail AS origin, head AS node, [link_id * direction] AS route, [tail, head] AS seen FROM edges
  UNION ALL SELECT w.origin, e.head, list_append(w.route, e.link_id * e.direction), list_append(w.seen, e.head) FROM w JOIN edges e ON e.tail = w.node WHERE len(w.route) < 4 AND NOT list_contains(w.seen, e.head)
), routes AS (SELECT origin, node AS destination, route, array_to_string(route, ',') AS key FROM w),
steps AS (SELECT origin, destination, key, unnest(route) AS link FROM routes), costs AS (SELECT link_id * direction AS link, distance / 20 AS t FROM edges),
full_routes AS (SELECT s.origin, s.destination, s.key, sum(t) AS cost FROM steps s JOIN costs USING (link) GROUP BY ALL),
masked AS (SELECT *, cost <= min(cost) OVER (PARTITION BY origin, destination) + ln(0.95 / (1 - 0.95)) AS mask, min(cost) OVER (PARTITION BY origin, destination) AS least FROM full_routes),
used AS (SELECT s.*, t, cost FROM steps s JOIN costs USING (link) JOIN masked m USING (origin, destination, key) WHERE mask),
freq AS (SELECT origin, destination, link, count(*) AS n FROM used GROUP BY ALL),
overlap AS (SELECT origin, destination, key, sum(t / cost / n) AS ps FROM used JOIN freq USING (origin, destination, link) GROUP BY ALL),
psl AS (SELECT m.origin, m.destination, m.key, m.cost, mask, coalesce(ps, 0) AS ps, CASE WHEN mask THEN ps * exp(least - m.cost) ELSE 0 END AS wt FROM masked m LEFT JOIN overlap o USING (origin, destination, key)),
prob AS (SELECT *, wt / sum(wt) OVER (PARTITION BY origin, destination) AS p FROM psl)"""


def enumerated(spark: SparkSession, d: str) -> DataFrame:
    """All loopless routes of up to four links, by joins."""
    e = edges(spark, d).select("tail", "head", (F.col("link_id") * F.col("direction")).alias("link"))
    now = e.select(F.col("tail").alias("origin"), F.col("head").alias("node"), F.array("link").alias("route"), F.array("tail", "head").alias("seen"))
    out = now
    for _ in range(3):
        now = now.join(e, F.col("node") == F.col("tail")).where(~F.array_contains("seen", F.col("head"))).select("origin", F.col("head").alias("node"), F.concat("route", F.array("link")).alias("route"), F.concat("seen", F.array("head")).alias("seen"))
        out = out.union(now)
    G.checkpoints(spark)  # several queries' parts read the routes: they are written once
    return out.select("origin", F.col("node").alias("destination"), "route").checkpoint()


def psl(spark: SparkSession, d: str) -> DataFrame:
    costs = edges(spark, d).select((F.col("link_id") * F.col("direction")).alias("link"), (F.col("distance") / 20).alias("cost"))
    return RC.path_size_logit(enumerated(spark, d), costs, 1.0, 0.1)


def key():
    return F.array_join(F.transform("route", lambda x: x.cast("string")), ",").alias("route")


@query(f"{ROUTES_SQL} SELECT origin, destination, key AS route FROM routes")
def route_enumerate(spark: SparkSession, d: str) -> DataFrame:
    return enumerated(spark, d).select("origin", "destination", key())


@query(f"{ROUTES_SQL} SELECT origin, destination, link, n FROM freq")
def route_link_frequency(spark: SparkSession, d: str) -> DataFrame:
    return RC.link_frequency(psl(spark, d).where("mask"))


@query(f"{ROUTES_SQL} SELECT origin, destination, key AS route, round(cost, 6) AS cost, mask FROM masked")
def psl_mask(spark: SparkSession, d: str) -> DataFrame:
    return psl(spark, d).select("origin", "destination", key(), *r6("cost"), "mask")


@query(f"{ROUTES_SQL} SELECT origin, destination, key AS route, round(ps, 6) AS path_overlap FROM psl")
def psl_overlap(spark: SparkSession, d: str) -> DataFrame:
    return psl(spark, d).select("origin", "destination", key(), *r6("path_overlap"))


@query(f"{ROUTES_SQL} SELECT origin, destination, key AS route, round(p, 6) AS probability FROM prob")
def psl_probability(spark: SparkSession, d: str) -> DataFrame:
    return psl(spark, d).select("origin", "destination", key(), *r6("probability"))


def loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    routes = psl(spark, d)
    return routes, D.demand(spark, d).join(routes.select("origin", "destination").distinct(), ["origin", "destination"], "left_semi")


@query(f"{ROUTES_SQL} SELECT abs(link) AS link_id, CAST(sign(link) AS BIGINT) AS direction, round(sum(p * trips), 4) AS volume FROM prob JOIN od USING (origin, destination) JOIN steps USING (origin, destination, key) GROUP BY 1, 2")
def route_link_loading(spark: SparkSession, d: str) -> DataFrame:
    return RC.load_routes(*loaded(spark, d), "trips").select("link_id", "direction", F.round("volume", 4).alias("volume"))


_AND_OR = {"both": [[(3, 1), (5, 1)], (9, 0)], "one": [(6, -1)]}
_IN_SETS = """hit AS (
  SELECT 'both' AS s, origin, destination, key FROM routes WHERE (list_contains(route, 3) AND list_contains(route, 5)) OR list_contains(route, 9) OR list_contains(route, -9)
  UNION ALL SELECT 'one', origin, destination, key FROM routes WHERE list_contains(route, -6))"""


@query(f"""{ROUTES_SQL}, {_IN_SETS} SELECT s AS "set", origin, destination, round(sum(p * trips), 4) AS volume FROM hit JOIN prob USING (origin, destination, key) JOIN od USING (origin, destination) GROUP BY ALL""")
def select_link_and_or(spark: SparkSession, d: str) -> DataFrame:
    od, _ = RC.select_link(*loaded(spark, d), "trips", RC.select_sets(spark, _AND_OR))
    return od.select("set", "origin", "destination", F.round("volume", 4).alias("volume"))


@query(f"""{ROUTES_SQL}, {_IN_SETS} SELECT s AS "set", abs(link) AS link_id, CAST(sign(link) AS BIGINT) AS direction, round(sum(p * trips), 4) AS volume FROM hit JOIN prob USING (origin, destination, key) JOIN od USING (origin, destination) JOIN steps USING (origin, destination, key) GROUP BY ALL""")
def select_link_route_flows(spark: SparkSession, d: str) -> DataFrame:
    _, links = RC.select_link(*loaded(spark, d), "trips", RC.select_sets(spark, _AND_OR))
    return links.select("set", "link_id", "direction", F.round("volume", 4).alias("volume"))


@query(f"""{ROUTES_SQL}, ends AS (SELECT link_id * direction AS link, tail, head, tail BETWEEN 3 AND 9 AS tin, head BETWEEN 3 AND 9 AS hin FROM edges),
pos AS (SELECT origin, destination, key, unnest(route) AS link, unnest(range(len(route))) AS i FROM routes),
touch AS (SELECT p.*, tail, head, i - row_number() OVER (PARTITION BY p.origin, p.destination, key ORDER BY i) AS run FROM pos p JOIN ends USING (link) WHERE tin OR hin),
cut AS (SELECT origin, destination, key, run, arg_min(tail, i) AS o, arg_max(head, i) AS d FROM touch GROUP BY ALL)
SELECT o AS origin, d AS destination, round(sum(p * trips), 4) AS volume FROM cut JOIN prob USING (origin, destination, key) JOIN od USING (origin, destination) WHERE o <> d GROUP BY o, d""")
def sub_area_demand(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select((F.col("link_id") * F.col("direction")).alias("link"), "tail", "head")
    inside = D.zones(spark, d).where("zone between 3 and 9").select(F.col("zone").alias("node"))
    return RC.sub_area(*loaded(spark, d), "trips", e, inside).select("origin", "destination", F.round("volume", 4).alias("volume"))


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    z = D.zones(spark, d)
    return z.select(F.col("zone").alias("origin")).join(z.select(F.col("zone").alias("destination")), F.col("origin") != F.col("destination"))


@query()
def bfsle_routes(spark: SparkSession, d: str) -> DataFrame:
    return RC.route_sets(spark, graph(spark, d), _all_pairs(spark, d), "bfsle", max_routes=5, max_depth=3)


@query()
def link_penalisation_routes(spark: SparkSession, d: str) -> DataFrame:
    return RC.route_sets(spark, graph(spark, d), _all_pairs(spark, d), "link-penalisation", max_routes=4, max_depth=30, penalty=1.1)


