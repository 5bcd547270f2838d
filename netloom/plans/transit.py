"""Queries over timetables and transit graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import timetable as T
from netloom.operators import transit as X
from netloom.plans.network import r6
from netloom.plans.registry import query
from netloom.sources import derived as D

S = f"WITH {D.SCHEDULE_SQL}"


@query(f"""{S} SELECT pattern, trip, seq - 1 AS seq, arrival - prev AS travel_time FROM (SELECT *, lag(departure) OVER (PARTITION BY pattern, trip ORDER BY seq) AS prev FROM schedule) WHERE prev IS NOT NULL""")
def segment_travel_time(spark: SparkSession, d: str) -> DataFrame:
    return T.segment_times(D.schedule(spark, d))


SEG_SQL = """seg AS (SELECT pattern, trip, seq - 1 AS seq, arrival - prev AS t, departure FROM (SELECT *, lag(departure) OVER (PARTITION BY pattern, trip ORDER BY seq) AS prev FROM {0}) WHERE prev IS NOT NULL)"""


@query(f"""{S}, {SEG_SQL.format("schedule")}, inside AS (SELECT * FROM schedule WHERE departure BETWEEN 21600 AND 36000), {SEG_SQL.format("inside").replace("seg AS", "seg2 AS", 1)},
a AS (SELECT pattern, seq, avg(t) AS t FROM seg GROUP BY ALL), b AS (SELECT pattern, seq, avg(t) AS t FROM seg2 GROUP BY ALL)
SELECT a.pattern, a.seq, round(coalesce(b.t, a.t, 14400), 6) AS travel_time FROM a LEFT JOIN b USING (pattern, seq)""")
def segment_mean_travel_time(spark: SparkSession, d: str) -> DataFrame:
    return T.mean_segment_times(D.schedule(spark, d), 21600, 36000).select("pattern", "seq", *r6("travel_time"))


@query(f"""{S}, g AS (SELECT pattern, CASE WHEN count(*) OVER (PARTITION BY pattern, seq) = 1 THEN 86400 ELSE arrival - lag(arrival) OVER (PARTITION BY pattern, seq ORDER BY arrival, trip) END AS gap FROM schedule)
SELECT pattern, min(gap) AS headway FROM g WHERE gap > 0 GROUP BY pattern""")
def headway(spark: SparkSession, d: str) -> DataFrame:
    return T.headways(D.schedule(spark, d))


@query(f"""{S}, m AS (SELECT *, lead(stop % 4) OVER (PARTITION BY trip ORDER BY seq) AS nxt FROM schedule), k AS (SELECT * FROM m WHERE nxt IS NULL OR nxt <> stop % 4)
SELECT pattern, trip, CAST(row_number() OVER (PARTITION BY trip ORDER BY seq) - 1 AS INTEGER) AS seq, stop % 4 AS stop, arrival, departure FROM k""")
def drop_repeated_stops(spark: SparkSession, d: str) -> DataFrame:
    return T.drop_repeated_stops(D.schedule(spark, d).withColumn("stop", F.col("stop") % 4)).select("pattern", "trip", "seq", "stop", "arrival", "departure")


@query(f"""{S}, c AS (SELECT pattern, trip, seq, stop, arrival // 600 * 600 AS arrival, arrival // 600 * 600 + 20 AS departure FROM schedule),
l AS (SELECT *, arrival - lag(departure) OVER (PARTITION BY trip ORDER BY seq) AS e FROM c),
x AS (SELECT *, sum(CASE WHEN e <= 0 THEN 1 - e ELSE 0 END) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT pattern, trip, seq, stop, CAST(arrival + s AS INTEGER) AS arrival, CAST(departure + s AS INTEGER) AS departure FROM x""")
def deconflict_times(spark: SparkSession, d: str) -> DataFrame:
    coarse = D.schedule(spark, d).withColumn("arrival", (F.floor(F.col("arrival") / 600) * 600).cast("int")).withColumn("departure", F.col("arrival") + 20)
    return T.deconflict(coarse)


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey")).alias("trip"), (21600 + F.col("n_nationkey") * 60).cast("int").alias("start_time"), (25200 + F.col("n_nationkey") * 90).cast("int").alias("end_time"), (300 + F.col("n_nationkey") * 10).cast("int").alias("headway"))


@query("SELECT 't' || n_nationkey || '-' || s AS trip, CAST(s AS INTEGER) AS start FROM (SELECT n_nationkey, unnest(generate_series(21600 + n_nationkey * 60, 25200 + n_nationkey * 90, 300 + n_nationkey * 10)) AS s FROM nation)")
def frequency_expand(spark: SparkSession, d: str) -> DataFrame:
    return T.expand_frequencies(_frequencies(spark, d))


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return D.table(spark, d, "region").select(k.cast("long").alias("service"), F.to_date(F.lit("2024-01-01")).alias("start_date"), F.date_add(F.to_date(F.lit("2024-01-20")), k).alias("end_date"), F.array(*[((k + i) % 3 != 0).cast("int") for i in range(7)]).alias("days"))


DATES_SQL = "dates AS (SELECT CAST(k AS BIGINT) AS service, dt AS date FROM (SELECT r_regionkey AS k, CAST(unnest(generate_series(DATE '2024-01-01', CAST(DATE '2024-01-20' + CAST(r_regionkey AS INTEGER) AS DATE), INTERVAL 1 DAY)) AS DATE) AS dt FROM region) WHERE (k + isodow(dt) - 1) % 3 <> 0)"


@query(f"WITH {DATES_SQL} SELECT service, CAST(date AS VARCHAR) AS date FROM dates")
def service_dates(spark: SparkSession, d: str) -> DataFrame:
    return T.service_dates(_calendar(spark, d)).select("service", F.col("date").cast("string").alias("date"))


@query(f"WITH {DATES_SQL}, ex AS (SELECT CAST(r_regionkey AS BIGINT) AS service, DATE '2024-02-01' AS date, 1 AS kind FROM region UNION ALL SELECT r_regionkey, DATE '2024-01-05', 2 FROM region) SELECT service, CAST(date AS VARCHAR) AS date FROM (SELECT service, date FROM dates UNION SELECT service, date FROM ex WHERE kind = 1) x WHERE NOT EXISTS (SELECT 1 FROM ex WHERE kind = 2 AND ex.service = x.service AND ex.date = x.date)")
def calendar_exceptions(spark: SparkSession, d: str) -> DataFrame:
    r = D.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("service"))
    ex = r.select("service", F.to_date(F.lit("2024-02-01")).alias("date"), F.lit(1).alias("kind")).union(r.select("service", F.to_date(F.lit("2024-01-05")), F.lit(2)))
    return T.with_exceptions(T.service_dates(_calendar(spark, d)), ex).select("service", F.col("date").cast("string").alias("date"))


MAP_SQL = "mapping AS (SELECT pattern, link_id, 1 - 2 * (link_id % 2) AS direction FROM (SELECT DISTINCT event_type AS pattern FROM events) p CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS link_id) WHERE (link_id + length(pattern)) % 3 <> 0), rt AS (SELECT DISTINCT event_type AS pattern, 1 + length(event_type) / 4.0 AS pce FROM events)"


def _mapping(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = D.table(spark, d, "events").select(F.col("event_type").alias("pattern")).distinct()
    m = p.select("pattern", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("link_id")).where((F.col("link_id") + F.length("pattern")) % 3 != 0)
    return m.select("pattern", F.col("link_id").cast("long").alias("link_id"), (1 - 2 * (F.col("link_id") % 2)).cast("long").alias("direction")), p.select("pattern", (1 + F.length("pattern") / 4).alias("pce"))


def _preload(choice: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        m, r = _mapping(spark, d)
        return T.pt_preload(D.schedule(spark, d), m, r, 21600, 43200, choice).select("link_id", "direction", *r6("preload"))

    run.__name__ = f"pt_preload_{choice}"
    where = T.CHOICES[choice].format(s=21600, e=43200).replace("first", "f").replace("last", "l")
    return query(f"""{S}, {MAP_SQL}, t AS (SELECT pattern, trip, min(departure) AS f, max(arrival) AS l FROM schedule GROUP BY ALL), n AS (SELECT pattern, count(*) AS n FROM t WHERE {where} GROUP BY pattern)
SELECT link_id, direction, round(sum(n * pce), 6) AS preload FROM n JOIN rt USING (pattern) JOIN mapping USING (pattern) GROUP BY ALL""")(run)


for _c in T.CHOICES:
    _preload(_c)


@query(f"""{S}, p AS (SELECT pattern, trip, string_agg(CAST(stop AS VARCHAR), '' ORDER BY seq) AS s, string_agg(CAST(stop AS VARCHAR), ',' ORDER BY seq) AS stops FROM schedule GROUP BY ALL)
SELECT pattern, stops, count(*) AS trips, md5(pattern || s) AS hash FROM p GROUP BY pattern, s, stops""")
def gtfs_patterns(spark: SparkSession, d: str) -> DataFrame:
    return T.patterns(D.schedule(spark, d)).select("pattern", F.array_join(F.transform("stops", lambda s: s.cast("string")), ",").alias("stops"), "trips", "hash")


# A small transit system: each region is a line over stops (region * 3 + seq * 7) % 20, six segments long.
LINES_SQL = """ln AS (SELECT r_regionkey AS k, 'L' || r_regionkey AS line, 300 + 120 * r_regionkey AS headway FROM region),
segments AS (SELECT line, CAST(i AS INTEGER) AS seq, CAST((k * 3 + i * 7) % 20 AS BIGINT) AS from_stop, CAST((k * 3 + (i + 1) * 7) % 20 AS BIGINT) AS to_stop, CAST(120 + 30 * i + 7 * k AS DOUBLE) AS travel_time FROM ln CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS i)),
stops AS (SELECT CAST(i AS BIGINT) AS stop, CAST(i % 8 AS BIGINT) AS station, CAST((i * 37) % 100 AS DOUBLE) AS x, CAST((i * 53) % 90 AS DOUBLE) AS y FROM (SELECT unnest(generate_series(0, 19)) AS i))"""


def system(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """segments, stops and headways."""
    k = F.col("r_regionkey")
    lines = D.table(spark, d, "region").select(k.alias("k"), F.concat(F.lit("L"), k).alias("line"), (300 + 120 * k).alias("headway"))
    seg = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    segments = seg.select("line", F.col("i").alias("seq"), ((F.col("k") * 3 + F.col("i") * 7) % 20).cast("long").alias("from_stop"), ((F.col("k") * 3 + (F.col("i") + 1) * 7) % 20).cast("long").alias("to_stop"), (120 + 30 * F.col("i") + 7 * F.col("k")).cast("double").alias("travel_time"))
    i = F.col("id")
    stops = spark.range(20).select(i.alias("stop"), (i % 8).alias("station"), ((i * 37) % 100).cast("double").alias("x"), ((i * 53) % 90).cast("double").alias("y"))
    return segments, stops, lines.select("line", "headway")


def zone_points(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(1, 5).select(i, ((i * 31) % 100).cast("double").alias("x"), ((i * 17) % 90).cast("double").alias("y"))


def full_graph(spark: SparkSession, d: str, **options) -> tuple[DataFrame, DataFrame]:
    from netloom.operators.spatial import nearest

    segments, stops, heads = system(spark, d)
    z = zone_points(spark)
    near = nearest(stops.select(F.col("stop").alias("id"), "x", "y"), z).select(F.col("a").alias("stop"), F.col("b").alias("zone"), "distance")
    return X.transit_edges(segments, stops, z.select(F.col("id").alias("zone")), heads, near, **options)


def _named(v: DataFrame, e: DataFrame, kind: str, tail: str, head: str) -> DataFrame:
    """Edges of a kind with their ends' stop, line and seq, which don't depend on the numbering."""
    t, h = (v.select(F.col("node").alias(n), F.col("stop").alias(f"{n}_stop"), F.col("line").alias(f"{n}_line"), F.col("seq").alias(f"{n}_seq")) for n in ("tail", "head"))
    return e.where(F.col("kind") == kind).drop("line").join(t, "tail").join(h, "head")


@query(f"WITH {LINES_SQL} SELECT s.from_stop AS stop, line, seq, round(15 + 1e-6, 6) AS time, round(1.0 / headway, 9) AS freq FROM segments s JOIN ln USING (line)")
def boarding_edges(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return _named(v, e, "boarding", "stop", "boarding").select(F.col("tail_stop").alias("stop"), F.col("head_line").alias("line"), F.col("head_seq").alias("seq"), *r6("time"), F.round("freq", 9).alias("freq"))


@query(f"WITH {LINES_SQL} SELECT line, seq, seq + 1 AS next_seq, CAST(30 AS DOUBLE) AS time FROM segments WHERE seq < 5")
def dwell_edges(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return _named(v, e, "dwell", "", "").select(F.col("tail_line").alias("line"), F.col("tail_seq").alias("seq"), F.col("head_seq").alias("next_seq"), "time")


@query(f"WITH {LINES_SQL} SELECT a.to_stop AS stop, a.line AS from_line, a.seq AS from_seq, b.line AS to_line, b.seq AS to_seq FROM segments a JOIN segments b ON a.to_stop = b.from_stop WHERE a.line <> b.line")
def inner_transfers(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return _named(v, e, "inner_transfer", "", "").select(F.col("tail_stop").alias("stop"), F.col("tail_line").alias("from_line"), F.col("tail_seq").alias("from_seq"), F.col("head_line").alias("to_line"), F.col("head_seq").alias("to_seq"))


@query(f"""WITH {LINES_SQL} SELECT a.line AS from_line, a.seq AS from_seq, b.line AS to_line, b.seq AS to_seq, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) + 480, 6) AS time
FROM segments a JOIN stops p ON a.to_stop = p.stop JOIN stops q ON p.station = q.station AND p.stop <> q.stop JOIN segments b ON b.from_stop = q.stop WHERE a.line <> b.line""")
def outer_transfers(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return _named(v, e, "outer_transfer", "", "").select(F.col("tail_line").alias("from_line"), F.col("tail_seq").alias("from_seq"), F.col("head_line").alias("to_line"), F.col("head_seq").alias("to_seq"), *r6("time"))


@query(f"WITH {LINES_SQL} SELECT p.stop AS from_stop, q.stop AS to_stop, round(greatest(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 1e-6), 6) AS time FROM stops p JOIN stops q ON p.station = q.station AND p.stop <> q.stop")
def walking_edges(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return _named(v, e, "walking", "", "").select(F.col("tail_stop").alias("from_stop"), F.col("head_stop").alias("to_stop"), *r6("time"))


@query(f"""WITH {LINES_SQL} SELECT 'on-board' AS kind, count(*) AS n FROM segments UNION ALL SELECT 'boarding', count(*) FROM segments UNION ALL SELECT 'alighting', count(*) FROM segments UNION ALL SELECT 'dwell', count(*) FROM segments WHERE seq < 5
UNION ALL SELECT 'access_connector', count(*) FROM stops UNION ALL SELECT 'egress_connector', count(*) FROM stops
UNION ALL SELECT 'inner_transfer', count(*) FROM segments a JOIN segments b ON a.to_stop = b.from_stop AND a.line <> b.line
UNION ALL SELECT 'outer_transfer', count(*) FROM segments a JOIN stops p ON a.to_stop = p.stop JOIN stops q ON p.station = q.station AND p.stop <> q.stop JOIN segments b ON b.from_stop = q.stop AND a.line <> b.line
UNION ALL SELECT 'walking', count(*) FROM stops p JOIN stops q ON p.station = q.station AND p.stop <> q.stop""")
def transit_edges_union(spark: SparkSession, d: str) -> DataFrame:
    return full_graph(spark, d)[1].groupBy("kind").agg(F.count("*").alias("n"))


def _demand(spark: SparkSession, v: DataFrame) -> DataFrame:
    o, t = v.where("kind = 'origin'").select(F.col("node").alias("origin"), F.col("zone").alias("oz")), v.where("kind = 'destination'").select(F.col("node").alias("destination"), F.col("zone").alias("dz"))
    return o.join(t, F.col("oz") != F.col("dz")).select("origin", "destination", (F.col("oz") * 10 + F.col("dz")).cast("double").alias("trips"))


@query()
def hyperpath_volumes(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return X.optimal_strategies(spark, e, _demand(spark, v))[0]


#: The four-line example of Spiess and Florian (1989): (stops, minutes, headway in minutes, first number of its nodes); and its published strategy.
_EXAMPLE = (([0, 3], [25], 12, 10), ([0, 1, 2], [7, 6], 12, 20), ([1, 2, 3], [4, 4], 30, 30), ([2, 3], [10], 6, 40))
_STRATEGY_SQL = "(VALUES (0, 10, 1 / 2.0), (10, 11, 1 / 2.0), (11, 3, 1 / 2.0), (0, 20, 1 / 2.0), (20, 21, 1 / 2.0), (21, 22, 1 / 2.0), (22, 23, 1 / 2.0), (23, 2, 1 / 2.0), (2, 32, 1 / 12.0), (32, 33, 1 / 12.0), (33, 3, 1 / 12.0), (2, 40, 5 / 12.0), (40, 41, 5 / 12.0), (41, 3, 5 / 12.0)) AS t(a, b, share)"


def _example(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A copy of the example for each nation, with its customers as demand."""
    rows = []
    for stops, minutes, headway, base in _EXAMPLE:
        for k, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
            on, off = base + 2 * k, base + 2 * k + 1
            rows += [(a, on, 0.0, 2 / (headway * 60.0)), (on, off, minutes[k] * 60.0, float("inf")), (off, b, 0.0, float("inf"))] + [(off - 2, on, 0.0, float("inf"))] * (k > 0)
    one = spark.createDataFrame(rows, "a long, b long, time double, freq double")
    copies = D.zones(spark, d).select((F.col("zone") * 1000).alias("at")).join(one)  # two lists of fixed length
    edges = copies.select((F.col("at") * 10_000 + F.col("a") * 100 + F.col("b")).alias("edge"), (F.col("at") + F.col("a")).alias("tail"), (F.col("at") + F.col("b")).alias("head"), "time", "freq", F.lit("line").alias("kind"))
    riders = D.table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).cast("long").alias("zone")).agg(F.count("*").cast("double").alias("trips"))
    return edges, riders.select((F.col("zone") * 1000).alias("origin"), (F.col("zone") * 1000 + 3).alias("destination"), "trips")


@query(f"WITH r AS (SELECT c_nationkey + 1 AS zone, count(*) AS n FROM customer GROUP BY 1) SELECT CAST(zone * 1000 + a AS BIGINT) AS tail, CAST(zone * 1000 + b AS BIGINT) AS head, round(n * share, 4) AS volume FROM r CROSS JOIN {_STRATEGY_SQL}")
def strategy_volumes(spark: SparkSession, d: str) -> DataFrame:
    edges, demand = _example(spark, d)
    volume = X.optimal_strategies(spark, edges, demand)[0].join(edges, "edge")
    return volume.select("tail", "head", F.round("volume", 4).alias("volume")).where("volume > 0")


@query("SELECT CAST((c_nationkey + 1) * 1000 AS BIGINT) AS origin, CAST((c_nationkey + 1) * 1000 + 3 AS BIGINT) AS destination, CAST(1665 AS DOUBLE) AS time FROM customer GROUP BY c_nationkey")
def strategy_times(spark: SparkSession, d: str) -> DataFrame:
    edges, demand = _example(spark, d)
    return X.optimal_strategies(spark, edges, demand)[1].select("origin", "destination", F.round("time", 3).alias("time"))


@query()
def transit_skims(spark: SparkSession, d: str) -> DataFrame:
    v, e = full_graph(spark, d)
    return X.waiting_time(X.optimal_strategies(spark, e, _demand(spark, v), skims=["boardings", "transfers", "in_vehicle_time", "access_time", "egress_time"])[1])


@query("SELECT event_type AS link, CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS volume FROM events GROUP BY ALL")
def link_counts(spark: SparkSession, d: str) -> DataFrame:
    from netloom.streaming.counts import link_counts as counts

    rows = D.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("link"), F.col("value").alias("pce"))
    return counts(rows, "6 hours").select("link", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("volume", 4).alias("volume"))
