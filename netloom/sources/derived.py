"""Transport objects derived from the driver tables: a network of nations, demand from orders, timetables from events, points from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("zone"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_id, a_node, b_node, direction, distance, free_flow_time, capacity: a ring of nations with chords."""
    k = F.col("n_nationkey").cast("long")
    ends = table(spark, sf_dir, "nation").select(F.explode(F.array(F.struct(k.alias("s"), ((k + 1) % 25).alias("t")), F.struct(k.alias("s"), ((3 * k + 7) % 25).alias("t")))).alias("e"))
    pairs = ends.select(F.least("e.s", "e.t").alias("a"), F.greatest("e.s", "e.t").alias("b")).where("a <> b").distinct()
    a, b = F.col("a"), F.col("b")
    distance = 10 + (7 * a + 13 * b) % 17 + a / F.lit(1000.0) + b / F.lit(7000.0)
    return pairs.select(
        F.row_number().over(W.orderBy("a", "b")).cast("long").alias("link_id"), (a + 1).alias("a_node"), (b + 1).alias("b_node"), F.when((a + b) % 3 != 0, 0).otherwise(1).alias("direction"),
        distance.alias("distance"), (distance / 2).alias("free_flow_time"), (500 + 100 * ((a * b) % 5)).cast("double").alias("capacity"),
    )


LINKS_SQL = """
nk AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation),
pairs AS (
  SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b
  FROM (SELECT k AS s, (k + 1) % 25 AS t FROM nk UNION ALL SELECT k, (3 * k + 7) % 25 FROM nk) WHERE s <> t
),
links AS (
  SELECT row_number() OVER (ORDER BY a, b) AS link_id, a + 1 AS a_node, b + 1 AS b_node, CASE WHEN (a + b) % 3 <> 0 THEN 0 ELSE 1 END AS direction,
         10 + (7 * a + 13 * b) % 17 + a / CAST(1000 AS DOUBLE) + b / CAST(7000 AS DOUBLE) AS distance,
         (10 + (7 * a + 13 * b) % 17 + a / CAST(1000 AS DOUBLE) + b / CAST(7000 AS DOUBLE)) / 2 AS free_flow_time, CAST(500 + 100 * ((a * b) % 5) AS DOUBLE) AS capacity
  FROM pairs
),
edges AS (
  SELECT link_id, 1 AS direction, a_node AS tail, b_node AS head, distance, free_flow_time, capacity FROM links WHERE direction <> -1
  UNION ALL
  SELECT link_id, -1, b_node, a_node, distance, free_flow_time, capacity FROM links WHERE direction <> 1
)"""


def trips(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One row for each line item: origin, destination (nation + 1), quantity and the named columns."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    orders = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = li.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select((F.col("c_nationkey") + 1).cast("long").alias("origin"), (F.col("s_nationkey") + 1).cast("long").alias("destination"), F.col("l_quantity").alias("trips"), *extra)


def demand(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    return trips(spark, sf_dir).groupBy("origin", "destination").agg((F.sum("trips") / scale).alias("trips"))


TRIPS_SQL = """
trips AS (
  SELECT CAST(c_nationkey + 1 AS BIGINT) AS origin, CAST(s_nationkey + 1 AS BIGINT) AS destination, l_quantity AS trips, l_returnflag, c_mktsegment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
),
od AS (SELECT origin, destination, sum(trips) AS trips FROM trips GROUP BY origin, destination)"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern, trip, seq, stop, arrival, departure: a trip is a user's events of one kind on one day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    trip = W.partitionBy("user_id", "event_type", "day").orderBy("ts", "event_id")
    at = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    rows = e.withColumn("day", F.to_date("ts")).withColumn("seq", F.row_number().over(trip) - 1).withColumn("arrival", at)
    key = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd"))
    return rows.select(F.col("event_type").alias("pattern"), key.alias("trip"), F.col("seq").cast("int").alias("seq"), (F.col("event_id") % 40).cast("long").alias("stop"), F.col("arrival").cast("int").alias("arrival"), (F.col("arrival") + 20).cast("int").alias("departure"))


SCHEDULE_SQL = """
schedule AS (
  SELECT event_type AS pattern, event_type || '|' || CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS trip,
         CAST(row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INTEGER) AS seq, event_id % 40 AS stop,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INTEGER) AS arrival, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) + 20 AS INTEGER) AS departure
  FROM events
)"""


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """id, x, y: keys spread over a square of 1,000 units by modular arithmetic."""
    k = F.col(key).cast("long")
    return table(spark, sf_dir, name).select(k.alias("id"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 997).cast("double").alias("y"))


def points_sql(name: str, table_name: str, key: str) -> str:
    return f"{name} AS (SELECT CAST({key} AS BIGINT) AS id, CAST((CAST({key} AS BIGINT) * 7919) % 1000 AS DOUBLE) AS x, CAST((CAST({key} AS BIGINT) * 104729) % 997 AS DOUBLE) AS y FROM {table_name})"
