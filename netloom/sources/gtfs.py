"""GTFS feeds: tables as CSV with fixed schemas, calendars, trips of a date; and the writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.scalars import to_seconds, to_feed_time
from netloom.operators import timetable as T

# The columns that are read of each table of a feed.
TABLES = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_phone string, agency_fare_url string, agency_email string",
    "routes": "route_id string, route_short_name string, route_long_name string, route_desc string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, shape_id string, direction_id int",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "fare_attributes": "fare_id string, price double, currency_type string, payment_method int, transfers int, transfer_duration double",
    "fare_rules": "fare_id string, route_id string, origin_id string, destination_id string, contains_id string",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs string",
    "stops": "stop_id string, stop_name string, stop_desc string, stop_lat double, stop_lon double, stop_street string, zone_id string, parent_station string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a feed: columns by name in any case and order, missing ones empty, other characters than ASCII dropped,
    numbers from text (blank is 0, 1.0 is 1), blank lines dropped. A table that isn't there is empty."""
    wanted = [c.split() for c in TABLES[name].split(", ")]
    empty = spark.createDataFrame([], TABLES[name])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty
    raw = spark.read.csv(f"{folder}/{name}.txt", header=True, inferSchema=False, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    known = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}

    def column(c: str, kind: str):
        if c not in known:
            return F.lit("" if kind == "string" else 0).cast(kind).alias(c)
        text = F.coalesce(F.regexp_replace(F.col(f"`{known[c]}`"), r"[^\x00-\x7F]", ""), F.lit(""))
        return (text if kind == "string" else F.coalesce(F.when(text != "", text.try_cast("double")), F.lit(0.0)).cast(kind)).alias(c)

    some = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns])
    return raw.where(some.isNotNull()).select(*[column(c, k) for c, k in wanted])


def dates_of_services(spark: SparkSession, folder: str) -> DataFrame:
    """(service, date) by calendar and calendar_dates."""
    day = lambda c: F.to_date(F.regexp_replace(c, "-", ""), "yyyyMMdd")
    days = F.array("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    calendar = read_table(spark, folder, "calendar").select(F.col("service_id").alias("service"), day("start_date").alias("start_date"), day("end_date").alias("end_date"), days.alias("days"))
    more = read_table(spark, folder, "calendar_dates").select(F.col("service_id").alias("service"), day("date").alias("date"), F.col("exception_type").alias("kind"))
    return T.with_exceptions(T.service_dates(calendar), more)


def schedule_of(spark: SparkSession, folder: str, date: str) -> DataFrame:
    """(pattern, trip, seq, stop, arrival, departure) of the trips that run on a date: repeated stops dropped, times made to rise,
    frequencies expanded. The pattern is route and direction; blank times take the last known one."""
    dates = dates_of_services(spark, folder).where(F.col("date") == F.to_date(F.lit(date)))
    trips = read_table(spark, folder, "trips").join(dates.select(F.col("service").alias("service_id")), "service_id", "left_semi")
    by = W.partitionBy("trip_id").orderBy("stop_sequence")
    calls = read_table(spark, folder, "stop_times").join(trips.select("trip_id", F.concat_ws("|", "route_id", F.col("direction_id").cast("string")).alias("pattern")), "trip_id")
    filled = lambda c: F.last(to_seconds(F.col(c)), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = calls.withColumn("arrival", filled("arrival_time")).withColumn("departure", F.greatest(filled("departure_time"), F.col("arrival")))
    rows = rows.select("pattern", F.col("trip_id").alias("trip"), F.col("stop_sequence").alias("seq"), F.col("stop_id").alias("stop"), "arrival", "departure")
    rows = T.deconflict(T.drop_repeated_stops(rows))
    freq = read_table(spark, folder, "frequencies").select(F.col("trip_id").alias("trip"), to_seconds(F.col("start_time")).alias("start_time"), to_seconds(F.col("end_time")).alias("end_time"), F.col("headway_secs").try_cast("int").alias("headway"))
    copies = T.expand_frequencies(freq).withColumn("template", F.regexp_replace("trip", r"-\d+$", ""))
    first = rows.groupBy("trip").agg(F.min("arrival").alias("first"))
    moved = rows.join(first, "trip").join(copies.select(F.col("template").alias("trip"), F.col("trip").alias("copy"), "start"), "trip")
    moved = moved.select("pattern", F.col("copy").alias("trip"), "seq", "stop", (F.col("arrival") - F.col("first") + F.col("start")).cast("int").alias("arrival"), (F.col("departure") - F.col("first") + F.col("start")).cast("int").alias("departure"))
    return rows.join(freq.select("trip").distinct(), "trip", "left_anti").select(moved.columns).union(moved)


def geometry_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(source, n): trips with and without a shape that exists."""
    shapes = read_table(spark, folder, "shapes").select("shape_id").distinct().withColumn("has", F.lit(True))
    return read_table(spark, folder, "trips").join(shapes, "shape_id", "left").groupBy(F.when(F.col("has"), "shape").otherwise("stops").alias("source")).agg(F.count("*").alias("n"))


def write_feed(schedule: DataFrame, stops: DataFrame, folder: str) -> None:
    """stops(stop, name, x, y) and schedule as stops, routes, trips and stop_times folders of CSV."""
    def put(df: DataFrame, name: str) -> None:
        df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.txt", header=True)

    put(stops.select(F.col("stop").alias("stop_id"), F.col("name").alias("stop_name"), F.col("y").alias("stop_lat"), F.col("x").alias("stop_lon")), "stops")
    route = F.split_part("pattern", F.lit("|"), F.lit(1))
    put(schedule.select(route.alias("route_id")).distinct().withColumn("route_type", F.lit(3)), "routes")
    put(schedule.select(route.alias("route_id"), F.lit("daily").alias("service_id"), F.col("trip").alias("trip_id")).distinct(), "trips")
    put(schedule.select(F.col("trip").alias("trip_id"), to_feed_time(F.col("arrival")).alias("arrival_time"), to_feed_time(F.col("departure")).alias("departure_time"), F.col("stop").alias("stop_id"), F.col("seq").alias("stop_sequence")), "stop_times")
