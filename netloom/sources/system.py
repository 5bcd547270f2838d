"""A transit system as tables: made of a schedule, kept as Parquet, read again, and written as a whole feed."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.scalars import to_feed_time
from netloom.operators.graph import numbered
from netloom.operators.spatial import closest_zone

TABLES = ("stops", "routes", "patterns", "pattern_stops", "trips", "trips_schedule")
AGENCY = "agency"


def system_of(schedule: DataFrame, stops: DataFrame, zones: DataFrame | None = None, size: float = 100.0) -> dict[str, DataFrame]:
    """Tables of schedule(pattern, trip, seq, stop, arrival, departure) and stops(stop, x, y, name): trips of a route with one sequence of stops are
    one pattern. Routes and patterns are numbered by name and stops. A stop gets the zone that holds it, or whose border is nearest."""
    route = F.split_part(F.col("pattern").cast("string"), F.lit("|"), F.lit(1))
    calls = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda s: s["stop"])
    by_trip = schedule.groupBy("trip", route.alias("route")).agg(calls.alias("calls"))
    routes = numbered(by_trip.select("route").distinct(), ["route"], "route_id", 1)
    patterns = numbered(by_trip.groupBy("route", "calls").agg(F.count("*").alias("n_trips")), ["route", "calls"], "pattern_id", 1).join(routes, "route")
    trips = by_trip.join(patterns.select("route", "calls", "pattern_id"), ["route", "calls"]).select("trip", "pattern_id")
    placed = stops.select("stop", "x", "y", "name")
    if zones is not None:
        placed = placed.join(closest_zone(stops.select(F.col("stop").alias("id"), "x", "y"), zones, size).withColumnRenamed("id", "stop"), "stop", "left")
    return {
        "stops": placed,
        "routes": routes,
        "patterns": patterns.select("pattern_id", "route_id", "n_trips", F.size("calls").alias("n_stops")),
        "pattern_stops": patterns.select("pattern_id", F.posexplode("calls").alias("seq", "stop")),
        "trips": trips,
        "trips_schedule": schedule.select("trip", "seq", "arrival", "departure"),
    }


def save_system(system: dict[str, DataFrame], path: str) -> None:
    for name in TABLES:
        system[name].write.parquet(f"{path}/{name}")


def read_system(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def calls_of(system: dict[str, DataFrame]) -> DataFrame:
    """(pattern_id, trip, seq, stop, arrival, departure) of a system: its timetable again, seq from 0."""
    times = system["trips_schedule"].join(system["trips"], "trip")
    return times.join(system["pattern_stops"], ["pattern_id", "seq"]).select("pattern_id", "trip", "seq", "stop", "arrival", "departure")


def feed_tables(system: dict[str, DataFrame], agency: str = "netloom", zone: str = "UTC", first: str = "20200101", last: str = "20991231", kind: int = 3) -> dict[str, DataFrame]:
    """The tables of a feed (all days, one service): agency, calendar, stops, routes, trips, stop_times, and shapes of straight lines between stops."""
    spark = system["stops"].sparkSession
    days = ", ".join(f"1 {d}" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    shape = system["pattern_stops"].join(system["stops"].select("stop", "x", "y"), "stop")
    return {
        "agency": spark.createDataFrame([(AGENCY, agency, "https://example.com", zone)], "agency_id string, agency_name string, agency_url string, agency_timezone string"),
        "calendar": spark.range(1).selectExpr("'daily' service_id", *days.split(", "), f"'{first}' start_date", f"'{last}' end_date"),
        "stops": system["stops"].select(F.col("stop").alias("stop_id"), F.col("name").alias("stop_name"), F.col("y").alias("stop_lat"), F.col("x").alias("stop_lon"), *(["zone"] if "zone" in system["stops"].columns else [])).withColumnsRenamed({"zone": "zone_id"}),
        "routes": system["routes"].select("route_id", F.lit(AGENCY).alias("agency_id"), F.col("route").alias("route_short_name"), F.lit(kind).alias("route_type")),
        "trips": system["trips"].join(system["patterns"].select("pattern_id", "route_id"), "pattern_id").select("route_id", F.lit("daily").alias("service_id"), F.col("trip").alias("trip_id"), F.col("pattern_id").alias("shape_id")),
        "stop_times": calls_of(system).select(F.col("trip").alias("trip_id"), to_feed_time(F.col("arrival")).alias("arrival_time"), to_feed_time(F.col("departure")).alias("departure_time"), F.col("stop").alias("stop_id"), F.col("seq").alias("stop_sequence")),
        "shapes": shape.select(F.col("pattern_id").alias("shape_id"), F.col("y").alias("shape_pt_lat"), F.col("x").alias("shape_pt_lon"), F.col("seq").alias("shape_pt_sequence")),
    }


def write_whole_feed(system: dict[str, DataFrame], folder: str, **more) -> None:
    """Each table as a folder of CSV parts, with a header in each."""
    for name, df in feed_tables(system, **more).items():
        df.write.mode("overwrite").csv(f"{folder}/{name}.txt", header=True)


def zip_feed(folder: str, target: str) -> None:
    """One archive of such folders, part after part under one header; for a folder that the driver can open."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for table in sorted(Path(folder).glob("*.txt")):
            with archive.open(table.name, "w") as out:
                head = None
                for part in sorted(table.glob("part-*.csv")):
                    with part.open("rb") as rows:
                        line = rows.readline()
                        if head is None:
                            head = line
                            out.write(line)
                        for row in rows:
                            out.write(row)
