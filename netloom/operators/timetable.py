"""Timetable operators: segment times, headways, repeated stops, conflicting times, frequencies, calendars, preloads, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A day's length; the longest headway where a stop has one departure.
DAY = 86_400


def segment_times(schedule: DataFrame) -> DataFrame:
    """(pattern, trip, seq, travel_time): arrival less the departure at the stop before; seq counts segments from 0."""
    before = F.lag("departure").over(W.partitionBy("pattern", "trip").orderBy("seq"))
    return schedule.withColumn("before", before).where("before is not null").select("pattern", "trip", (F.col("seq") - 1).alias("seq"), (F.col("arrival") - F.col("before")).alias("travel_time"))


def mean_segment_times(schedule: DataFrame, start: int, end: int) -> DataFrame:
    """(pattern, seq, travel_time): mean within the period, else over the day, else the period's length."""
    every = segment_times(schedule)
    day = every.groupBy("pattern", "seq").agg(F.avg("travel_time").alias("day_time"))
    inside = schedule.where(F.col("departure").between(start, end))
    period = segment_times(inside).groupBy("pattern", "seq").agg(F.avg("travel_time").alias("time"))
    return day.join(period, ["pattern", "seq"], "left").select("pattern", "seq", F.coalesce("time", "day_time", F.lit(float(end - start))).alias("travel_time"))


def headways(schedule: DataFrame, period: int = DAY) -> DataFrame:
    """(pattern, headway): the least time between arrivals at a stop of the pattern; the period where there is but one."""
    by = W.partitionBy("pattern", "seq").orderBy("arrival", "trip")
    gaps = schedule.withColumn("gap", F.col("arrival") - F.lag("arrival").over(by)).withColumn("n", F.count("*").over(W.partitionBy("pattern", "seq")))
    gaps = gaps.withColumn("gap", F.when(F.col("n") == 1, F.lit(period)).otherwise(F.col("gap")))
    return gaps.where("gap > 0").groupBy("pattern").agg(F.min("gap").alias("headway"))


def drop_repeated_stops(schedule: DataFrame) -> DataFrame:
    """Of consecutive calls of a trip at one stop the last stays; seq is numbered anew."""
    by = W.partitionBy("trip").orderBy("seq")
    kept = schedule.withColumn("after", F.lead("stop").over(by)).where("after is null or after <> stop")
    return kept.withColumn("seq", (F.row_number().over(by) - 1).cast("int")).drop("after")


def deconflict(schedule: DataFrame, distances: DataFrame | None = None, max_speed: float | None = None) -> DataFrame:
    """Arrivals and departures made to rise along a trip: a call as early as the one before moves it and all after by a second,
    and a segment faster than max_speed (distances(trip, seq, metres) from the stop before) by what it lacks."""
    by = W.partitionBy("trip").orderBy("seq")
    rows = schedule.withColumn("elapsed", F.col("arrival") - F.lag("departure").over(by))
    late = F.when(F.col("elapsed") <= 0, 1 - F.col("elapsed")).otherwise(0)
    if distances is not None and max_speed:
        rows = rows.join(distances.select("trip", "seq", "metres"), ["trip", "seq"], "left")
        speed = F.col("metres") / F.greatest(F.col("elapsed"), F.lit(1))
        late = F.when(speed > max_speed, (F.greatest(F.col("elapsed"), F.lit(1)) * (speed / max_speed - 1)).cast("int") + F.when(F.col("elapsed") <= 0, 1 - F.col("elapsed")).otherwise(0)).otherwise(late)
    moved = rows.withColumn("late", F.coalesce(late, F.lit(0))).withColumn("shift", F.sum("late").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return moved.select("pattern", "trip", "seq", "stop", (F.col("arrival") + F.col("shift")).cast("int").alias("arrival"), (F.col("departure") + F.col("shift")).cast("int").alias("departure"))


def expand_frequencies(frequencies: DataFrame) -> DataFrame:
    """(trip, start): a departure every headway from start to end, both included; the copies' ids are trip-start."""
    every = frequencies.where("headway > 0 and end_time >= start_time").select("trip", F.explode(F.sequence("start_time", "end_time", "headway")).alias("start"))
    return every.select(F.concat_ws("-", "trip", F.col("start").cast("string")).alias("trip"), "start")


def service_dates(calendar: DataFrame) -> DataFrame:
    """(service, date) of calendar(service, start_date, end_date, days array<int> of Monday to Sunday)."""
    each = calendar.select("service", "days", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    return each.where(F.element_at("days", F.weekday("date") + 1) == 1).select("service", "date")


def with_exceptions(dates: DataFrame, exceptions: DataFrame) -> DataFrame:
    """exceptions(service, date, kind): 1 adds a date, 2 removes it; any other kind is an error."""
    wrong = exceptions.where(~F.col("kind").isin(1, 2) | F.col("kind").isNull())
    if not wrong.isEmpty():
        raise ValueError("exceptions must be 1 or 2")
    added = dates.union(exceptions.where("kind = 1").select("service", "date")).distinct()
    return added.join(exceptions.where("kind = 2").select("service", "date"), ["service", "date"], "left_anti")


#: Which trips count as within a period.
CHOICES = {
    "start": "first between {s} and {e}",
    "end": "last between {s} and {e}",
    "midpoint": "(first + last) / 2 between {s} and {e}",
    "any": "first <= {e} and last >= {s}",
}


def pt_preload(schedule: DataFrame, mapping: DataFrame, routes: DataFrame, start: int, end: int, choice: str = "start") -> DataFrame:
    """(link_id, direction, preload): passenger-car units of trips by mapping(pattern, link_id, direction) and routes(pattern, pce)."""
    if choice not in CHOICES:
        raise ValueError(f"no choice {choice!r}; there are {', '.join(CHOICES)}")
    spans = schedule.groupBy("pattern", "trip").agg(F.min("departure").alias("first"), F.max("arrival").alias("last"))
    inside = spans.where(CHOICES[choice].format(s=int(start), e=int(end))).groupBy("pattern").agg(F.count("*").alias("n"))
    return inside.join(routes, "pattern").join(mapping, "pattern").groupBy("link_id", "direction").agg(F.sum(F.col("n") * F.col("pce")).alias("preload"))


def patterns(schedule: DataFrame) -> DataFrame:
    """(pattern, stops, hash, trips): trips of a route with one sequence of stops; the hash is md5 of route and stops."""
    seqs = schedule.groupBy("pattern", "trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda s: s["stop"]).alias("stops"))
    grouped = seqs.groupBy("pattern", "stops").agg(F.count("*").alias("trips"))
    return grouped.withColumn("hash", F.md5(F.concat(F.col("pattern"), F.array_join(F.transform("stops", lambda s: s.cast("string")), ""))))


def stop_pairs(calls: DataFrame) -> DataFrame:
    """(trip, seq, stop, next): consecutive stops of calls(trip, seq, stop); of a pair that a trip repeats, the first."""
    following = F.lead("stop").over(W.partitionBy("trip").orderBy("seq"))
    pairs = calls.select("trip", "seq", "stop", following.alias("next")).where("next is not null")
    return pairs.withColumn("__k", F.row_number().over(W.partitionBy("trip", "stop", "next").orderBy("seq"))).where("__k = 1").drop("__k")


def in_order(trips: DataFrame) -> DataFrame:
    """(pattern, trip, position) of calls(pattern, trip, seq, departure): a pattern's trips by their first departure, then by name."""
    first = trips.groupBy("pattern", "trip").agg(F.min_by("departure", "seq").alias("first"))
    return first.select("pattern", "trip", (F.row_number().over(W.partitionBy("pattern").orderBy("first", "trip")) - 1).cast("long").alias("position"))


def histogram(table: DataFrame, column: str) -> DataFrame:
    """(column, n)."""
    return table.groupBy(column).agg(F.count("*").alias("n"))
