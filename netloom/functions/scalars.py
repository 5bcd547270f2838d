"""Scalar functions: distances, bearings, times of day, mode strings, units, deterrence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radii in metres: of the network utilities, and of the path search's heuristics.
EARTH, EARTH_SEARCH = 6_367_000.0, 6_371_000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    lon1, lat1, lon2, lat2 = map(F.radians, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(a))


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_SEARCH) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return radius * F.sqrt(x * x + y * y)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees between 0 and 90: the angle with the x axis, whatever the direction."""
    return F.degrees(F.atan2(F.abs(y2 - y1), F.abs(x2 - x1)))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone."""
    return F.when(lat >= 0, 32600).otherwise(32700) + F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)


def to_seconds(text: Column) -> Column:
    """Seconds from midnight of HH:MM:SS (hours may pass 24) or N day(s), HH:MM:SS; null if it isn't such a text."""
    days = F.coalesce(F.regexp_extract(text, r"^\s*(\d+) days?,", 1).try_cast("int"), F.lit(0))
    clock = F.regexp_extract(text, r"(\d+:\d+(?::\d+)?)\s*$", 1)
    part = F.split(clock, ":")
    get = lambda k: F.coalesce(F.get(part, F.lit(k)).try_cast("int"), F.lit(0))
    return F.when(clock != "", days * 86_400 + get(0) * 3600 + get(1) * 60 + get(2))


def to_time_string(seconds: Column) -> Column:
    """H:MM:SS within a day, N day(s), H:MM:SS beyond."""
    days = F.floor(seconds / 86_400)
    rest = F.pmod(seconds, F.lit(86_400))
    clock = F.concat_ws(":", F.floor(rest / 3600).cast("string"), *[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(rest / 60) % 60, rest % 60)])
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(days == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")), clock))


def to_feed_time(seconds: Column) -> Column:
    """HH:MM:SS; hours pass 24 after midnight."""
    return F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)])


def modes_union(a: Column, b: Column) -> Column:
    """Distinct characters of both strings, sorted."""
    return F.array_join(F.array_sort(F.array_union(chars(a), chars(b))), "")


def modes_without(a: Column, b: Column) -> Column:
    """The characters of a that b lacks, sorted; an error if none is left."""
    left = F.array_sort(F.array_except(chars(a), chars(b)))
    return F.when(F.size(left) > 0, F.array_join(left, "")).otherwise(F.raise_error(F.lit("a link needs at least one mode")))


def chars(a: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(a, F.lit("")), ""), lambda c: c != ""))


def inverse_binary_logit(p: Column, b0: float = 0.0, b1: float = 1.0) -> Column:
    return F.when(p >= 1, F.lit(float("inf"))).when(p <= 0, F.lit(float("-inf"))).otherwise((F.ln(p / (1 - p)) - b0) / b1)


def deterrence(kind: str, cost: Column, alpha: float | None = None, beta: float | None = None) -> Column:
    """EXPO exp(-beta c), POWER c^-alpha, GAMMA c^alpha exp(-beta c); a value that isn't finite becomes 0."""
    kind = kind.upper()
    if kind == "EXPO":
        value = F.exp(-beta * cost)
    elif kind == "POWER":
        value = F.when(cost > 0, F.pow(cost, F.lit(-alpha)))
    elif kind == "GAMMA":
        value = F.when(cost > 0, F.pow(cost, F.lit(alpha)) * F.exp(-beta * cost))
    else:
        raise ValueError(f"no deterrence function {kind!r}")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


#: Units of planning data and their factors to metres, km/h, minutes and vehicles an hour; no unit means the base one.
UNITS = {
    "length": {"": 1.0, "m": 1.0, "meter": 1.0, "meters": 1.0, "km": 1000.0},
    "speed": {"": 1.0, "km/h": 1.0, "kph": 1.0, "kmh": 1.0, "m/s": 3.6, "mph": 1.609344},
    "time": {"": 1.0, "min": 1.0, "mins": 1.0, "minute": 1.0, "s": 1.0 / 60.0, "sec": 1.0 / 60.0, "h": 60.0},
    "capacity": {"": 1.0, "veh/h": 1.0, "veh/hr": 1.0, "vehph": 1.0, "pcu/h": 1.0, "pc/h": 1.0, "/h": 1.0},
}


def with_unit(text: Column, quantity: str) -> Column:
    """The number of a text such as 1.2km or 90s in the quantity's base unit; null for null or blank, an error for an unknown unit."""
    raw = F.trim(F.regexp_replace(text, ",", "."))
    number = F.regexp_extract(raw, r"^([-+]?\d*\.?\d+)\s*([^\s\d].*)?$", 1)
    unit = F.lower(F.trim(F.regexp_extract(raw, r"^([-+]?\d*\.?\d+)\s*([^\s\d].*)?$", 2)))
    factor = None
    for name, value in UNITS[quantity].items():
        factor = F.when(unit == name, F.lit(value)) if factor is None else factor.when(unit == name, F.lit(value))
    known = (number != "") & factor.isNotNull()
    wrong = F.raise_error(F.concat(F.lit(f"unknown {quantity}: "), text)).cast("double")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("double")).when(known, number.try_cast("double") * factor).otherwise(wrong)


def distance_band(metres: Column, bounds: tuple[int, ...]) -> Column:
    out = None
    for b in bounds:
        out = F.when(metres <= b, F.lit(f"<= {b} m")) if out is None else out.when(metres <= b, F.lit(f"<= {b} m"))
    return out.otherwise(F.lit(f"> {bounds[-1]} m"))
