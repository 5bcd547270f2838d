"""Origin-destination matrices as sparse long tables: (origin, destination, core columns); an absent row is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("origin", "destination")


def cores_of(od: DataFrame) -> list[str]:
    return [c for c in od.columns if c not in KEYS]


def from_trip_list(trips: DataFrame, origin: str, destination: str, cores: list[str]) -> DataFrame:
    """Rows that repeat a pair are summed; a list without core columns counts trips."""
    key = [F.col(origin).cast("long").alias("origin"), F.col(destination).cast("long").alias("destination")]
    grouped = trips.where(F.col(origin).isNotNull() & F.col(destination).isNotNull()).groupBy(*key)
    return grouped.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cores]) if cores else grouped.agg(F.count("*").cast("double").alias("trips"))


def zone_index(od: DataFrame) -> DataFrame:
    return od.select(F.col("origin").alias("zone")).union(od.select("destination")).distinct()


def merge_demand(matrices: list[DataFrame]) -> DataFrame:
    """Full join on the pair, gaps filled with 0; only float and double cores are kept."""
    out = None
    for od in matrices:
        kept = od.select(*KEYS, *[c for c, t in od.dtypes if c not in KEYS and t in ("float", "double")])
        out = kept if out is None else out.join(kept, list(KEYS), "full")
    return out.fillna(0.0)


def project(od: DataFrame, cores: list[str], names: list[str] | None = None) -> DataFrame:
    return od.select(*KEYS, *[F.col(c).alias(n) for c, n in zip(cores, names or cores, strict=True)])


def relabel(od: DataFrame, labels: DataFrame) -> DataFrame:
    """Zones under another index: labels(zone, label)."""
    o = labels.select(F.col("zone").alias("origin"), F.col("label").alias("__o"))
    d = labels.select(F.col("zone").alias("destination"), F.col("label").alias("__d"))
    return od.join(o, "origin").join(d, "destination").select(F.col("__o").alias("origin"), F.col("__d").alias("destination"), *cores_of(od))


def nan_to_zero(od: DataFrame) -> DataFrame:
    return od.select(*KEYS, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cores_of(od)])


def totals(od: DataFrame, side: str) -> DataFrame:
    """Row (side origin) or column (destination) totals; NaN counts as 0."""
    return nan_to_zero(od).groupBy(F.col(side).alias("zone")).agg(*[F.sum(c).alias(c) for c in cores_of(od)])


def nonzero(od: DataFrame) -> DataFrame:
    """Cells with any core other than 0 (what the CSV sink writes)."""
    clean = nan_to_zero(od)
    return clean.where(F.greatest(*[F.abs(c) for c in cores_of(od)], F.lit(0.0)) > 0)


def summary(od: DataFrame, n_zones: int) -> DataFrame:
    """(core, total, min, max, nonzero) over all n_zones^2 cells, absent ones as 0."""
    clean = nan_to_zero(od)
    cores = cores_of(od)
    one = clean.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}|{k}") for c in cores for k, f in (("total", F.sum), ("min", F.min), ("max", F.max), ("nnz", lambda c: F.count_if(F.col(c) != 0)))])
    full = F.col("n") >= n_zones * n_zones
    rows = [F.struct(F.lit(c).alias("core"), F.coalesce(f"{c}|total", F.lit(0.0)).alias("total"), F.when(full, F.col(f"{c}|min")).otherwise(F.least(F.coalesce(f"{c}|min", F.lit(0.0)), F.lit(0.0))).alias("min"), F.when(full, F.col(f"{c}|max")).otherwise(F.greatest(F.coalesce(f"{c}|max", F.lit(0.0)), F.lit(0.0))).alias("max"), F.coalesce(f"{c}|nnz", F.lit(0)).alias("nonzero")) for c in cores]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def melt(od: DataFrame) -> DataFrame:
    """(origin, destination, core, value) of non-zero cells."""
    return nan_to_zero(od).unpivot(list(KEYS), cores_of(od), "core", "value").where("value <> 0")


def to_nodes(od: DataFrame, mapping: DataFrame) -> DataFrame:
    """Demand between zones to demand between nodes: mapping(zone, node)."""
    return relabel(od, mapping.select("zone", F.col("node").alias("label")))
