"""Sinks of results: route sets and paths by origin, skims, graphs by period, reports; and SQLite tables as a source."""

from __future__ import annotations

import json
import math
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_routes(routes: DataFrame, path: str) -> None:
    """Route sets by origin; only the origins that are written are replaced."""
    routes.repartition("origin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("origin").parquet(path)


def read_routes(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(where) if where else rows


def save_paths(paths: DataFrame, path: str, iteration: int, user_class: str) -> None:
    out = paths.withColumn("iteration", F.lit(iteration)).withColumn("class", F.lit(user_class))
    out.repartition("origin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration", "class", "origin").parquet(path)


def path_of(spark: SparkSession, path: str, iteration: int, user_class: str, origin: int, destination: int) -> list[tuple[int, int]]:
    """(link, direction) along one saved path."""
    rows = spark.read.parquet(path).where((F.col("iteration") == iteration) & (F.col("class") == user_class) & (F.col("origin") == origin) & (F.col("destination") == destination))
    found = rows.select("path").first()
    return [(s.link_id, s.direction) for s in found.path] if found and found.path else []


def save_period(table: DataFrame, path: str, period: int) -> None:
    """A transit graph's vertices or edges under their period; other periods stay."""
    table.withColumn("period_id", F.lit(period)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_id").parquet(path)


def read_period(spark: SparkSession, path: str, period: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("period_id") == period).drop("period_id")


def skim_names(skims: DataFrame, suffix: str) -> DataFrame:
    """Skim columns under _final or _blended."""
    return skims.select(*[F.col(c).alias(c if c in ("origin", "destination") else f"{c}_{suffix}") for c in skims.columns])


def dump_report(report: dict) -> str:
    """A procedure's report as JSON; numbers that aren't finite as text."""

    def plain(v):
        if isinstance(v, float) and not math.isfinite(v):
            return str(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(report))


def load_report(text: str) -> dict:
    def back(v):
        if v in ("inf", "-inf", "nan"):
            return float(v)
        if isinstance(v, dict):
            return {k: back(x) for k, x in v.items()}
        return [back(x) for x in v] if isinstance(v, list) else v

    return back(json.loads(text))


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str | None = None) -> DataFrame:
    """Rows of a query on a SQLite file that the driver can open; for tables that fit its memory."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        pdf = pd.read_sql_query(sql, con)
    return spark.createDataFrame(pdf, schema) if schema or len(pdf) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in pdf.columns))


def ranges(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, steps: int = 5) -> list[float]:
    """Class bounds of a map's legend between two percentiles."""
    a, b = df.agg(F.percentile_approx(column, F.array(F.lit(low), F.lit(high)), F.lit(10_000))).first()[0]
    return [a + (b - a) * k / steps for k in range(steps + 1)]


def dashboard(title: str, tables: dict[str, str]) -> str:
    """A dashboard's description: a panel for each table."""
    return json.dumps({"header": {"title": title}, "layout": {name: [{"type": "table", "title": name, "props": {"dataset": path}}] for name, path in tables.items()}}, indent=1)
