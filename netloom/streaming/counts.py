"""An optional extension: link counts and public-transport preloads kept up to date from a stream of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_counts(passages: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(link, start, end, n, volume) of passages(ts, link, pce), batch or stream; rows later than `late` are dropped by a stream."""
    timed = passages.withWatermark("ts", late) if passages.isStreaming else passages
    grouped = timed.groupBy(F.window("ts", window, slide).alias("w"), "link").agg(F.count("*").alias("n"), F.sum("pce").alias("volume"))
    return grouped.select("link", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")
