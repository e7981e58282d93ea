"""Streaming forms, an extension: the same questions on data that arrives.

Time windows with a watermark for late rows, sessions by gap, and the carrier of a frame as an aggregation, since
frame windows need no order between frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import CARRIER_DISTANCE


def arriving(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(df: DataFrame, time: str, size: str, slide: str | None, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """start, keys, n, total by tumbling (no slide) or sliding windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def session_spans(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """start, stop (last row plus gap), keys, n of sessions."""
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "n")


def frame_carriers(df: DataFrame, time: str, frame: list[str], late: str = "10 seconds", limit: float = CARRIER_DISTANCE) -> DataFrame:
    """The nearest player of each frame, if within the limit: one aggregation, closed when the watermark passes."""
    row = F.struct("id", "team_id", "x", "y")
    g = df.withWatermark(time, late).groupBy(F.window(time, "1 second"), *frame).agg(F.max(F.when(F.col("id") == "ball", F.struct("x", "y"))).alias("b"), F.collect_list(F.when(F.col("id") != "ball", row)).alias("ps"))
    d = lambda p: F.sqrt((p["x"] - F.col("b.x")) * (p["x"] - F.col("b.x")) + (p["y"] - F.col("b.y")) * (p["y"] - F.col("b.y")))
    best = F.array_min(F.transform("ps", lambda p: F.struct(d(p).alias("d"), p["id"].alias("id"), p["team_id"].alias("team_id"))))
    return g.select(*frame, best.alias("c")).where(F.col("c.d") < limit).select(*frame, F.col("c.id").alias("carrier_id"), F.col("c.team_id").alias("owning_team"), F.col("c.d").alias("distance"))
