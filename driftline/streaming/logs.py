"""Logs as streams: files that keep arriving in a folder, cells and visits in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as C
from ..functions import text


def read_log7_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The seven-column log of ``sources.readers.read_log7``, from files as they come."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("tid", "lon", "lat", "time", "state", "speed", "dir")])
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return d.select(
        text.parse_int(F.col("tid")).alias("tid"), text.parse_double(F.col("lon")).alias("lon"), text.parse_double(F.col("lat")).alias("lat"),
        text.parse_local(F.col("time")).alias("ts"), text.parse_int(F.col("state")).alias("state"),
    )


def visit_counts(points: DataFrame, level: int, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, cell, n, n_tids) in tumbling windows of event time; rows later than ``late`` are dropped. State is bounded by the
    watermark; distinct trajectories are approximate, as a stream cannot keep them all."""
    p = points.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    p = p.withColumn("cell", C.encode(F.col("lat"), F.col("lon"), level))
    g = p.groupBy(F.window("at", every), "cell").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("tid").alias("n_tids"))
    return g.select(F.col("window.start").alias("start"), "cell", "n", "n_tids")
