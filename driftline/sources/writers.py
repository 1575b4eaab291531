"""Writers (SNK-1, SNK-2, STR-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_repeated_cells(cells: DataFrame) -> DataFrame:
    """SNK-1: of consecutive rows of a trajectory (by ts, seq) in one cell the first stays."""
    before = F.lag("cell").over(Window.partitionBy("tid").orderBy("ts", "seq"))
    return cells.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("cell"))).drop("_before")


def save_cells(cells: DataFrame, path: str) -> None:
    drop_repeated_cells(cells).select("cell", "tid", "ts").write.csv(path)


def trajectory_json(points: DataFrame, legacy: bool = False) -> DataFrame:
    """STR-3: (tid, json) with the points in time order and [0, 0] at the end; legacy: without the closing brace."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    g = points.groupBy("tid").agg(pairs.alias("p"))
    out = F.to_json(F.struct(F.col("tid").alias("trip"), F.concat("p", F.array(F.array(F.lit(0.0), F.lit(0.0)))).alias("points")))
    return g.select("tid", (F.substring(out, F.lit(1), F.length(out) - 1) if legacy else out).alias("json"))


def save_json(points: DataFrame, path: str) -> None:
    """SNK-2."""
    trajectory_json(points).select("json").write.text(path)
