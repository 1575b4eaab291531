"""Selections on the point table (SEL-1 to SEL-13). Bounds are inclusive in ``by_time`` and strict elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_local
from ..plans.strategy import small


def by_id(points: DataFrame, tid: int) -> DataFrame:
    return points.filter(F.col("tid") == tid).select("tid", "lat", "lon", "ts")


def by_ids_time(points: DataFrame, ids: DataFrame | list[int], after: int, before: int) -> DataFrame:
    """SEL-2: ids as a list, or as a table with tid, which is broadcast if it is small."""
    inside = points.filter((F.col("ts") > after) & (F.col("ts") < before))
    if isinstance(ids, DataFrame):
        inside = inside.join(small(ids.select("tid").distinct()), "tid", "left_semi")
    else:
        inside = inside.filter(F.col("tid").isin(*ids))
    return inside.select("tid", "lat", "lon", "ts")


def distinct_ids(points: DataFrame) -> DataFrame:
    return points.select("tid").distinct().orderBy("tid")


def by_time(points: DataFrame, start: str, end: str) -> DataFrame:
    """SEL-4: local 'yyyy-MM-dd HH:mm:ss' bounds, both included."""
    return points.filter(F.col("ts").between(parse_local(F.lit(start)), parse_local(F.lit(end))))


def inside_box(lon: Column, lat: Column, left: float, top: float, right: float, bottom: float) -> Column:
    return (lon > left) & (lon < right) & (lat > bottom) & (lat < top)


def by_space(points: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    return points.filter(inside_box(F.col("lon"), F.col("lat"), left, top, right, bottom))


def by_space_time(points: DataFrame, left: float, top: float, right: float, bottom: float, after: int, before: int) -> DataFrame:
    return by_space(points, left, top, right, bottom).filter((F.col("ts") > after) & (F.col("ts") < before))


def trajectory(points: DataFrame, tid: int) -> DataFrame:
    """SEL-7."""
    return points.filter(F.col("tid") == tid).select("seq", "lon", "lat", "ts").orderBy("ts", "seq")


def flagged(df: DataFrame, flag: str) -> DataFrame:
    """SEL-10."""
    return df.filter(F.col(flag) == 1)


def without_repeated_times(points: DataFrame) -> DataFrame:
    """SEL-11: rows whose ts differs from that of the row before (by arrival) of their trajectory."""
    before = F.lag("ts").over(Window.partitionBy("tid").orderBy("seq"))
    return points.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("ts"))).drop("_b")


def is_odd(x: Column) -> Column:
    return x % 2 != 0


def is_even(x: Column) -> Column:
    return x % 2 == 0


def is_positive(x: Column) -> Column:
    return x > 0


def visiting(visits: DataFrame, cells: DataFrame) -> DataFrame:
    """SEL-13, JN-4: visits of one of the cells."""
    return visits.join(small(cells.select("cell").distinct()), "cell", "left_semi")
