"""Discretisation, resampling, windows and events along trajectories (TRJ, WIN). The order along one is (ts, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.geometry import segment_meets_rect


def along() -> Window:
    return Window.partitionBy("tid").orderBy("ts", "seq")


def bounding_boxes(points: DataFrame, legacy: bool = False) -> DataFrame:
    """TRJ-8, AGG-3; legacy: latitudes of the rows with the extreme longitudes."""
    lats = (F.min_by("lat", "lon"), F.max_by("lat", "lon")) if legacy else (F.min("lat"), F.max("lat"))
    return points.groupBy("tid").agg(F.min("lon").alias("min_x"), lats[0].alias("min_y"), F.max("lon").alias("max_x"), lats[1].alias("max_y"))


def end_points(points: DataFrame) -> DataFrame:
    """TRJ-6: the row behind a change of state; kind 'pickup' for 0 to 1, 'dropoff' for 1 to 0."""
    before = F.lag("state").over(along())
    kind = F.when((F.col("_b") == 0) & (F.col("state") == 1), "pickup").when((F.col("_b") == 1) & (F.col("state") == 0), "dropoff")
    return points.withColumn("_b", before).withColumn("kind", kind).filter(F.col("kind").isNotNull()).drop("_b")


def boundary_flags(points: DataFrame) -> DataFrame:
    """TRJ-7: 1 on the last row of each trajectory."""
    return points.withColumn("is_last", F.when(F.lead("seq").over(along()).isNull(), 1).otherwise(0))


def resample(points: DataFrame, step: int = 300, longest: int = 1500, legacy: bool = False) -> DataFrame:
    """TRJ-4/5: (tid, ts, lon, lat). Gaps between ``step`` and ``longest`` (exclusive) get a point every ``step`` seconds from their
    first point on; all other points pass. legacy: other points are dropped but for a trajectory's last, and lon runs from the
    smaller to the larger end, lat from the larger to the smaller."""
    w = along()
    d = points.select("tid", "ts", "lon", "lat", "seq", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("ts", "lon", "lat")])
    gap = F.col("n_ts") - F.col("ts")
    inside = (gap > step) & (gap < longest)
    steps = F.when(inside, F.floor(gap / step)).otherwise(0)
    if legacy:
        d = d.filter(inside | F.col("n_ts").isNull())
        a_lon, b_lon = F.least("lon", "n_lon"), F.greatest("lon", "n_lon")
        a_lat, b_lat = F.greatest("lat", "n_lat"), F.least("lat", "n_lat")
    else:
        a_lon, b_lon, a_lat, b_lat = F.col("lon"), F.col("n_lon"), F.col("lat"), F.col("n_lat")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    part = F.col("k") * step / gap
    return d.select(
        "tid", (F.col("ts") + F.col("k") * step).alias("ts"),
        F.when(F.col("n_ts").isNull() | (F.col("k") == 0) & ~inside, F.col("lon")).otherwise(a_lon + (b_lon - a_lon) * part).alias("lon"),
        F.when(F.col("n_ts").isNull() | (F.col("k") == 0) & ~inside, F.col("lat")).otherwise(a_lat + (b_lat - a_lat) * part).alias("lat"),
    )


def sliding_windows(points: DataFrame, size: int = 8) -> DataFrame:
    """WIN-1/2: each full window of ``size`` consecutive points, stride 1, as arrays."""
    w = along().rowsBetween(0, size - 1)
    out = points.select("tid", "seq", F.collect_list(F.struct("lon", "lat", "ts")).over(w).alias("w")).filter(F.size("w") == size)
    return out.select("tid", "seq", F.col("w.lon").alias("lons"), F.col("w.lat").alias("lats"), F.col("w.ts").alias("times"))


def running_counts(points: DataFrame) -> DataFrame:
    """WIN-4: exclusive and inclusive prefix sums of state along each trajectory."""
    w = along()
    return points.select(
        "seq", "tid", F.coalesce(F.sum("state").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("state").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )


def segment_cells(points: DataFrame, level: int, most: int = 10, walk: int = 4096) -> DataFrame:
    """TRJ-1/2: (tid, seq, k, cell, ts) of the cells along each trajectory; k = 0 is a point's own cell.

    Between two points in cells more than one apart, the cells of the curve from the smaller to the larger end (exclusive) whose
    rectangle the segment meets follow, with times by the share of the way. Where there are over ``walk`` cells to look at, where
    the segment meets ``most`` cells or more, or where its ends are on different faces, only the own cell stands.
    """
    w = along()
    d = points.select("tid", "seq", "ts", "lon", "lat", C.encode(F.col("lat"), F.col("lon"), level).alias("cell"))
    d = d.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("ts", "lon", "lat", "cell")])
    own = d.select("tid", "seq", F.lit(0).cast("long").alias("k"), "cell", "ts")
    low, high = F.least("cell", "n_cell"), F.greatest("cell", "n_cell")
    far = d.filter(F.col("n_cell").isNotNull() & (F.col("cell") != F.col("n_cell")))
    # Candidates come from the rows and columns between both ends (one more on each side), not from the whole curve.
    ends = F.array(F.struct(C.ij(F.col("cell"), level).alias("a"), C.ij(F.col("n_cell"), level).alias("b")))
    span = lambda e, k: F.sequence(F.greatest(F.least(e["a"][k], e["b"][k]) - 1, F.lit(0)), F.least(F.greatest(e["a"][k], e["b"][k]) + 1, F.lit((1 << level) - 1)))
    ranges = F.transform(ends, lambda e: F.struct(
        e["a"]["face"].alias("face"), span(e, "i").alias("i"), span(e, "j").alias("j"),
        ((e["a"]["face"] == e["b"]["face"]) & ((F.abs(e["a"]["i"] - e["b"]["i"]) > 1) | (F.abs(e["a"]["j"] - e["b"]["j"]) > 1))).alias("ok"),
    ))
    far = far.withColumn("e", F.explode(ranges)).filter(F.col("e.ok") & (F.size("e.i").cast("long") * F.size("e.j") <= walk))
    far = far.withColumn("i", F.explode("e.i")).withColumn("j", F.explode("e.j"))
    met = far.withColumn("c", F.explode(F.array(C.from_face_ij(F.col("e.face"), F.col("i"), F.col("j"), level)))).drop("e")
    met = met.filter((F.col("c") >= low) & (F.col("c") < high) & (F.col("c") != F.col("cell")))
    # One expression, so that the rectangle is computed once where the filter is pushed to.
    met = met.filter(C.let(C.rect_of(F.col("c"), level), lambda r: segment_meets_rect(
        F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"), r["min_lon"], r["min_lat"], r["max_lon"], r["max_lat"],
    )))
    met = met.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seq"))).filter(F.col("n") < most)
    dx, dy = F.col("n_lon") - F.col("lon"), F.col("n_lat") - F.col("lat")
    met = met.withColumn("m", C.center(F.col("c"), level))
    share = F.least(F.greatest(((F.col("m.lon") - F.col("lon")) * dx + (F.col("m.lat") - F.col("lat")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    met = met.withColumn("t", F.col("ts") + F.floor(share * (F.col("n_ts") - F.col("ts"))).cast("long"))
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("seq").orderBy("t", "c")).cast("long"))
    return own.unionByName(met.select("tid", "seq", "k", F.col("c").alias("cell"), F.col("t").alias("ts")))
