"""Rectangles, intervals, polylines and polygons, as column expressions (GEO-4, GEO-5, GEO-9 to GEO-13).

A rectangle or interval is a dict of columns; a polyline or loop is an array of struct(x, y), x the longitude. Lengths are metres on
the sphere of ``geometry.EARTH_M``; polygons are planar in degrees, with edges as straight lines, even-odd for holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells as C
from .cells import let
from .geometry import EARTH_M, haversine
from ..plans.storage import materialise

Rect = dict[str, Column]


# -- rectangles and intervals -----------------------------------------------------------------------------------------------


def union(a: Rect, b: Rect) -> Rect:
    return {k: (F.least if k.startswith("min") else F.greatest)(a[k], b[k]) for k in a}


def intersection(a: Rect, b: Rect) -> Rect:
    """Empty where a minimum exceeds its maximum, see ``is_empty``."""
    return {k: (F.greatest if k.startswith("min") else F.least)(a[k], b[k]) for k in a}


def is_empty(r: Rect) -> Column:
    return (r["min_x"] > r["max_x"]) | (r["min_y"] > r["max_y"])


def holds_rect(outer: Rect, inner: Rect) -> Column:
    return (outer["min_x"] <= inner["min_x"]) & (outer["max_x"] >= inner["max_x"]) & (outer["min_y"] <= inner["min_y"]) & (outer["max_y"] >= inner["max_y"])


def expanded(r: Rect, by: float) -> Rect:
    return {k: v - by if k.startswith("min") else v + by for k, v in r.items()}


def from_points(x1: Column, y1: Column, x2: Column, y2: Column) -> Rect:
    return {"min_x": F.least(x1, x2), "max_x": F.greatest(x1, x2), "min_y": F.least(y1, y2), "max_y": F.greatest(y1, y2)}


def area_m2(r: Rect) -> Column:
    """Of a latitude and longitude rectangle on the sphere."""
    band = F.sin(F.radians(r["max_y"])) - F.sin(F.radians(r["min_y"]))
    return F.when(is_empty(r), 0.0).otherwise(EARTH_M * EARTH_M * F.radians(r["max_x"] - r["min_x"]) * band)


def interval_gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """The Hausdorff distance of two intervals."""
    return F.greatest(F.abs(lo1 - lo2), F.abs(hi1 - hi2))


# -- polylines ------------------------------------------------------------------------------------------------------------


def _steps(line: Column) -> Column:
    """Length of each edge."""
    return F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: haversine(a["y"], a["x"], b["y"], b["x"]))


def length(line: Column) -> Column:
    return F.when(F.size(line) < 2, 0.0).otherwise(F.aggregate(_steps(line), F.lit(0.0), lambda s, x: s + x))


def interpolate(line: Column, fraction: Column) -> Column:
    """The point at a share of the length, linear between vertices; null for an empty line."""

    def walk(steps: Column) -> Column:
        goal = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))
        start = F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("k"), F.lit(0.0).alias("part"), F.lit(False).alias("hit"))

        def step(st: Column, x: Column) -> Column:
            here = (st["done"] + x >= goal) & (x > 0)
            return F.when(st["hit"], st).otherwise(F.struct(
                (st["done"] + x).alias("done"), F.when(here, st["k"]).otherwise(st["k"] + 1).alias("k"),
                F.when(here, (goal - st["done"]) / F.when(x > 0, x).otherwise(1.0)).otherwise(0.0).alias("part"), here.alias("hit"),
            ))

        return F.aggregate(steps, start, step)

    def at(r: Column) -> Column:
        k = F.least(r["k"], F.size(line) - 2)
        a, b = F.get(line, k), F.get(line, k + 1)
        part = F.when(r["hit"], r["part"]).otherwise(0.0)
        return F.struct((a["x"] + (b["x"] - a["x"]) * part).alias("x"), (a["y"] + (b["y"] - a["y"]) * part).alias("y"))

    return F.when(F.size(line) == 1, F.get(line, F.lit(0))).when(F.size(line) > 1, let(let(_steps(line), walk), at))


def project(line: Column, x: Column, y: Column) -> Column:
    """struct(d, x, y): the place on the line nearest to a point, in degrees."""
    def near(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(n > 0, n).otherwise(1.0), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return let(F.struct((a["x"] + dx * t).alias("x"), (a["y"] + dy * t).alias("y")), lambda p: F.struct(
            F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)).alias("d"), p["x"].alias("x"), p["y"].alias("y"),
        ))

    return F.array_min(F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), near))


def centroid(line: Column) -> Column:
    """struct(x, y): the mean of the vertices."""
    n = F.size(line)
    total = lambda k: F.aggregate(line, F.lit(0.0), lambda s, p: s + p[k])
    return F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"))


def lines(points: DataFrame) -> DataFrame:
    """(tid, line): each trajectory as a polyline in the order (ts, seq)."""
    g = points.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))
    return g.select("tid", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"))


# -- polygons -------------------------------------------------------------------------------------------------------------


def _edges(loop: Column, f) -> Column:
    return F.zip_with(loop, F.concat(F.slice(loop, 2, F.size(loop)), F.slice(loop, 1, 1)), f)


def loop_area(loop: Column) -> Column:
    """Square degrees; positive for counter-clockwise loops."""
    return F.aggregate(_edges(loop, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def loop_holds(loop: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the loop an odd number of times."""
    crosses = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"])
    return F.size(F.filter(_edges(loop, crosses), lambda v: v)) % 2 == 1


def polygon_holds(loops: list[Column], x: Column, y: Column) -> Column:
    """Of several loops, holes among them: inside an odd number."""
    inside = [loop_holds(v, x, y).cast("int") for v in loops]
    return sum(inside[1:], inside[0]) % 2 == 1


def loop(vertices: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in vertices])


# -- coverings --------------------------------------------------------------------------------------------------------------


def _meets(r: Column, left: float, bottom: float, right: float, top: float, level: int) -> Column:
    """Whether the corners' rectangle meets a region. Edges bulge beyond their corners by a share that falls by four a level; a cell over
    the date line reaches from its larger longitude on; longitudes near a pole say nothing."""
    slack = bulge(level)
    band = (r["min_lat"] - slack <= top) & (r["max_lat"] + slack >= bottom)
    wide = r["max_lon"] - r["min_lon"] > (120 if level < 4 else 180)
    over = F.lit(level < 4) | (F.greatest(F.abs(r["min_lat"]), F.abs(r["max_lat"])) > 80) | (r["max_lon"] <= right) | (r["min_lon"] >= left)
    return band & F.when(wide, over).otherwise((r["min_lon"] <= right) & (r["max_lon"] >= left))


def bulge(level: int) -> float:
    return 20.0 * 4.0**-level


def cover(spark: SparkSession, left: float, bottom: float, right: float, top: float, level: int, inside: bool = False) -> DataFrame:
    """GEO-8: (cell) of a level whose rectangle meets a region, by subdivision from the six faces, four levels at once; ``inside``: of
    these, the cells that lie in it (an interior covering)."""
    now = spark.range(6).select(F.shiftleft("id", 61).bitwiseOR(F.lit(1 << 60)).alias("cell"))
    for k in [*range(4, level, 4), level]:
        step = 1 << (60 - 2 * k)
        kids = F.sequence(C.range_min(F.col("cell")) + (step - 1), C.range_max(F.col("cell")) - (step - 1), F.lit(2 * step))
        now = now.select(F.explode(kids).alias("cell")).filter(let(C.rect_of(F.col("cell"), k), lambda r: _meets(r, left, bottom, right, top, k)))  # noqa: B023
    if inside:
        slack = bulge(level)
        now = now.filter(let(C.rect_of(F.col("cell"), level), lambda r: (r["min_lon"] >= left) & (r["max_lon"] <= right) & (r["min_lat"] - slack >= bottom) & (r["max_lat"] + slack <= top)))
    return now


def _ancestors(cell: Column, strict: bool = True) -> Column:
    """The cells of all levels above one, at most 30."""
    own = C.level_of(cell)
    up = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.when(
        (k < own) if strict else (k <= own), let(F.call_function("shiftleft", F.lit(1).cast("long"), 60 - 2 * k), lambda b: cell.bitwiseAND(-b).bitwiseOR(b)),
    ))
    return F.filter(up, lambda c: c.isNotNull())


def normalised(cells: DataFrame) -> DataFrame:
    """GEO-7: a cell union without cells that another one holds, and with four siblings replaced by their parent until there are none;
    each round works one level up, and what it leaves alone is not read again."""
    c = cells.select("cell").distinct()
    inner = c.select(F.col("cell").alias("_own"), F.explode(_ancestors(F.col("cell"))).alias("cell")).join(c, "cell", "left_semi").select(F.col("_own").alias("cell")).distinct()
    now = materialise(c.join(inner, "cell", "left_anti"), "union")
    todo = {r["l"] for r in now.select(C.level_of(F.col("cell")).alias("l")).distinct().collect()}  # 31 at most
    for level in range(30, 0, -1):
        if level not in todo:
            continue
        bit = 1 << (60 - 2 * (level - 1))
        own = now.filter(C.level_of(F.col("cell")) == level).withColumn("up", F.col("cell").bitwiseAND(F.lit(-bit)).bitwiseOR(F.lit(bit)))
        full = own.groupBy("up").count().filter("count = 4").select("up")
        if not full.isEmpty():
            now = materialise(now.join(own.join(full, "up", "left_semi").select("cell"), "cell", "left_anti").union(full), "union")
            todo.add(level - 1)
    return now


def union_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """GEO-7: the cells of either union that the other one holds, itself or by a larger cell."""
    held = lambda x, y: x.select("cell").distinct().select(F.col("cell").alias("_own"), F.explode(_ancestors(F.col("cell"), strict=False)).alias("cell")).join(y.select("cell").distinct(), "cell", "left_semi").select(F.col("_own").alias("cell"))
    return held(a, b).union(held(b, a)).distinct()


def union_difference(a: DataFrame, b: DataFrame, level: int) -> DataFrame:
    """GEO-7: cells of ``level`` in the union a and not in b; both hold cells of that level or above."""
    bit = 1 << (60 - 2 * level)
    leaves_ = lambda x: x.select(F.explode(F.sequence(C.range_min(F.col("cell")) + (bit - 1), C.range_max(F.col("cell")) - (bit - 1), F.lit(2 * bit))).alias("cell")).distinct()
    return leaves_(a).join(leaves_(b), "cell", "left_anti")
