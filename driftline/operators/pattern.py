"""Places by category, and trajectories that pass places of several categories (IDX-21, QRY-6 to QRY-14, JN-2 to JN-5).

``visits`` is (tid, cell, first_ts). ``poi`` is (seq, name, type, lon, lat); seq is the order in which places were read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.geometry import EARTH_M, haversine
from ..plans.storage import materialise
from ..plans.strategy import by_selectivity, small
from .index import with_cells


def poi_cells(poi: DataFrame, level: int) -> DataFrame:
    """IDX-21: (type, cell, seq), each cell of a category once, at its first place."""
    return with_cells(poi, level).groupBy("type", "cell").agg(F.min("seq").alias("seq"))


def cells_of_type(cells: DataFrame, kind: str) -> DataFrame:
    """QRY-11."""
    return cells.filter(F.col("type") == kind).select("cell")


def places_of_type(poi: DataFrame, kind: str) -> DataFrame:
    """QRY-12."""
    return poi.filter(F.col("type") == kind)


def place_by_name(poi: DataFrame, kind: str, name: str) -> DataFrame:
    """QRY-13: the first by seq, or none."""
    return poi.filter((F.col("type") == kind) & (F.col("name") == name)).orderBy("seq").limit(1)


def places_by_type(poi: DataFrame) -> DataFrame:
    """QRY-14, AGG-14: how many places and the first of each category; the lists themselves stay relational."""
    return poi.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "seq").alias("first_name"))


def first_matches(visits: DataFrame, cells: DataFrame, types: Sequence[str]) -> DataFrame:
    """(tid, type, cell, first_ts): for each trajectory and category the first cell in list order that it visits.

    One join and one aggregate for all categories; of equal (tid, type) rows partial aggregation leaves one a task."""
    c = small(cells.filter(F.col("type").isin(*types)).select("type", "cell", F.col("seq").alias("place")))
    # A place stands for one cell of its category, so both minima are of one row; two longs aggregate by hash, a struct would by sort.
    return visits.join(c, "cell").groupBy("tid", "type").agg(F.min_by("cell", "place").alias("cell"), F.min_by("first_ts", "place").alias("first_ts"))


def _kinds(cells: DataFrame, types: Sequence[str], skip_empty: bool) -> int:
    if not skip_empty:
        return len(types)
    return cells.filter(F.col("type").isin(*types)).agg(F.countDistinct("type").alias("n")).first()["n"]


def category_filter(visits: DataFrame, cells: DataFrame, types: Sequence[str], skip_empty: bool = False) -> DataFrame:
    """QRY-7: first_matches of the trajectories that match every category; skip_empty: categories without places don't count."""
    m = first_matches(visits, cells, types)
    n = F.count("type").over(Window.partitionBy("tid"))
    return m.withColumn("_n", n).filter(F.col("_n") == _kinds(cells, types, skip_empty)).drop("_n")


def poi_search(visits: DataFrame, cells: DataFrame, types: Sequence[str], times: Sequence[int], require_all: bool = True, skip_empty: bool = False) -> DataFrame:
    """QRY-6: (tid, n_types, span) of trajectories that pass a place of each category with first times less than
    max(times) - min(times) apart; require_all=False: of whatever categories they pass."""
    g = first_matches(visits, cells, types).groupBy("tid").agg(F.count("type").alias("n_types"), (F.max("first_ts") - F.min("first_ts")).alias("span"))
    g = g.filter(F.col("span") < max(times) - min(times))
    return g.filter(F.col("n_types") == _kinds(cells, types, skip_empty)) if require_all else g


def category_count(cell_points: DataFrame, cells: DataFrame, types: Sequence[str], after: int, before: int, legacy: bool = False) -> DataFrame:
    """QRY-10, AGG-7, JN-9: (tid, n) with n categories hit strictly inside the times, at least as many as asked for; legacy: hits."""
    c = small(cells.filter(F.col("type").isin(*types)).select("type", "cell"))
    hit = cell_points.filter((F.col("ts") > after) & (F.col("ts") < before)).join(c, "cell")
    n = F.count(F.lit(1)) if legacy else F.countDistinct("type")
    return hit.groupBy("tid").agg(n.alias("n")).filter(F.col("n") >= len(types))


def expand_paths(cells: DataFrame, types: Sequence[str], level: int, longest: float) -> DataFrame:
    """JN-2, IDX-19: (cells, distance) of one cell of each category, in the order given, with a running distance below ``longest``.

    A theta join; no step is longer than ``longest``, so its ends lie in the same or neighbouring cubes of the straight distance that
    belongs to it, and the join has the cube as an equal key. The caller orders categories from the fewest cells on."""
    side = 2 * math.sin(min(longest / EARTH_M, math.pi) / 2) * (1 + 1e-9) or 1e-12

    middles = materialise(cells.filter(F.col("type").isin(*types)).select("type", "cell", C.center(F.col("cell"), level).alias("at")).distinct(), "middles")

    def where(t: str) -> DataFrame:
        p = middles.filter(F.col("type") == t)
        la, lo = F.radians("at.lat"), F.radians("at.lon")
        xyz = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
        return p.select("cell", "at", F.struct(*[F.floor(v / side).alias(n) for v, n in zip(xyz, "xyz")]).alias("cube"))

    around = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "xyz")]) for o in product((-1, 0, 1), repeat=3)])
    now = where(types[0]).select(F.array("cell").alias("cells"), F.lit(0.0).alias("distance"), F.col("at").alias("last"), "cube")
    for t in types[1:]:
        nxt = where(t).withColumn("o", F.explode(around)).select(
            F.col("cell").alias("c"), F.col("at").alias("to"), F.col("cube").alias("to_cube"), F.struct(*[(F.col(f"cube.{n}") + F.col(f"o.{n}")).alias(n) for n in "xyz"]).alias("cube"),
        )
        d = F.col("distance") + haversine(F.col("last.lat"), F.col("last.lon"), F.col("to.lat"), F.col("to.lon"))
        now = now.join(small(nxt), "cube").withColumn("d", d).filter(F.col("d") < longest).select(
            F.concat("cells", F.array("c")).alias("cells"), F.col("d").alias("distance"), F.col("to").alias("last"), F.col("to_cube").alias("cube"),
        )
    return now.select("cells", "distance")


def covering(visits: DataFrame, paths: DataFrame, span: int | None = None) -> DataFrame:
    """JN-5, QRY-9: (path, tid, interval) of trajectories that visit every cell of a path; ``span``: with first times less apart.

    paths: (path, cells). The join is by cell; a path's cells are distinct before it is counted."""
    p = paths.select("path", F.array_distinct("cells").alias("cells"))
    each = small(p.select("path", F.size("cells").alias("want"), F.explode("cells").alias("cell")))
    g = visits.join(each, "cell").groupBy("path", "tid").agg(F.count(F.lit(1)).alias("n"), F.max("want").alias("want"), (F.max("first_ts") - F.min("first_ts")).alias("interval"))
    g = g.filter(F.col("n") == F.col("want"))
    return (g.filter(F.col("interval") < span) if span is not None else g).select("path", "tid", "interval")


def time_filter(visits: DataFrame, cells: DataFrame, types: Sequence[str], times: Sequence[int], speed: float, level: int) -> DataFrame:
    """QRY-8: trajectories that cover a path of one cell of each category, shorter than speed x span, within the span."""
    span = max(times) - min(times)
    paths = expand_paths(cells, by_selectivity(cells, types), level, speed * span).select(F.array_join("cells", "-").alias("path"), "cells")
    return covering(visits, paths, span).select("tid").distinct()


def chain(measures: DataFrame, pairs: DataFrame, longest: int, key: str | None = None) -> DataFrame:
    """JN-3: measures (m, cells, latest, interval) x pairs (pos, cell, ts): a later pair extends a measure while the interval stays
    below ``longest``; pairs no later than ``latest`` that stand before it (by pos) join its cells without a row of their own.

    ``key``: a column of both sides, such as the trajectory, that measure and pairs share; without it every measure meets every pair,
    so one side must be small."""
    every = measures.join(pairs, key) if key else measures.join(small(pairs), how="cross")
    seen = F.collect_list(F.when(F.col("ts") <= F.col("latest"), F.col("cell"))).over(Window.partitionBy("m").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    more = F.col("interval") + F.col("ts") - F.col("latest")
    return every.withColumn("_seen", seen).filter((F.col("ts") > F.col("latest")) & (more < longest)).select(
        "m", "pos", F.concat("cells", "_seen", F.array("cell")).alias("cells"), F.col("ts").alias("latest"), more.alias("interval"),
    )
