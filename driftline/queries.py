"""The engine's own queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import bitmaps as B
from .functions import cells as C
from .functions import geometry as G
from .functions import shapes
from .functions import text as X
from .model import CATALOG_SQL, POI_SQL, POINTS_SQL, djb2_sql
from .operators import grid, index, pattern, selections, trajectories
from .plans.storage import new_path
from .plans.strategy import by_selectivity
from .sources import catalog as cat
from .sources import readers, writers

QUERIES: dict = {}
ORACLES: dict = {}

P = f"points AS ({POINTS_SQL})"
BOX = (116.2, 40.1, 116.6, 39.7)  # left, top, right, bottom
T0, T1 = 1704500000, 1706000000
TYPES = ("BUILDING", "MACHINERY", "FURNITURE")
LEVEL = 11


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["poi_search"](spark, sf_dir)


def r6(c) -> "F.Column":
    return F.round(c, 6)


# -- selections ---------------------------------------------------------------------------------------------------------


@query("sel_by_id", f"WITH {P} SELECT tid, lat, lon, ts FROM points WHERE tid = 7")
def sel_by_id(spark, d):
    return selections.by_id(model.points(spark, d), 7)


@query("sel_by_ids_time", f"WITH {P} SELECT tid, lat, lon, ts FROM points WHERE tid IN (3, 5, 8, 13) AND ts > {T0} AND ts < {T1}")
def sel_by_ids_time(spark, d):
    return selections.by_ids_time(model.points(spark, d), [3, 5, 8, 13], T0, T1)


@query("sel_by_ids_table", f"WITH {P} SELECT tid, lat, lon, ts FROM points WHERE tid IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND ts > {T0} AND ts < {T1}")
def sel_by_ids_table(spark, d):
    ids = model.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("int").alias("tid"))
    return selections.by_ids_time(model.points(spark, d), ids, T0, T1)


@query("distinct_ids", f"WITH {P} SELECT DISTINCT tid FROM points")
def distinct_ids(spark, d):
    return selections.distinct_ids(model.points(spark, d))


@query("sel_by_time", f"WITH {P} SELECT seq, tid, lat, ts FROM points WHERE ts BETWEEN 1704931200 - 28800 AND 1705017599 - 28800")
def sel_by_time(spark, d):
    return selections.by_time(model.points(spark, d), "2024-01-11 00:00:00", "2024-01-11 23:59:59").select("seq", "tid", "lat", "ts")


_IN_BOX = f"lon > {BOX[0]} AND lon < {BOX[2]} AND lat > {BOX[3]} AND lat < {BOX[1]}"


@query("sel_by_space", f"WITH {P} SELECT seq, tid FROM points WHERE {_IN_BOX}")
def sel_by_space(spark, d):
    return selections.by_space(model.points(spark, d), *BOX).select("seq", "tid")


@query("sel_by_space_time", f"WITH {P} SELECT seq, tid FROM points WHERE {_IN_BOX} AND ts > {T0} AND ts < {T1}")
def sel_by_space_time(spark, d):
    return selections.by_space_time(model.points(spark, d), *BOX, T0, T1).select("seq", "tid")


@query("one_trajectory", f"WITH {P} SELECT seq, lon, lat, ts FROM points WHERE tid = 4")
def one_trajectory(spark, d):
    return selections.trajectory(model.points(spark, d), 4)


@query("dedup_ts", f"WITH {P}, h AS (SELECT seq, tid, ts // 43200 AS ts FROM points) SELECT seq, tid, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY tid ORDER BY seq) AS b FROM h) WHERE b IS NULL OR b <> ts")
def dedup_ts(spark, d):
    """Times of half a day, so that many repeat."""
    return selections.without_repeated_times(model.points(spark, d).withColumn("ts", F.floor(F.col("ts") / 43200))).select("seq", "tid", "ts")


@query("predicates", f"WITH {P} SELECT seq, speed % 2 <> 0 AS odd, speed % 2 = 0 AS even, speed > 0 AS positive, CASE WHEN event_type < 'signup' THEN -1 WHEN event_type > 'signup' THEN 1 ELSE 0 END AS cmp FROM points JOIN (SELECT event_id, event_type FROM events) ON seq = event_id")
def predicates(spark, d):
    p = model.points(spark, d).select("seq", "speed").join(model.table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    s = F.col("speed")
    return p.select("seq", selections.is_odd(s).alias("odd"), selections.is_even(s).alias("even"), selections.is_positive(s).alias("positive"), X.compare(F.col("event_type"), F.lit("signup")).alias("cmp"))


@query("first_ids", f"WITH {P} SELECT tid FROM (SELECT DISTINCT tid FROM points ORDER BY tid LIMIT 10)")
def first_ids(spark, d):
    """LIM-1: the first n of an order."""
    return selections.distinct_ids(model.points(spark, d)).limit(10)


# -- catalogue and parsing ------------------------------------------------------------------------------------------------


@query("djb2_key", f"WITH c AS ({CATALOG_SQL}) SELECT seq, CAST(file_id AS VARCHAR) AS file_id, CAST(file_id % 120000 AS BIGINT) AS slot, path FROM c")
def djb2_key(spark, d):
    return model.catalog(spark, d).select("seq", F.col("file_id").cast("string").alias("file_id"), cat.slot(F.col("file_id"), 120000).cast("long").alias("slot"), "path")


_WANT = f"SELECT DISTINCT {djb2_sql('k')} AS file_id, k FROM (SELECT strftime(o_orderdate, '%Y%m%d') || o_custkey AS k FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT '19000101X')"


def _wanted(spark, d):
    k = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_custkey").cast("string"))
    o = model.table(spark, d, "orders").filter("o_orderkey % 100 = 0").select(k.alias("k"))
    return o.union(spark.range(1).select(F.lit("19000101X").alias("k"))).distinct().withColumn("file_id", cat.djb2(F.col("k")))


@query("catalog_lookup", f"WITH c AS ({CATALOG_SQL}), w AS ({_WANT}) SELECT k, arg_min(path, seq) AS path FROM w JOIN c USING (file_id) GROUP BY k")
def catalog_lookup(spark, d):
    return cat.lookup(model.catalog(spark, d), _wanted(spark, d)).select("k", "path")


@query("catalog_unmatched", f"WITH c AS ({CATALOG_SQL}), w AS ({_WANT}) SELECT k FROM w WHERE file_id NOT IN (SELECT file_id FROM c)")
def catalog_unmatched(spark, d):
    return cat.unmatched(model.catalog(spark, d), _wanted(spark, d)).select("k")


@query("catalog_delete", f"WITH c AS ({CATALOG_SQL}), w AS ({_WANT}) SELECT seq, path FROM c WHERE file_id NOT IN (SELECT file_id FROM w)")
def catalog_delete(spark, d):
    return cat.delete(model.catalog(spark, d), _wanted(spark, d).select("file_id")).select("seq", "path")


@query("parse_numeric", """
SELECT c_custkey, round(CAST(regexp_extract('  ' || printf('%.2f', c_acctbal) || 'e', '^\\s*([+-]?\\d+\\.?\\d*)', 1) AS DOUBLE), 2) AS d,
  CAST(c_custkey AS INTEGER) AS i, 0 AS none, CAST(c_custkey AS BIGINT) * 100000 AS u, (('0x' || printf('%x', c_custkey)))::BIGINT AS h, -1::BIGINT AS dflt FROM customer""")
def parse_numeric(spark, d):
    k = F.col("c_custkey").cast("string")
    return model.table(spark, d, "customer").select(
        "c_custkey", F.round(X.parse_double(F.concat(F.lit("  "), F.format_string("%.2f", F.col("c_acctbal")), F.lit("e"))), 2).alias("d"),
        X.parse_int(F.concat(F.lit(" \t"), k, F.lit("ab"))).alias("i"), X.parse_int(F.lit("ab")).alias("none"),
        X.parse_unsigned(F.concat(k, F.lit("00000"))).cast("long").alias("u"), X.parse_hex(F.concat(F.lit("0x"), F.hex("c_custkey"))).alias("h"), X.parse_long(F.lit("?"), -1).alias("dflt"),
    )


@query("parse_date", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 28800 AS iso, CAST(epoch(o_orderdate) AS BIGINT) - 28800 AS dmy FROM orders")
def parse_date(spark, d):
    o = F.col("o_orderdate")
    return model.table(spark, d, "orders").select(
        "o_orderkey", X.parse_local(F.concat(F.date_format(o, "yyyy-MM-dd HH:mm:ss"), F.lit(".123"))).alias("iso"), X.parse_local_dmy(F.date_format(o, "dd/MM/yyyy HH:mm:ss")).alias("dmy"),
    )


@query("format_numbers", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s, CAST(CASE WHEN c_acctbal - floor(c_acctbal) > 0.5 THEN floor(c_acctbal) + 1 ELSE floor(c_acctbal) END AS BIGINT) AS rounded,
  (c_custkey * 4294967296 + 17) >> 32 AS high, (c_custkey * 4294967296 + 17) & 4294967295 AS low, string_split(c_name, '#') AS parts FROM customer""")
def format_numbers(spark, d):
    k = F.col("c_custkey")
    return model.table(spark, d, "customer").select(
        "c_custkey", X.format_int(k).alias("s"), X.round_half_down(F.col("c_acctbal")).alias("rounded"), X.high_bits(k * 4294967296 + 17).alias("high"),
        X.low_bits(k * 4294967296 + 17).alias("low"), X.split_fields(F.col("c_name"), "#").alias("parts"),
    )


@query("pipe_lines", "SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS price FROM lineitem")
def pipe_lines(spark, d):
    """SRC-17/18: fields of pipe-separated lines by name."""
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.format_string("%.2f", F.col("l_extendedprice")))
    f = readers.split_lines(model.table(spark, d, "lineitem").select(line.alias("value")), ["k", "n", "price"], "|")
    return f.select(F.col("k").cast("long").alias("l_orderkey"), F.col("n").cast("int").alias("l_linenumber"), "price")


# -- geometry ------------------------------------------------------------------------------------------------------------

_HAV = "2 * 6378137.0 * atan2(sqrt(h), sqrt(1 - h))"


@query("haversine_pairs", f"""
WITH p AS ({POI_SQL}), q AS (SELECT a.seq AS a, b.seq AS b, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h,
  sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS e FROM p a JOIN p b ON b.seq = a.seq + 1)
SELECT a, b, round({_HAV}, 3) AS metres, round(e, 6) AS degrees FROM q""")
def haversine_pairs(spark, d):
    p = model.poi(spark, d)
    a = p.select((F.col("seq") + 1).alias("b"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    j = p.join(a, F.col("seq") == F.col("b"))
    return j.select(
        (F.col("b") - 1).alias("a"), "b", F.round(G.haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")), 3).alias("metres"),
        r6(G.euclidean(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"))).alias("degrees"),
    )


_CROSS = "sign((x2 - x1) * ({1} - y1) - (y2 - y1) * ({0} - x1))"
_SIDES = ", ".join(_CROSS.format(x, y) for x, y in ((116.4, 39.9), (116.4, 40.0), (116.5, 39.9), (116.5, 40.0)))


@query("segment_meets_box", f"""
WITH {P}, s AS (SELECT seq, lon AS x1, lat AS y1, lead(lon) OVER (PARTITION BY tid ORDER BY ts, seq) AS x2, lead(lat) OVER (PARTITION BY tid ORDER BY ts, seq) AS y2 FROM points)
SELECT seq FROM s WHERE x2 IS NOT NULL AND greatest(x1, x2) >= 116.4 AND least(x1, x2) <= 116.5 AND greatest(y1, y2) >= 39.9 AND least(y1, y2) <= 40.0
  AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0""")
def segment_meets_box(spark, d):
    w = trajectories.along()
    s = model.points(spark, d).select("seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(w).alias("x2"), F.lead("lat").over(w).alias("y2"))
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    return s.filter(F.col("x2").isNotNull() & G.segment_meets_rect(*c, F.lit(116.4), F.lit(39.9), F.lit(116.5), F.lit(40.0))).select("seq")


_DAY = "tid::BIGINT * 100000 + ts // 86400"
_BB = f"b AS (SELECT {_DAY} AS tid, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM points GROUP BY {_DAY})"


def _days(spark, d):
    """All points; a trajectory is what a moving object does in one day, as in a log file."""
    return model.points(spark, d).withColumn("tid", F.col("tid").cast("long") * 100000 + F.floor(F.col("ts") / 86400))


def _boxes(spark, d):
    return trajectories.bounding_boxes(_days(spark, d))


@query("rectangles", f"""
WITH {P}, {_BB} SELECT a.tid AS a, b.tid AS b, (a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y) AS overlap,
  (116.5 > a.min_x AND 116.5 < a.max_x AND 40.0 > a.min_y AND 40.0 < a.max_y) AS inside, (116.5 >= a.min_x AND 116.5 < a.max_x AND 40.0 >= a.min_y AND 40.0 < a.max_y) AS half_open,
  round((a.min_x + a.max_x) / 2, 6) AS cx FROM b a JOIN b b ON b.tid = a.tid + 1""")
def rectangles(spark, d):
    b = _boxes(spark, d)
    c = b.select((F.col("tid") - 1).alias("a"), *[F.col(n).alias(f"o_{n}") for n in ("min_x", "min_y", "max_x", "max_y")])
    j = b.join(c, F.col("tid") == F.col("a"))
    me, other = ({n: F.col(p + n) for n in ("min_x", "min_y", "max_x", "max_y")} for p in ("", "o_"))
    x, y = F.lit(116.5), F.lit(40.0)
    return j.select("a", (F.col("a") + 1).alias("b"), G.rects_overlap(me, other).alias("overlap"), G.rect_holds_point(me, x, y).alias("inside"), G.box_holds_point(me, x, y).alias("half_open"), r6((F.col("min_x") + F.col("max_x")) / 2).alias("cx"))


@query("cap_filter", f"""WITH {P} SELECT seq FROM points WHERE cos(radians(lat)) * cos(radians(lon)) * (cos(radians(40.0::DOUBLE)) * cos(radians(116.5::DOUBLE)))
 + cos(radians(lat)) * sin(radians(lon)) * (cos(radians(40.0::DOUBLE)) * sin(radians(116.5::DOUBLE))) + sin(radians(lat)) * sin(radians(40.0::DOUBLE)) >= cos(radians(0.2::DOUBLE))""")
def cap_filter(spark, d):
    return model.points(spark, d).filter(G.cap_holds(F.col("lat"), F.col("lon"), 40.0, 116.5, 0.2)).select("seq")


@query("small_maths", """
SELECT c_custkey, round(exp(-(x * x) / 2) / sqrt(2 * pi()), 9) AS pdf, gcd(c_custkey, 360) AS g, least(greatest(c_custkey, 10), 90) AS clamped,
  round(1 / (1 + exp(-x)), 9) AS sig, CAST(ceil(c_custkey / 7.0) AS BIGINT) AS ceil_div FROM (SELECT c_custkey, c_acctbal / 5000 AS x FROM customer)""")
def small_maths(spark, d):
    x, k = F.col("c_acctbal") / 5000, F.col("c_custkey")
    return model.table(spark, d, "customer").select("c_custkey", F.round(G.normal_pdf(x), 9).alias("pdf"), G.gcd(k, F.lit(360)).alias("g"), G.clamp(k, F.lit(10), F.lit(90)).alias("clamped"), F.round(G.sigmoid(x), 9).alias("sig"), F.ceil(k / 7.0).alias("ceil_div"))


@query("vectors", """
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE)), 4) AS n2,
  round(embedding[2]::DOUBLE * embedding[6]::DOUBLE - embedding[3]::DOUBLE * embedding[5]::DOUBLE, 6) AS cx, round(embedding[1]::DOUBLE + embedding[4]::DOUBLE, 6) AS s FROM embeddings""")
def vectors(spark, d):
    e = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    v = model.table(spark, d, "embeddings").select("vec_id", e.alias("e"), F.slice(e, 1, 3).alias("a"), F.slice(e, 4, 3).alias("b"))
    return v.select("vec_id", F.round(G.dot(F.col("e"), F.col("e")), 4).alias("n2"), r6(G.cross(F.col("a"), F.col("b"))[0]).alias("cx"), r6(G.add(F.col("a"), F.col("b"))[0]).alias("s"))


# -- cells ---------------------------------------------------------------------------------------------------------------

_CP = f"cp AS ({C.encode_sql('SELECT seq, tid, ts, lon, lat FROM points', LEVEL)})"


def _cell_points(spark, d, level=LEVEL):
    return index.cell_points(model.points(spark, d), level)


@query("cell_encode", f"WITH {P}, {_CP} SELECT seq, cell FROM cp")
def cell_encode(spark, d):
    return _cell_points(spark, d).select("seq", "cell")


def _parent_sql(cell: str, level: int) -> str:
    bit = 1 << (60 - 2 * level)
    return f"(({cell} & (-{bit})) | {bit})"


_LSB = 1 << (60 - 2 * LEVEL)


@query("cell_parent", f"""WITH {P}, {_CP} SELECT DISTINCT cell, {_parent_sql('cell', 9)} AS parent, {LEVEL} AS level, 1::BIGINT AS face, cell + {2 * _LSB} AS next,
  cell - {_LSB - 1} AS range_min, cell + {_LSB - 1} AS range_max, cell - {_LSB} + {1 << (60 - 26)} AS first_child, cell + {_LSB} + {1 << (60 - 26)} AS end_child, true AS held FROM cp""")
def cell_parent(spark, d):
    c = F.col("cell")
    return _cell_points(spark, d).select("cell").distinct().select(
        "cell", C.parent(c, 9).alias("parent"), C.level_of(c).alias("level"), C.face_of(c).alias("face"), C.next_cell(c).alias("next"), C.range_min(c).alias("range_min"),
        C.range_max(c).alias("range_max"), C.child_begin(c, 13).alias("first_child"), C.child_end(c, 13).alias("end_child"), C.contains(C.parent(c, 9), c).alias("held"),
    )


@query("cell_center", f"WITH {P}, {_CP} SELECT cell, round(c_lat, 9) AS lat, round(c_lon, 9) AS lon FROM ({C.center_sql('SELECT DISTINCT cell FROM cp', LEVEL)})")
def cell_center(spark, d):
    m = _cell_points(spark, d).select("cell").distinct().withColumn("m", C.center(F.col("cell"), LEVEL))
    return m.select("cell", F.round("m.lat", 9).alias("lat"), F.round("m.lon", 9).alias("lon"))


@query("cell_union", f"WITH {P}, {_CP}, u AS (SELECT DISTINCT {_parent_sql('cell', 7)} AS c FROM cp WHERE seq % 100 = 0) SELECT seq FROM cp JOIN u ON cell BETWEEN c - {(1 << 46) - 1} AND c + {(1 << 46) - 1}")
def cell_union(spark, d):
    """GEO-7: points in a union of coarser cells, by their parent (an equi-join) instead of ranges."""
    cp = _cell_points(spark, d)
    u = cp.filter("seq % 100 = 0").select(C.parent(F.col("cell"), 7).alias("up")).distinct()
    return cp.withColumn("up", C.parent(F.col("cell"), 7)).join(u, "up", "left_semi").select("seq")


# -- trajectories --------------------------------------------------------------------------------------------------------


@query("traj_bbox", f"WITH {P} SELECT tid, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM points GROUP BY tid")
def traj_bbox(spark, d):
    return trajectories.bounding_boxes(model.points(spark, d))


@query("end_points", f"""WITH {P}, s AS (SELECT *, lag(state) OVER (PARTITION BY tid ORDER BY ts, seq) AS b FROM points)
SELECT seq, tid, lon, lat, CASE WHEN b = 0 THEN 'pickup' ELSE 'dropoff' END AS kind FROM s WHERE b <> state""")
def end_points(spark, d):
    return trajectories.end_points(model.points(spark, d)).select("seq", "tid", "lon", "lat", "kind")


@query("boundary_flags", f"WITH {P} SELECT seq, CASE WHEN lead(seq) OVER (PARTITION BY tid ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS is_last FROM points")
def boundary_flags(spark, d):
    return trajectories.boundary_flags(model.points(spark, d)).select("seq", "is_last")


def _resample_sql(legacy: bool) -> str:
    base = f"""WITH {P}, s AS (SELECT *, lead(ts) OVER w AS n_ts, lead(lon) OVER w AS n_lon, lead(lat) OVER w AS n_lat FROM points WINDOW w AS (PARTITION BY tid ORDER BY ts, seq)),
f AS (SELECT *, (n_ts - ts > 3600 AND n_ts - ts < 18000) AS inside FROM s),
k AS (SELECT *, unnest(range(0, CASE WHEN inside THEN (n_ts - ts) // 3600 + 1 ELSE 1 END)) AS k FROM f {'WHERE inside OR n_ts IS NULL' if legacy else ''})"""
    lon = "least(lon, n_lon) + (greatest(lon, n_lon) - least(lon, n_lon))" if legacy else "lon + (n_lon - lon)"
    lat = "greatest(lat, n_lat) + (least(lat, n_lat) - greatest(lat, n_lat))" if legacy else "lat + (n_lat - lat)"
    return f"{base} SELECT tid, ts + k * 3600 AS ts, round(CASE WHEN inside THEN {lon} * (k * 3600.0::DOUBLE / (n_ts - ts)) ELSE lon END, 6) AS lon, round(CASE WHEN inside THEN {lat} * (k * 3600.0::DOUBLE / (n_ts - ts)) ELSE lat END, 6) AS lat FROM k"


@query("interpolate", _resample_sql(False))
def interpolate(spark, d):
    return trajectories.resample(model.points(spark, d), 3600, 18000).select("tid", "ts", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("interpolate_legacy", _resample_sql(True))
def interpolate_legacy(spark, d):
    return trajectories.resample(model.points(spark, d), 3600, 18000, legacy=True).select("tid", "ts", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


_WIN = "SELECT tid, seq, list(lon) OVER w AS lons, list(lat) OVER w AS lats, list(ts) OVER w AS times FROM points WINDOW w AS (PARTITION BY tid ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)"


@query("sliding_window", f"WITH {P} SELECT seq, lons[1] AS first_lon, lons[8] AS last_lon, times[8] - times[1] AS span FROM ({_WIN}) WHERE len(lons) = 8")
def sliding_window(spark, d):
    w = trajectories.sliding_windows(model.points(spark, d))
    return w.select("seq", F.col("lons")[0].alias("first_lon"), F.col("lons")[7].alias("last_lon"), (F.col("times")[7] - F.col("times")[0]).alias("span"))


@query("prefix_sums", f"WITH {P} SELECT seq, tid, coalesce(sum(state) OVER (PARTITION BY tid ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(state) OVER (PARTITION BY tid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM points")
def prefix_sums(spark, d):
    return trajectories.running_counts(model.points(spark, d))


@query("save_cells_dedup", f"WITH {P}, {_CP} SELECT seq, tid, cell, ts FROM (SELECT *, lag(cell) OVER (PARTITION BY tid ORDER BY ts, seq) AS b FROM cp) WHERE b IS NULL OR b <> cell")
def save_cells_dedup(spark, d):
    return writers.drop_repeated_cells(_cell_points(spark, d)).select("seq", "tid", "cell", "ts")


def _segment_sql(level: int = 8) -> str:
    """All cells around the points' box, found by encoding a fine raster, against every segment."""
    raster = "SELECT (39.0::DOUBLE + y * 0.02::DOUBLE) AS lat, (115.5::DOUBLE + x * 0.02::DOUBLE) AS lon FROM range(100) a(x), range(100) b(y)"
    ends = lambda pre: f"SELECT cell AS {pre}_cell, _f AS {pre}_f, _i AS {pre}_i, _j AS {pre}_j FROM own"
    side = lambda x, y: f"sign((n_lon - lon) * ({y} - lat) - (n_lat - lat) * ({x} - lon))"
    sides = ", ".join(side(f"r.{x}_lon", f"r.{y}_lat") for x in ("min", "max") for y in ("min", "max"))
    share = "least(greatest(((r.c_lon - lon) * (n_lon - lon) + (r.c_lat - lat) * (n_lat - lat)) / ((n_lon - lon) * (n_lon - lon) + (n_lat - lat) * (n_lat - lat)), 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"""WITH {P}, cp AS ({C.encode_sql('SELECT seq, tid, ts, lon, lat FROM points', level)}),
own AS ({C.ij_sql('SELECT DISTINCT cell FROM cp', level)}),
d AS (SELECT *, lead(ts) OVER w AS n_ts, lead(lon) OVER w AS n_lon, lead(lat) OVER w AS n_lat, lead(cell) OVER w AS n_cell FROM cp WINDOW w AS (PARTITION BY tid ORDER BY ts, seq)),
far AS (SELECT d.* FROM d JOIN ({ends('a')}) ON a_cell = cell JOIN ({ends('b')}) ON b_cell = n_cell WHERE a_f = b_f AND (abs(a_i - b_i) > 1 OR abs(a_j - b_j) > 1)),
r AS ({C.rect_sql(f"SELECT DISTINCT cell AS c FROM ({C.encode_sql(raster, level)})", level, 'c')}),
met AS (SELECT tid, seq, r.c AS cell, ts + CAST(floor({share} * (n_ts - ts)) AS BIGINT) AS t, count(*) OVER (PARTITION BY seq) AS n FROM far JOIN r
  ON r.c >= least(far.cell, n_cell) AND r.c < greatest(far.cell, n_cell) AND r.c <> far.cell
  AND greatest(lon, n_lon) >= r.min_lon AND least(lon, n_lon) <= r.max_lon AND greatest(lat, n_lat) >= r.min_lat AND least(lat, n_lat) <= r.max_lat AND least({sides}) <= 0 AND greatest({sides}) >= 0)
SELECT tid, seq, 0::BIGINT AS k, cell, ts FROM cp UNION ALL SELECT tid, seq, row_number() OVER (PARTITION BY seq ORDER BY t, cell) AS k, cell, t AS ts FROM met WHERE n < 10"""


@query("segment_cells", _segment_sql())
def segment_cells(spark, d):
    return trajectories.segment_cells(model.points(spark, d), 8)


# -- shapes --------------------------------------------------------------------------------------------------------------

_LOOP = [(116.1, 39.6), (116.8, 39.7), (116.6, 40.3), (116.4, 39.9), (116.2, 40.4)]


@query("rect_algebra", f"""
WITH {P}, {_BB}, j AS (SELECT a.tid AS a, greatest(a.min_x, b.min_x) AS x0, least(a.max_x, b.max_x) AS x1, greatest(a.min_y, b.min_y) AS y0, least(a.max_y, b.max_y) AS y1,
  least(a.min_x, b.min_x) AS u0, greatest(a.max_x, b.max_x) AS u1, (a.min_x <= b.min_x AND a.max_x >= b.max_x AND a.min_y <= b.min_y AND a.max_y >= b.max_y) AS holds,
  greatest(abs(a.min_x - b.min_x), abs(a.max_x - b.max_x)) AS gap FROM b a JOIN b b ON b.tid = a.tid + 1)
SELECT a, u0, u1, holds, round(gap, 6) AS gap, (x0 > x1 OR y0 > y1) AS empty,
  round(CASE WHEN x0 > x1 OR y0 > y1 THEN 0 ELSE 6378137.0 * 6378137.0 * radians(x1 - x0) * (sin(radians(y1)) - sin(radians(y0))) END / 1e6, 3) AS km2 FROM j""")
def rect_algebra(spark, d):
    names = ("min_x", "min_y", "max_x", "max_y")
    b = _boxes(spark, d)
    c = b.select((F.col("tid") - 1).alias("a"), *[F.col(n).alias(f"o_{n}") for n in names])
    j = b.join(c, F.col("tid") == F.col("a"))
    me, other = ({n: F.col(p + n) for n in names} for p in ("", "o_"))
    both, all_ = shapes.intersection(me, other), shapes.union(me, other)
    return j.select(
        "a", all_["min_x"].alias("u0"), all_["max_x"].alias("u1"), shapes.holds_rect(me, other).alias("holds"),
        r6(shapes.interval_gap(me["min_x"], me["max_x"], other["min_x"], other["max_x"])).alias("gap"), shapes.is_empty(both).alias("empty"), F.round(shapes.area_m2(both) / 1e6, 3).alias("km2"),
    )


@query("polyline_length", f"""
WITH {P}, s AS (SELECT tid, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM points WINDOW w AS (PARTITION BY tid ORDER BY ts, seq)),
q AS (SELECT tid, power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2) AS h FROM s)
SELECT tid, round(coalesce(sum({_HAV}), 0), 1) AS metres FROM q GROUP BY tid""")
def polyline_length(spark, d):
    return shapes.lines(model.points(spark, d)).select("tid", F.round(shapes.length(F.col("line")), 1).alias("metres"))


def _crossings_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(_LOOP, [*_LOOP[1:], _LOOP[0]]):
        parts.append(f"CASE WHEN ({y1}::DOUBLE > lat) <> ({y2}::DOUBLE > lat) AND lon < ({x2}::DOUBLE - {x1}::DOUBLE) * (lat - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END")
    return f"WITH {P} SELECT seq FROM points WHERE ({' + '.join(parts)}) % 2 = 1"


@query("polygon_contains", _crossings_sql())
def polygon_contains(spark, d):
    return model.points(spark, d).filter(shapes.loop_holds(shapes.loop(_LOOP), F.col("lon"), F.col("lat"))).select("seq")


_RASTER = f"SELECT {BOX[3] - 0.3}::DOUBLE + y * 0.01::DOUBLE AS lat, {BOX[0] - 0.3}::DOUBLE + x * 0.01::DOUBLE AS lon FROM range({round((BOX[2] - BOX[0] + 0.6) * 100)}) a(x), range({round((BOX[1] - BOX[3] + 0.6) * 100)}) b(y)"


@query("region_cover", f"""SELECT c AS cell FROM ({C.rect_sql(f"SELECT DISTINCT cell AS c FROM ({C.encode_sql(_RASTER, LEVEL)})", LEVEL, 'c')})
WHERE min_lon <= {BOX[2]} AND max_lon >= {BOX[0]} AND min_lat - {shapes.bulge(LEVEL)!r}::DOUBLE <= {BOX[1]} AND max_lat + {shapes.bulge(LEVEL)!r}::DOUBLE >= {BOX[3]}""")
def region_cover(spark, d):
    """GEO-8: the cells whose rectangle meets a region; SQL finds them by encoding a raster finer than the cells."""
    return shapes.cover(spark, BOX[0], BOX[3], BOX[2], BOX[1], LEVEL)


# -- visits, places, patterns --------------------------------------------------------------------------------------------

_V = f"v AS (SELECT tid, cell, min(ts) AS first_ts FROM cp GROUP BY tid, cell)"
_PC = f"pc AS (SELECT type, cell, min(seq) AS seq FROM ({C.encode_sql(POI_SQL, LEVEL)}) GROUP BY type, cell)"
FINE = 13  # of the category queries: cells so small that not every trajectory passes a place of each category
_CPF = f"cp AS ({C.encode_sql('SELECT seq, tid, ts, lon, lat FROM points', FINE)})"
_PCF = f"pc AS (SELECT type, cell, min(seq) AS seq FROM ({C.encode_sql(POI_SQL, FINE)}) GROUP BY type, cell)"
_T = "('BUILDING', 'MACHINERY', 'FURNITURE')"
_M = f"m AS (SELECT tid, type, arg_min(v.cell, pc.seq) AS cell, arg_min(first_ts, pc.seq) AS first_ts FROM v JOIN pc USING (cell) WHERE type IN {_T} GROUP BY tid, type)"
SPAN = 1_200_000


def _visits(spark, d, level=LEVEL):
    return index.visits(_cell_points(spark, d, level))


def _places(spark, d, level=FINE):
    return pattern.poi_cells(model.poi(spark, d), level)


@query("visits_first_ts", f"WITH {P}, {_CP}, {_V} SELECT * FROM v")
def visits_first_ts(spark, d):
    return _visits(spark, d)


@query("cell_sets", f"WITH {P}, {_CP} SELECT tid, list_sort(list(DISTINCT cell)) AS cells, count(DISTINCT cell) AS n FROM cp GROUP BY tid")
def cell_sets(spark, d):
    return index.cell_sets(_cell_points(spark, d))


@query("poi_cells", f"WITH {_PC} SELECT * FROM pc")
def poi_cells(spark, d):
    return pattern.poi_cells(model.poi(spark, d), LEVEL)


@query("poi_by_type", f"WITH p AS ({POI_SQL}) SELECT seq, name FROM p WHERE type = 'BUILDING'")
def poi_by_type(spark, d):
    return pattern.places_of_type(model.poi(spark, d), "BUILDING").select("seq", "name")


@query("poi_cells_of_type", f"WITH {_PC} SELECT cell FROM pc WHERE type = 'BUILDING'")
def poi_cells_of_type(spark, d):
    return pattern.cells_of_type(pattern.poi_cells(model.poi(spark, d), LEVEL), "BUILDING")


@query("poi_by_name", f"WITH p AS ({POI_SQL}), t AS (SELECT type, name FROM p WHERE seq = 42) SELECT p.seq, p.name, p.type FROM p JOIN t USING (type, name) ORDER BY seq LIMIT 1")
def poi_by_name(spark, d):
    p = model.poi(spark, d)
    t = p.filter("seq = 42").select("type", "name").first()
    return pattern.place_by_name(p, t["type"], t["name"]).select("seq", "name", "type")


@query("poi_types", f"WITH p AS ({POI_SQL}) SELECT type, count(*) AS n, arg_min(name, seq) AS first_name FROM p GROUP BY type")
def poi_types(spark, d):
    return pattern.places_by_type(model.poi(spark, d))


@query("poi_search", f"WITH {P}, {_CPF}, {_V}, {_PCF}, {_M} SELECT tid, count(*) AS n_types, max(first_ts) - min(first_ts) AS span FROM m GROUP BY tid HAVING count(*) = 3 AND max(first_ts) - min(first_ts) < {SPAN}")
def poi_search(spark, d):
    return pattern.poi_search(_visits(spark, d, FINE), _places(spark, d), TYPES, [0, SPAN])


@query("poi_search_legacy", f"WITH {P}, {_CPF}, {_V}, {_PCF}, {_M} SELECT tid, count(*) AS n_types, max(first_ts) - min(first_ts) AS span FROM m GROUP BY tid HAVING max(first_ts) - min(first_ts) < {SPAN}")
def poi_search_legacy(spark, d):
    return pattern.poi_search(_visits(spark, d, FINE), _places(spark, d), TYPES, [0, SPAN], require_all=False)


@query("category_filter", f"WITH {P}, {_CPF}, {_V}, {_PCF}, {_M} SELECT * FROM m WHERE tid IN (SELECT tid FROM m GROUP BY tid HAVING count(*) = 3)")
def category_filter(spark, d):
    return pattern.category_filter(_visits(spark, d, FINE), _places(spark, d), TYPES)


def _count_sql(n: str) -> str:
    return f"WITH {P}, {_CPF}, {_PCF} SELECT tid, {n} AS n FROM cp JOIN pc USING (cell) WHERE type IN {_T} AND ts > {T0} AND ts < {T1} GROUP BY tid HAVING {n} >= 3"


@query("category_count", _count_sql("count(DISTINCT type)"))
def category_count(spark, d):
    return pattern.category_count(_cell_points(spark, d, FINE), _places(spark, d), TYPES, T0, T1)


@query("category_count_legacy", _count_sql("count(*)"))
def category_count_legacy(spark, d):
    return pattern.category_count(_cell_points(spark, d, FINE), _places(spark, d), TYPES, T0, T1, legacy=True)


@query("visiting", f"WITH {P}, {_CPF}, {_V}, {_PCF} SELECT tid, cell, first_ts FROM v WHERE cell IN (SELECT cell FROM pc WHERE type = 'BUILDING')")
def visiting(spark, d):
    """SEL-13, JN-4."""
    return selections.visiting(_visits(spark, d, FINE), pattern.cells_of_type(_places(spark, d), "BUILDING"))


@query("bitmap_visits", f"WITH {P}, {_CPF}, {_V}, {_PCF} SELECT tid, count(*) AS n_cells, min(first_ts) AS first_ts FROM v WHERE first_ts BETWEEN {T0} AND {T1} AND cell IN (SELECT cell FROM pc WHERE type = 'MACHINERY') GROUP BY tid")
def bitmap_visits(spark, d):
    """QRY-15."""
    return index.bitmap_visits(_visits(spark, d, FINE), pattern.cells_of_type(_places(spark, d), "MACHINERY"), T0, T1)


_LONGEST, _WITHIN = 6000.0, 60_000
_CENTRES = f"""pk AS (SELECT type, cell, c_lat, c_lon FROM ({C.center_sql('SELECT DISTINCT type, cell FROM pc', LEVEL)})),
ord AS (SELECT type, row_number() OVER (ORDER BY count(*), type) AS k FROM pk WHERE type IN {_T} GROUP BY type)"""
_DIST = lambda a, b: f"2 * 6378137.0 * asin(sqrt(power(sin(radians({b}.c_lat - {a}.c_lat) / 2), 2) + cos(radians({a}.c_lat)) * cos(radians({b}.c_lat)) * power(sin(radians({b}.c_lon - {a}.c_lon) / 2), 2)))"
_OF = lambda k: f"(SELECT * FROM pk WHERE type = (SELECT type FROM ord WHERE k = {k}))"
_PATHS = f"""two AS (SELECT a.cell AS a, b.cell AS b, b.c_lat, b.c_lon, {_DIST('a', 'b')} AS d FROM {_OF(1)} a JOIN {_OF(2)} b ON {_DIST('a', 'b')} < {_LONGEST}),
paths AS (SELECT [two.a, two.b, c.cell] AS cells, d + {_DIST('two', 'c')} AS distance FROM two JOIN {_OF(3)} c ON d + {_DIST('two', 'c')} < {_LONGEST})"""


def _paths(spark, d):
    cells = pattern.poi_cells(model.poi(spark, d), LEVEL)
    return pattern.expand_paths(cells, by_selectivity(cells, TYPES), LEVEL, _LONGEST)


@query("path_expand", f"WITH {_PC}, {_CENTRES}, {_PATHS} SELECT array_to_string(cells, '-') AS path, round(distance, 2) AS distance FROM paths")
def path_expand(spark, d):
    return _paths(spark, d).select(F.array_join("cells", "-").alias("path"), F.round("distance", 2).alias("distance"))


_COVER = f"""each AS (SELECT array_to_string(cells, '-') AS path, len(list_distinct(cells)) AS want, unnest(list_distinct(cells)) AS cell FROM paths),
g AS (SELECT path, tid, max(first_ts) - min(first_ts) AS interval FROM v JOIN each USING (cell) GROUP BY path, tid, want HAVING count(*) = want)"""


@query("cover_all_cells", f"WITH {P}, {_CP}, {_V}, {_PC}, {_CENTRES}, {_PATHS}, {_COVER} SELECT * FROM g")
def cover_all_cells(spark, d):
    return pattern.covering(_visits(spark, d), _paths(spark, d).select(F.array_join("cells", "-").alias("path"), "cells"))


@query("time_filter", f"WITH {P}, {_CP}, {_V}, {_PC}, {_CENTRES}, {_PATHS}, {_COVER} SELECT DISTINCT tid FROM g WHERE interval < {_WITHIN}")
def time_filter(spark, d):
    return pattern.time_filter(_visits(spark, d), pattern.poi_cells(model.poi(spark, d), LEVEL), TYPES, [0, _WITHIN], _LONGEST / _WITHIN, LEVEL)


_STARTS = "m AS (SELECT tid AS m, min(ts) + 600000 AS latest FROM points GROUP BY tid)"


@query("time_chain", f"""WITH {P}, {_STARTS}, j AS (SELECT m, latest, seq AS pos, dir::BIGINT AS cell, ts,
  list(dir::BIGINT) FILTER (WHERE ts <= latest) OVER (PARTITION BY m ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m JOIN points ON tid = m)
SELECT m, pos, array_to_string(list_concat(list_concat([m::BIGINT], coalesce(seen, [])), [cell]), '-') AS cells, ts AS latest, ts - latest AS interval FROM j WHERE ts > latest AND ts - latest < 500000""")
def time_chain(spark, d):
    """Each trajectory's points against a measure of its own, which ends 600,000 s behind its first point."""
    p = model.points(spark, d)
    m = p.groupBy("tid").agg((F.min("ts") + 600000).alias("latest")).select("tid", F.col("tid").alias("m"), F.array(F.col("tid").cast("long")).alias("cells"), "latest", F.lit(0).cast("long").alias("interval"))
    q = p.select("tid", F.col("seq").alias("pos"), F.col("dir").cast("long").alias("cell"), "ts")
    return pattern.chain(m, q, 500000, key="tid").withColumn("cells", F.array_join("cells", "-"))


# -- trees ---------------------------------------------------------------------------------------------------------------

_RP = f"rp AS (SELECT cell AS x, ts AS y, seq AS id FROM cp), rn AS (SELECT *, (row_number() OVER (ORDER BY x, y, id) - 1) // 4 AS node FROM rp)"
_LV = "l0 AS (SELECT node, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM rn GROUP BY node)"


def _tree_points(spark, d):
    return _cell_points(spark, d).select(F.col("cell").alias("x"), F.col("ts").alias("y"), F.col("seq").alias("id"))


@query("rtree_leaves", f"WITH {P}, {_CP}, {_RP}, {_LV} SELECT * FROM l0")
def rtree_leaves(spark, d):
    return index.leaves(_tree_points(spark, d))


def _levels_sql() -> str:
    ctes, parts = [P, _CP, _RP, _LV], ["SELECT 0 AS level, * FROM l0"]
    for k in range(1, 16):
        ctes.append(f"l{k} AS (SELECT node // 4 AS node, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, count(*) AS n FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 4 GROUP BY node // 4)")
        parts.append(f"SELECT {k} AS level, * FROM l{k}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("rtree_levels", _levels_sql())
def rtree_levels(spark, d):
    return index.tree(_tree_points(spark, d))


_RECTS = f"rects AS (SELECT seq AS rect, cell - {40 * _LSB} AS min_x, cell + {40 * _LSB} AS max_x, ts - 50000 AS min_y, ts + 50000 AS max_y FROM cp WHERE seq % 100 = 0)"


@query("rtree_search", f"WITH {P}, {_CP}, {_RECTS} SELECT rect, seq AS id FROM cp JOIN rects ON cell > min_x AND cell < max_x AND ts > min_y AND ts < max_y")
def rtree_search(spark, d):
    c = _cell_points(spark, d)
    rects = c.filter("seq % 100 = 0").select(F.col("seq").alias("rect"), (F.col("cell") - 40 * _LSB).alias("min_x"), (F.col("cell") + 40 * _LSB).alias("max_x"), (F.col("ts") - 50000).alias("min_y"), (F.col("ts") + 50000).alias("max_y"))
    return index.search(_tree_points(spark, d), rects)


@query("cells_near", f"WITH {P}, {_CP}, c AS (SELECT DISTINCT cell AS c FROM cp WHERE seq % 100 = 0) SELECT DISTINCT tid FROM cp JOIN c ON cell BETWEEN c - 10000000000 AND c + 10000000000 WHERE ts BETWEEN {T0} AND {T1}")
def cells_near(spark, d):
    c = _cell_points(spark, d)
    return index.cells_near(c, c.filter("seq % 100 = 0"), T0, T1, 10_000_000_000)


@query("packed_boxes", f"WITH {P}, {_BB} SELECT tid, (row_number() OVER (ORDER BY min_x DESC, tid) - 1) // 4 AS node FROM b")
def packed_boxes(spark, d):
    return index.packed_boxes(_boxes(spark, d))


def _quadtree_sql(depth: int = 3) -> str:
    ctes = [P, _BB, "k0 AS (SELECT '' AS path, *, 116.0::DOUBLE AS x0, 39.5::DOUBLE AS y0, 117.0::DOUBLE AS x1, 40.5::DOUBLE AS y1 FROM b)"]
    parts = []
    for k in range(depth):
        ctes.append(f"c{k} AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM k{k})")
        parts.append(f"SELECT path, tid FROM c{k} WHERE n <= 1")
        kid = lambda q, when, a, b, c, e: f"SELECT path || '{q}' AS path, tid, min_x, min_y, max_x, max_y, {a} AS x0, {b} AS y0, {c} AS x1, {e} AS y1 FROM c{k} WHERE n > 1 AND {when}"  # noqa: E731, B023
        ctes.append(f"k{k + 1} AS (" + " UNION ALL ".join([
            kid(0, "min_x < cx AND max_y >= cy", "x0", "cy", "cx", "y1"), kid(1, "max_x >= cx AND max_y >= cy", "cx", "cy", "x1", "y1"),
            kid(2, "min_x < cx AND min_y < cy", "x0", "y0", "cx", "cy"), kid(3, "max_x >= cx AND min_y < cy", "cx", "y0", "x1", "cy")]) + ")")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)} UNION ALL SELECT path, tid FROM k{depth}"


def _quadtree(spark, d):
    return index.quadtree(_boxes(spark, d), (116.0, 39.5, 117.0, 40.5))


@query("quadtree_nodes", _quadtree_sql())
def quadtree_nodes(spark, d):
    return _quadtree(spark, d).select("path", "tid")


@query("quadtree_search", f"WITH {P}, {_BB} SELECT tid FROM b WHERE min_x < 116.25 AND max_x > 116.2 AND min_y < 39.8 AND max_y > 39.7")
def quadtree_search(spark, d):
    return index.quadtree_search(_quadtree(spark, d), 116.2, 39.7, 116.25, 39.8)


# -- grids, clusters, projection, export -----------------------------------------------------------------------------------

_EDGE = (116.0, 40.5, 117.0, 39.5, 20, 10)


@query("heatmap_grid", "SELECT id AS cell, round(116.0::DOUBLE + (id % 20) * 0.05::DOUBLE, 6) AS \"left\", round(40.5::DOUBLE - (id // 20) * 0.1::DOUBLE, 6) AS top, round(116.0::DOUBLE + (id % 20 + 1) * 0.05::DOUBLE, 6) AS \"right\", round(40.5::DOUBLE - (id // 20 + 1) * 0.1::DOUBLE, 6) AS bottom FROM range(200) t(id)")
def heatmap_grid(spark, d):
    g = grid.grid(spark, *_EDGE)
    return g.select("cell", *[r6(F.col(c)).alias(c) for c in ("left", "top", "right", "bottom")])


@query("heatmap_counts", f"""WITH {P}, g AS (SELECT tid, least(floor((40.5::DOUBLE - lat) / ((40.5::DOUBLE - 39.5::DOUBLE) / 10))::BIGINT, 9) * 20 + least(floor((lon - 116.0::DOUBLE) / ((117.0::DOUBLE - 116.0::DOUBLE) / 20))::BIGINT, 19) AS cell
  FROM points WHERE lon > 116.0 AND lon < 117.0 AND lat > 39.5 AND lat < 40.5)
SELECT id AS cell, count(DISTINCT tid) AS n FROM range(200) t(id) LEFT JOIN g ON g.cell = id GROUP BY id""")
def heatmap_counts(spark, d):
    return grid.heat_map(model.points(spark, d), *_EDGE)


_CL = f"""points AS ({POINTS_SQL}), cl AS (SELECT seq AS id, lon AS x, lat AS y FROM (SELECT *, lag(state) OVER (PARTITION BY tid ORDER BY ts, seq) AS b FROM points) WHERE b <> state)"""
_EPS, _MINPTS = 0.0125, 4
_DB = f"""{_CL}, near AS (SELECT a.id AS a, b.id AS b FROM cl a JOIN cl b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {_EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {_MINPTS}), link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS other FROM core UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.other = link.a),
lab AS (SELECT id, min(other) AS label FROM reach GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab),
border AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN num ON num.id = b WHERE a NOT IN (FROM core) GROUP BY a),
labels_ AS (SELECT cl.id, coalesce(num.cluster, border.cluster, -2) AS cluster FROM cl LEFT JOIN num USING (id) LEFT JOIN border USING (id))"""


def _ends(spark, d):
    """All pick-ups and drop-offs."""
    return trajectories.end_points(model.points(spark, d)).select(F.col("seq").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))


@query("neighbor_pairs", f"WITH {_CL} SELECT a.id AS a, b.id AS b FROM cl a JOIN cl b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {_EPS}")
def neighbor_pairs(spark, d):
    return grid.neighbors(_ends(spark, d), _EPS)


@query("dbscan_labels", f"WITH RECURSIVE {_DB} SELECT * FROM labels_")
def dbscan_labels(spark, d):
    return grid.dbscan(_ends(spark, d), _EPS, _MINPTS)


@query("cluster_centers", f"WITH RECURSIVE {_DB} SELECT cluster, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM cl JOIN labels_ USING (id) WHERE cluster >= 0 GROUP BY cluster")
def cluster_centers(spark, d):
    p = _ends(spark, d)
    c = grid.cluster_centers(p, grid.dbscan(p, _EPS, _MINPTS))
    return c.select("cluster", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "n")


def _lsh_sql(dims: int = 8, functions: int = 4, seed: int = 7) -> str:
    parts = []
    for f, a, b in G.lsh_coefficients(dims, functions, seed):
        total = "0.0::DOUBLE"
        for name in ("lons", "lats"):
            for m in range(dims):
                total = f"({total} + {a[m]!r}::DOUBLE * {name}[{m + 1}])"
        parts.append(f"SELECT tid, seq, {f} AS f, trunc({total} + {b!r}::DOUBLE)::INTEGER AS bucket FROM w")
    return f"WITH {P}, w AS (SELECT * FROM ({_WIN}) WHERE len(lons) = 8) {' UNION ALL '.join(parts)}"


@query("lsh_project", _lsh_sql())
def lsh_project(spark, d):
    return grid.lsh_project(trajectories.sliding_windows(model.points(spark, d)), 8, 4, 7)


@query("json_export", f"""WITH {P} SELECT tid, len(list(seq)) AS n, '{{"trip":' || tid || ',"points":[' || string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY ts, seq) || ',[0.0,0.0]]}}' AS json FROM points GROUP BY tid""")
def json_export(spark, d):
    j = writers.trajectory_json(model.points(spark, d))
    return j.select("tid", (F.size(F.from_json("json", "trip int, points array<array<double>>")["points"]) - 1).cast("long").alias("n"), "json")


# -- set algebra ---------------------------------------------------------------------------------------------------------

_SETS = f"""s AS (SELECT tid, list_sort(list(DISTINCT speed::BIGINT)) AS a, list_sort(list(DISTINCT (seq % 100)::BIGINT)) AS b FROM points GROUP BY tid)"""


def _sets(spark, d):
    p = model.points(spark, d)
    return p.groupBy("tid").agg(B.of(F.collect_set(F.col("speed").cast("long"))).alias("a"), B.of(F.collect_set(F.col("seq") % 100)).alias("b"))


def _bitmap(name: str, sql: str, f) -> None:
    @query(f"bitmap_{name}", f"WITH {P}, {_SETS} SELECT tid, {sql} AS r FROM s")
    def run(spark, d):
        return _sets(spark, d).select("tid", f(F.col("a"), F.col("b")).alias("r"))


_bitmap("and", "list_sort(list_intersect(a, b))", B.both)
_bitmap("or", "list_sort(list_distinct(list_concat(a, b)))", B.either)
_bitmap("andnot", "list_sort(list_filter(a, lambda e: NOT list_contains(b, e)))", B.without)
_bitmap("xor", "list_sort(list_concat(list_filter(a, lambda e: NOT list_contains(b, e)), list_filter(b, lambda e: NOT list_contains(a, e))))", B.one_of)
_bitmap("flip", "list_sort(list_concat(list_filter(a, lambda e: e < 10 OR e >= 60), list_filter(range(10, 60), lambda e: NOT list_contains(a, e))))", lambda a, b: B.flip(a, F.lit(10).cast("long"), F.lit(60).cast("long")))
_bitmap("jaccard", "round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9)", lambda a, b: F.round(B.jaccard(a, b), 9))
_bitmap("rank", "len(list_filter(a, lambda e: e <= 40))", lambda a, b: B.rank(a, F.lit(40)))
_bitmap("select", "list_sort(a)[3]", lambda a, b: B.select(a, F.lit(2)))
_bitmap("cardinality", "len(a)", lambda a, b: B.cardinality(a))
_bitmap("minmax", "list_min(a) * 1000 + list_max(a)", lambda a, b: B.lowest(a) * 1000 + B.highest(a))
_bitmap("subset", "len(list_filter(list_intersect(a, b), lambda e: NOT list_contains(b, e))) = 0", lambda a, b: B.is_subset(B.both(a, b), b))
_bitmap("contains", "list_contains(a, 50)", lambda a, b: B.contains(a, F.lit(50).cast("long")))
_bitmap("add_remove", "list_sort(list_distinct(list_append(list_filter(a, lambda e: e <> 7), 1000)))", lambda a, b: B.add(B.remove(a, F.lit(7).cast("long")), F.lit(1000).cast("long")))


@query("set_intersect_all", f"WITH {P} SELECT speed FROM points INTERSECT ALL SELECT dir FROM points")
def set_intersect_all(spark, d):
    """SET-2, PRM-13: as often as on the side with fewer."""
    p = model.points(spark, d)
    return p.select("speed").intersectAll(p.select("dir"))


@query("append_union", "SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey AS k FROM lineitem")
def append_union(spark, d):
    """SET-4: a bag."""
    return model.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).unionByName(model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


# -- files: tables written as text to the shared folder and read back ----------------------------------------------------------


def _local(ts, pattern: str):
    """Epoch seconds as the logs' local time."""
    return F.date_format(F.timestamp_seconds(ts + X.LOCAL_SECONDS), pattern)


def _text_file(df: DataFrame, name: str, header: bool = False) -> str:
    path = new_path(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


@query("read_log7", f"WITH {P} SELECT tid, lon, lat, ts, state, speed, dir FROM points")
def read_log7(spark, d):
    """SRC-2, SRC-8."""
    p = model.points(spark, d)
    return readers.read_log7(spark, _text_file(p.select("tid", "lon", "lat", F.concat(_local(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(".250")), "state", "speed", "dir"), "log7"))


@query("read_log4", f"WITH {P} SELECT tid, lon, lat, ts FROM points")
def read_log4(spark, d):
    """SRC-3, SRC-9."""
    p = model.points(spark, d)
    return readers.read_log4(spark, _text_file(p.select("tid", _local(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), "lon", "lat"), "log4")).select("tid", "lon", "lat", "ts")


@query("read_log_headed", f"WITH {P} SELECT tid, lon, lat, ts FROM points")
def read_log_headed(spark, d):
    """SRC-7, SRC-10: a header, a column that is skipped, and columns behind."""
    p = model.points(spark, d)
    return readers.read_log_headed(spark, _text_file(p.select(F.lit("x").alias("skipped"), _local(F.col("ts"), "dd/MM/yyyy HH:mm:ss").alias("time"), "tid", "lon", "lat"), "headed", header=True)).select("tid", "lon", "lat", "ts")


@query("read_cell_points", f"WITH {P}, {_CP} SELECT cell, tid, ts FROM (SELECT *, lag(cell) OVER (PARTITION BY tid ORDER BY ts, seq) AS b FROM cp) WHERE b IS NULL OR b <> cell")
def read_cell_points(spark, d):
    """SRC-4, TRJ-3: cells of whole logs, saved without consecutive repeats, and read back."""
    path = new_path(spark, "cells")
    writers.save_cells(_cell_points(spark, d), path)
    return readers.read_cell_points(spark, path)


@query("read_poi", f"WITH p AS ({POI_SQL}) SELECT name, type, round(lon::FLOAT::DOUBLE, 4) AS lon, round(lat::FLOAT::DOUBLE, 4) AS lat FROM p WHERE type <> 'HOUSEHOLD'")
def read_poi(spark, d):
    """SRC-11: places of one category are written without coordinates, as lines that the reader drops."""
    p = model.poi(spark, d).select("name", "type", F.when(F.col("type") != "HOUSEHOLD", F.col("lon")).alias("lon"), "lat")
    return readers.read_poi(spark, _text_file(p, "poi")).select("name", "type", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("lon", "lat")])


@query("read_catalog", f"WITH c AS ({CATALOG_SQL}) SELECT CAST(file_id AS VARCHAR) AS file_id, path FROM c")
def read_catalog(spark, d):
    """SRC-12."""
    c = cat.read_catalog(spark, _text_file(model.catalog(spark, d).select("file_id", "path"), "catalog"))
    return c.select(F.col("file_id").cast("string").alias("file_id"), "path")


@query("catalog_insert", f"WITH c AS ({CATALOG_SQL}) SELECT CAST(file_id AS VARCHAR) AS file_id, min(path) AS path FROM (SELECT file_id, arg_min(path, seq) AS path FROM c GROUP BY file_id) GROUP BY file_id")
def catalog_insert(spark, d):
    """CAT-4: of a catalogue to which all its keys are added again with other paths the first paths count."""
    c = model.catalog(spark, d)
    more = c.withColumn("path", F.concat(F.lit("/again"), "path"))
    return cat.earliest(cat.insert(c, more)).select(F.col("file_id").cast("string").alias("file_id"), "path")


@query("count_lines", "SELECT count(*) AS n FROM lineitem")
def count_lines(spark, d):
    """SRC-16, SRC-19, AGG-10."""
    n = readers.count_lines(spark, _text_file(model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "lines"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("list_files", "SELECT DISTINCT c_mktsegment AS type FROM customer")
def list_files(spark, d):
    """SRC-13 to SRC-15: folders of a partitioned table, found without reading a file."""
    path = new_path(spark, "by-type")
    model.poi(spark, d).write.partitionBy("type").csv(path)
    return readers.list_files(spark, path).select(F.regexp_extract("path", "type=([^/]+)/", 1).alias("type")).distinct()


@query("read_pipe_lines", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def read_pipe_lines(spark, d):
    """SRC-18."""
    path = new_path(spark, "pipes")
    model.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").write.option("sep", "|").csv(path)
    f = readers.read_pipe_lines(spark, path, ["k", "n", "flag"])
    return f.select(F.col("k").cast("long").alias("l_orderkey"), F.col("n").cast("int").alias("l_linenumber"), F.col("flag").alias("l_returnflag"))


# -- more functions and indexes --------------------------------------------------------------------------------------------


@query("flagged", f"WITH {P} SELECT seq, tid FROM points WHERE state = 1")
def flagged(spark, d):
    """SEL-10."""
    return selections.flagged(model.points(spark, d), "state").select("seq", "tid")


@query("clustered", f"WITH {P}, {_CP} SELECT tid, seq, cell, ts FROM cp")
def clustered(spark, d):
    """IDX-4."""
    return index.clustered(_cell_points(spark, d)).select("tid", "seq", "cell", "ts")


@query("quadtree_search_time", f"WITH {P}, b AS (SELECT {_DAY} AS tid, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y, min(ts) AS min_ts, max(ts) AS max_ts FROM points GROUP BY {_DAY}) SELECT tid FROM b WHERE min_x < 116.25 AND max_x > 116.2 AND min_y < 39.8 AND max_y > 39.7 AND max_ts > {T0} AND min_ts < {T1}")
def quadtree_search_time(spark, d):
    """QRY-4 with times."""
    p = _days(spark, d)
    boxes = trajectories.bounding_boxes(p).join(p.groupBy("tid").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")), "tid")
    return index.quadtree_search(index.quadtree(boxes, (116.0, 39.5, 117.0, 40.5)), 116.2, 39.7, 116.25, 39.8, T0, T1)


def _point_quadtree_sql(depth: int = 5, most: int = 16) -> str:
    ctes = [f"k0 AS (SELECT seq AS id, '' AS path, lon - 116.0::DOUBLE AS x, lat - 39.5::DOUBLE AS y, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0 FROM points)"]
    parts = []
    for k in range(depth):
        w = 0.5 ** (k + 1)
        ctes.append(f"c{k} AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, x >= x0 + {w}::DOUBLE AS e, y >= y0 + {w}::DOUBLE AS u FROM k{k})")
        parts.append(f"SELECT id, path FROM c{k} WHERE n <= {most}")
        ctes.append(f"k{k + 1} AS (SELECT id, path || CASE WHEN u THEN CASE WHEN e THEN '1' ELSE '0' END ELSE CASE WHEN e THEN '3' ELSE '2' END END AS path, x, y, CASE WHEN e THEN x0 + {w}::DOUBLE ELSE x0 END AS x0, CASE WHEN u THEN y0 + {w}::DOUBLE ELSE y0 END AS y0 FROM c{k} WHERE n > {most})")
    return f"WITH {P}, {', '.join(ctes)} {' UNION ALL '.join(parts)} UNION ALL SELECT id, path FROM k{depth}"


@query("point_quadtree", _point_quadtree_sql())
def point_quadtree(spark, d):
    """IDX-18."""
    p = model.points(spark, d).select(F.col("seq").alias("id"), (F.col("lon") - 116.0).alias("x"), (F.col("lat") - 39.5).alias("y"))
    return index.point_quadtree(p, 5, 16)


@query("cell_square", f"WITH {P}, {_CP}, c AS ({C.ij_sql('SELECT DISTINCT cell FROM cp', LEVEL)}) SELECT cell, (_i + 0.5::DOUBLE) / {1 << LEVEL} AS s, (_j + 0.5::DOUBLE) / {1 << LEVEL} AS t, 1.0::DOUBLE / {1 << LEVEL} AS size FROM c")
def cell_square(spark, d):
    """FN-17."""
    c = _cell_points(spark, d).select("cell").distinct().withColumn("m", C.center_st(F.col("cell"), LEVEL))
    return c.select("cell", "m.s", "m.t", F.lit(C.size_st(LEVEL)).alias("size"))


@query("distinct_per_key", f"WITH {P} SELECT tid, count(DISTINCT speed) AS n FROM points GROUP BY tid")
def distinct_per_key(spark, d):
    """AGG-12."""
    return model.points(spark, d).groupBy("tid").agg(F.countDistinct("speed").alias("n"))


@query("format_double", "SELECT c_custkey, substr(regexp_replace(CAST(c_acctbal::DECIMAL(38,10) AS VARCHAR), '\\.?0+$', ''), 1, 8) AS s FROM customer")
def format_double(spark, d):
    """FN-9: cut after eight characters."""
    return model.table(spark, d, "customer").select("c_custkey", X.format_double(F.col("c_acctbal"), legacy=True).alias("s"))


@query("normal_cdf", "SELECT c_custkey, round((SELECT sum(exp(-(x * x) / 2) / sqrt(2 * pi()) * 0.01) FROM (SELECT -10.0::DOUBLE + k * 0.01::DOUBLE AS x FROM range(0, greatest(floor((v + 10.0::DOUBLE) / 0.01::DOUBLE), 0)::BIGINT) t(k))), 6) AS cdf FROM (SELECT c_custkey, (c_custkey % 7 - 3)::DOUBLE / 2 + 0.003::DOUBLE AS v FROM customer)")
def normal_cdf(spark, d):
    """FN-29 by the rectangle rule."""
    v = (F.col("c_custkey") % 7 - 3).cast("double") / 2 + 0.003
    return model.table(spark, d, "customer").select("c_custkey", F.round(G.normal_cdf(v), 6).alias("cdf"))
