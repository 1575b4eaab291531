"""Known values, edge cases and properties of the functions and operators."""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline import model
from driftline.functions import bitmaps as B
from driftline.functions import cells as C
from driftline.functions import geometry as G
from driftline.functions import shapes
from driftline.functions import text as X
from driftline.operators import grid, index, pattern, selections, trajectories
from driftline.plans import graph, strategy
from driftline.sources import catalog, readers, writers

from .conftest import DATA


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r) if len(cols) > 1 else r[0]


def test_djb2(spark):
    assert str(one(spark, catalog.djb2(F.lit("20140101C02668")))) == "17756674167933085911"
    assert int(one(spark, catalog.djb2(F.lit("")))) == 5381


def test_cells_of_known_places(spark):
    at = lambda lat, lon, level: C.encode(F.lit(lat), F.lit(lon), level)
    assert one(spark, at(39.99298, 116.313163, 11), at(39.99298, 116.313163, 12)) == [3886701861054447616, 3886701792334970880]
    assert one(spark, at(28.233, 121.345, 11), at(28.233, 121.345, 12)) == [3769449391312601088, 3769449185154170880]
    assert one(spark, *[C.level_of(F.lit(x)) for x in (3886896405893087232, 3886698837397471232, 3887075145252077568)]) == [12, 9, 11]
    m = one(spark, C.center(F.lit(3886896405893087232), 12))
    assert m.lat == pytest.approx(40.0294888301717, abs=1e-9) and m.lon == pytest.approx(116.57278151895592, abs=1e-9)


def test_cells_everywhere(spark):
    """On all six faces: the middle of a cell is in it, parents hold it, and its rectangle holds the middle."""
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-89, 89, 300), rng.uniform(-179, 179, 300))]
    d = spark.createDataFrame(rows, "lat double, lon double")
    for level in (1, 7, 15, 24):
        c = d.withColumn("c", C.encode(F.col("lat"), F.col("lon"), level)).withColumn("m", C.center(F.col("c"), level))
        r = c.select(
            "c", C.encode(F.col("m.lat"), F.col("m.lon"), level).alias("again"), C.level_of(F.col("c")).alias("level"),
            C.contains(C.parent(F.col("c"), 1), F.col("c")).alias("held"), C.child_begin(F.col("c"), level + 1).alias("kid"), C.edge_neighbors(F.col("c"), level).alias("near"),
        ).collect()
        assert all(x.c == x.again and x.level == level and x.held for x in r)
        assert all(x.kid < x.c and 2 <= len(x.near) <= 4 and x.c not in x.near for x in r)
    assert len({x for x, in c.select(C.face_of(F.col("c"))).distinct().collect()}) == 6
    assert one(spark, C.token(F.lit(3886701861054447616))) == f"{3886701861054447616:016x}".rstrip("0")


def test_segment_meets_rect(spark):
    f = lambda *v: G.segment_meets_rect(*[F.lit(float(x)) for x in v])
    assert one(spark, f(1, 1, 5, 3, 2, 1, 4, 3), f(0, 0, 1, 5, 2, 1, 4, 3), f(1, 3, 2.4, 4.4, 2, 1, 4, 3)) == [True, False, False]


def test_parsing(spark):
    s = lambda *v: [F.lit(x) for x in v]
    assert one(spark, *[X.parse_int(c) for c in s("12ab", "", " \n-7", "+4")]) == [12, 0, -7, 4]
    assert one(spark, *[X.parse_double(c) for c in s(" -1.50x", "3", ".5", "x")]) == [-1.5, 3.0, 0.5, None]
    assert str(one(spark, X.parse_unsigned(F.lit("18446744073709551615")))) == "18446744073709551615"
    assert one(spark, X.parse_local(F.lit("2014-01-01 08:00:01.999")), X.parse_local_dmy(F.lit("02/01/2014 00:00:00")), X.parse_local(F.lit("no date"))) == [1388534401, 1388592000, None]
    assert one(spark, X.round_half_down(F.lit(2.5)), X.round_half_down(F.lit(2.51)), X.format_double(F.lit(116.123456789), legacy=True)) == [2, 3, "116.1234"]
    assert one(spark, X.split_fields(F.lit("a;;b"), ";"), X.split_fields(F.lit("a;;b"), ";", skip_empty=True)) == [["a", "", "b"], ["a", "b"]]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.csv").write_text("7,116.31,39.99,2014-01-01 08:00:00.000,1,20,3\nbad,,x,,,,\n")
    (tmp_path / "a/two.csv").write_text("8,116.32,39.98,2014-01-01 08:00:05.000,0,21,4\n")
    got = readers.read_log7(spark, f"{tmp_path}/a").orderBy("tid").collect()
    assert [tuple(r)[:4] for r in got] == [(0, None, None, None), (7, 116.31, 39.99, 1388534400), (8, 116.32, 39.98, 1388534405)]
    (tmp_path / "four.csv").write_text("7,2014-01-01 08:00:00,116.31,39.99\n")
    assert tuple(readers.read_log4(spark, f"{tmp_path}/four.csv").first())[:4] == (7, 116.31, 39.99, 1388534400)
    (tmp_path / "head.csv").write_text("k,time,tid,lon,lat,more\n0,01/01/2014 08:00:00,7,116.31,39.99,z\n")
    assert tuple(readers.read_log_headed(spark, f"{tmp_path}/head.csv").first())[:4] == (7, 116.31, 39.99, 1388534400)
    (tmp_path / "poi.csv").write_text("A, food;x,116.3,39.9\nbroken line\nB,shop,1,\nC,food,116.4,40\n")
    assert [r.name for r in readers.read_poi(spark, f"{tmp_path}/poi.csv").orderBy("name").collect()] == ["A", "C"]
    key = one(spark, catalog.file_key(F.lit("20140101"), F.lit("7")))
    (tmp_path / "index.txt").write_text(f"{key},{tmp_path}/a/one.csv\n")
    c = catalog.read_catalog(spark, f"{tmp_path}/index.txt").withColumn("seq", F.lit(1))
    wanted = spark.createDataFrame([(key,), (Decimal(1),)], "file_id decimal(20,0)")
    assert readers.load_by_ids(spark, c, wanted).filter("tid > 0").count() == 1 and catalog.unmatched(c, wanted).count() == 1
    assert readers.list_files(spark, str(tmp_path), glob="*.csv").count() == 5 and readers.count_lines(spark, f"{tmp_path}/poi.csv") == 4
    more = catalog.insert(c, c.select("file_id", F.lit("later").alias("path"), F.lit(1).alias("seq")))
    assert [r.path for r in catalog.lookup(more, wanted).collect()] == [f"{tmp_path}/a/one.csv"]
    p = readers.random_points(spark, 50)
    assert p.filter("x between 0 and 1 and y between 0 and 1").count() == 50


def test_writers(spark, tmp_path):
    p = spark.createDataFrame([(98, 1, 1, 40.1, 40.1), (98, 2, 2, 39.9, 39.9), (86, 3, 1, 121.1, 121.1)], "tid int, seq long, ts long, lon double, lat double")
    j = {r.tid: r.json for r in writers.trajectory_json(p).collect()}
    assert json.loads(j[98]) == {"trip": 98, "points": [[40.1, 40.1], [39.9, 39.9], [0.0, 0.0]]}
    assert {r.json[-1] for r in writers.trajectory_json(p, legacy=True).collect()} == {"]"}
    writers.save_json(p, f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").count() == 2
    c = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 2, 5), (1, 3, 3, 6), (1, 4, 4, 5)], "tid int, seq long, ts long, cell long")
    writers.save_cells(c, f"{tmp_path}/c")
    assert [tuple(r) for r in readers.read_cell_points(spark, f"{tmp_path}/c").orderBy("ts").collect()] == [(5, 1, 1), (6, 1, 3), (5, 1, 4)]


def test_small_fixtures(spark):
    keys, values = [1, 3, 3, 3, 3, 2, 1, 2, 2, 1], [9, 8, 7, 5, 6, 7, 8, 7, 6, 9]
    d = spark.createDataFrame(list(zip(keys, values)), "k int, v int")
    assert {r.k: r.n for r in d.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()} == {1: 2, 2: 2, 3: 4}
    a, b = ([(x,) for x in v] for v in ((13, 1, 5, 3, 1, 1, 0), (13, 8, 5, 3, 2, 1, 1)))
    assert sorted(r[0] for r in spark.createDataFrame(a, "v int").intersectAll(spark.createDataFrame(b, "v int")).collect()) == [1, 1, 3, 5, 13]
    p = spark.createDataFrame([(1, k, 100 * k, float(k), float(k)) for k in range(15)], "tid int, seq long, ts long, lon double, lat double")
    assert trajectories.sliding_windows(p, 8).count() == 8
    r = spark.createDataFrame([(x, x, x) for x in (2, 4, 5, 9, 8, 1, 7, 6, 3, 11)], "x long, y long, id int")
    assert [tuple(v)[:3] + (v.n,) for v in index.leaves(r).orderBy("node").collect()] == [(0, 1, 4, 4), (1, 5, 8, 4), (2, 9, 11, 2)]
    rect = lambda *v: spark.createDataFrame([(1, *v)], "rect int, min_x long, max_x long, min_y long, max_y long")
    assert index.search(r, rect(5, 9, 3, 5)).count() == 0 and {v.id for v in index.search(r, rect(4, 9, 4, 10)).collect()} == {5, 6, 7, 8}


def test_search_equals_full_scan(spark):
    p = model.points(spark, DATA)
    pts = index.cell_points(p, 11).select(F.col("cell").alias("x"), F.col("ts").alias("y"), F.col("seq").alias("id")).cache()
    x0, x1, y0, y1 = pts.selectExpr("percentile(x, 0.3)", "percentile(x, 0.6)", "percentile(y, 0.2)", "percentile(y, 0.7)").first()
    rect = spark.createDataFrame([(0, int(x0), int(x1), int(y0), int(y1))], "rect int, min_x long, max_x long, min_y long, max_y long")
    want = {r.id for r in pts.filter(F.col("x").between(int(x0) + 1, int(x1) - 1) & F.col("y").between(int(y0) + 1, int(y1) - 1)).collect()}
    assert want and {r.id for r in index.search(pts, rect).collect()} == want
    r = strategy.ranked(pts, [F.col("x"), F.col("y"), F.col("id")])
    ranks = r.orderBy("x", "y", "id").select("rn").collect()
    assert [x.rn for x in ranks] == list(range(1, pts.count() + 1))


def test_point_quadtree_holds_its_rules(spark):
    p = readers.random_points(spark, 1024)
    q = index.point_quadtree(p).cache()
    assert q.count() == 1024 and q.select("id").distinct().count() == 1024
    for path, n in q.groupBy("path").count().collect():
        assert n <= 16 or len(path) == 8
    deep = q.join(p, "id").withColumn("east", F.substring("path", 1, 1).isin("1", "3"))
    assert deep.filter("path <> '' AND east <> (x >= 0.5)").count() == 0


def test_dbscan(spark):
    rows = [(k, float(k % 3) * 0.4 + (10 if k > 8 else 0), float(k // 3 % 3) * 0.4) for k in range(18)] + [(18, 100.0, 100.0), (19, 1.7, 0.0)]
    d = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.cluster for r in grid.dbscan(d, 1.0, 3).collect()}
    assert {got[k] for k in range(9)} == {0} and {got[k] for k in range(9, 18)} == {1} and got[18] == grid.NOISE and got[19] == 0
    assert {r.cluster: r.n for r in grid.cluster_centers(d, grid.dbscan(d, 1.0, 3)).collect()} == {0: 10, 1: 9}
    assert {r.cluster for r in grid.dbscan(d, 0.1, 1).collect()} == {grid.NOISE}


def test_dbscan_pairs_places_not_points(spark, monkeypatch):
    """300 points at each of three places in reach of the next, one beside them that few reach, and points without a place."""
    seen = {}
    whole = grid.materialise
    monkeypatch.setattr(grid, "materialise", lambda df, name: seen.setdefault(name, whole(df, name)))
    rows = [(k, float(k % 3), 0.0) for k in range(900)] + [(900, 2.0, 1.0), (901, 50.0, 0.0), (902, 50.0, 0.0)]
    rows += [(903 + k, float("nan"), 0.0) for k in range(9)] + [(912 + k, None, 0.0) for k in range(9)]
    d = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.cluster for r in grid.dbscan(d, 1.0, 301).collect()}
    assert {k for k, c in got.items() if c == 0} == set(range(901)) and {got[k] for k in range(901, 921)} == {grid.NOISE} and len(got) == 921
    assert seen["neighbors"].count() == 3


def test_search_moves_no_hits(spark, monkeypatch):
    """Rectangles of all sizes against a brute force, with and without a broadcast; leaves and points are not joined by node again."""
    pts = spark.range(1500).select((F.col("id") * 7919 % 997).alias("x"), (F.col("id") * 104729 % 1009).alias("y"), "id")
    rows = [(k, k * 31 % 900, k * 31 % 900 + 3 * k, k * 17 % 800, k * 17 % 800 + 5 * k) for k in range(120)] + [(200, -5, 5000, -5, 5000), (201, 9, 3, 0, 50), (202, 0, 50, 9, 3), (203, 2000, 3000, 0, 9)]
    rects = spark.createDataFrame(rows, "rect int, min_x long, max_x long, min_y long, max_y long")
    own = [tuple(r) for r in pts.collect()]
    want = sorted((r[0], i) for r in rows for x, y, i in own if r[1] < x < r[2] and r[3] < y < r[4])
    for most in (20_000, 0):
        monkeypatch.setattr(index, "BROADCAST_SLOTS", most)
        found = index.search(pts, rects)
        assert sorted(tuple(r) for r in found.collect()) == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert index.search(pts.limit(0), rects).count() == 0 and index.search(pts, rects.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 102)} == {100}


def test_segment_cells(spark):
    p = spark.createDataFrame([(1, 1, 0, 116.0, 39.6), (1, 2, 1000, 116.9, 40.4), (2, 3, 0, 116.0, 40.0), (2, 4, 10, 116.001, 40.0)], "tid int, seq long, ts long, lon double, lat double")
    got = trajectories.segment_cells(p, 8).collect()
    one_ = sorted((r.ts, r.cell) for r in got if r.tid == 1)
    assert len(one_) >= 3 and one_ == sorted(one_) and one_[0][0] == 0 and one_[-1][0] == 1000 and len({c for _, c in one_}) == len(one_)
    assert sum(r.tid == 2 for r in got) == 2
    assert trajectories.segment_cells(p, 8, most=1).count() == 4


def test_legacy_boxes_and_approximate_heat(spark):
    p = model.points(spark, DATA)
    a = {r.tid: r for r in trajectories.bounding_boxes(p, legacy=True).collect()}
    b = {r.tid: r for r in trajectories.bounding_boxes(p).collect()}
    assert a.keys() == b.keys() and all(b[t].min_y <= a[t].min_y and a[t].min_x == b[t].min_x for t in b)
    args = (116.0, 40.5, 117.0, 39.5, 4, 4)
    assert grid.heat_map(p, *args, approximate=True).count() == grid.heat_map(p, *args).count() == 16


def test_categories_without_places(spark):
    p = model.points(spark, DATA)
    v, c = index.visits(index.cell_points(p, 9)), pattern.poi_cells(model.poi(spark, DATA), 9)
    kinds = ["BUILDING", "nothing"]
    assert pattern.poi_search(v, c, kinds, [0, 10**9]).count() == 0
    assert pattern.poi_search(v, c, kinds, [0, 10**9], skip_empty=True).count() > 0
    assert strategy.by_selectivity(c, kinds) == ["nothing", "BUILDING"]
    assert selections.visiting(v, pattern.cells_of_type(c, "BUILDING")).count() > 0


ints = st.lists(st.integers(-50, 50), max_size=12)


@settings(max_examples=12, deadline=None)
@given(ints, ints)
def test_set_algebra(spark, a, b):
    x, y = (B.of(F.lit(v).cast("array<bigint>") if v else F.array().cast("array<bigint>")) for v in (a, b))
    s, t = set(a), set(b)
    got = one(spark, B.both(x, y), B.either(x, y), B.without(x, y), B.one_of(x, y), B.cardinality(x), B.is_subset(x, y), B.rank(x, F.lit(0)), B.flip(x, F.lit(-5).cast("long"), F.lit(5).cast("long")), B.is_subset(x, y, strict=True), B.lowest(x), B.highest(x), B.select(x, F.lit(1)))
    flipped = sorted(s ^ set(range(-5, 5)))
    want = [sorted(s & t), sorted(s | t), sorted(s - t), sorted(s ^ t), len(s), s <= t, sum(v <= 0 for v in s), flipped, s < t, min(s, default=None), max(s, default=None), sorted(s)[1] if len(s) > 1 else None]
    assert got == want


def test_random_and_normal(spark):
    r = spark.range(20_000).select(G.uniform(1).alias("u"), G.gaussian(2).alias("g"), G.cauchy(3).alias("c")).selectExpr("avg(u)", "avg(g)", "stddev(g)", "percentile(c, 0.5)").first()
    assert r[0] == pytest.approx(0.5, abs=0.02) and r[1] == pytest.approx(0, abs=0.03) and r[2] == pytest.approx(1, abs=0.03) and r[3] == pytest.approx(0, abs=0.05)
    assert one(spark, G.normal_cdf(F.lit(1.0))) == pytest.approx(0.8413, abs=0.003)
    assert one(spark, G.norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5.0


def test_pushdown_and_pruning(spark):
    plan = selections.by_id(model.points(spark, DATA), 7)._jdf.queryExecution().executedPlan().toString()
    assert "speed" not in plan.split("ReadSchema")[1] and "event_type" not in plan.split("ReadSchema")[1]


def test_log_stream(spark, tmp_path):
    from driftline.streaming.logs import read_log7_stream, visit_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("".join(f"{k},116.31,39.99,2014-01-01 08:0{k}:00.000,1,20,3\n" for k in range(5)))
    q = visit_counts(read_log7_stream(spark, f"{tmp_path}/in"), 11).writeStream.outputMode("complete").format("memory").queryName("visits_stream").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.cell, r.n, r.n_tids) for r in spark.table("visits_stream").collect()] == [(3886701861054447616, 5, 5)]


def test_polylines_and_polygons(spark):
    from driftline.functions import shapes as S

    line = S.loop([(116.0, 40.0), (116.0, 40.0), (116.5, 40.0), (117.0, 40.0)])
    m, p, c, n = one(spark, S.interpolate(line, F.lit(0.5)), S.project(line, F.lit(116.7), F.lit(40.2)), S.centroid(line), S.length(line))
    assert (m.x, m.y) == (pytest.approx(116.5), pytest.approx(40.0)) and (p.x, p.y, p.d) == (pytest.approx(116.7), 40.0, pytest.approx(0.2))
    assert c.x == pytest.approx(116.375) and n == pytest.approx(85276, rel=1e-3)
    ends = one(spark, S.interpolate(line, F.lit(0.0)), S.interpolate(line, F.lit(1.0)), S.interpolate(S.loop([(1, 2)]), F.lit(0.3)))
    assert [e.x for e in ends] == [pytest.approx(116.0), pytest.approx(117.0), 1.0]
    outer, hole = S.loop([(0, 0), (4, 0), (4, 4), (0, 4)]), S.loop([(1, 1), (1, 2), (2, 2), (2, 1)])
    assert one(spark, S.loop_area(outer), S.loop_area(hole)) == [16.0, -1.0]
    f = lambda x, y: S.polygon_holds([outer, hole], F.lit(float(x)), F.lit(float(y)))
    assert one(spark, f(3, 3), f(1.5, 1.5), f(5, 1), f(0.5, 0.5)) == [True, False, False, True]


def test_cell_union_is_normalised(spark):
    from driftline.functions import shapes as S

    top = 3886701861054447616
    bit = (top & -top) // 4
    kids = [top + d * bit for d in (-3, -1, 1, 3)]
    c = spark.createDataFrame([(k,) for k in [*kids, kids[0] + bit // 4, 3769449391312601088, 3769449391312601088]], "cell long")
    assert sorted(r.cell for r in S.normalised(c).collect()) == sorted([top, 3769449391312601088])


def test_ranks_split_equal_keys_and_stay_out_of_lambdas(spark):
    """A first key that all rows share is ranked by the rest, over several partitions; the cell is not computed again in any lambda."""
    d = spark.range(1000, numPartitions=5).select(F.lit(7).alias("x"), (F.col("id") * 37 % 1000).alias("y"))
    r = strategy.ranked(d, [F.col("x"), F.col("y")])
    assert {(v.y, v.rn) for v in r.collect()} == {(k, k + 1) for k in range(1000)}
    assert r.select(F.spark_partition_id()).distinct().count() > 1
    plan = index.leaves(index.cell_points(model.points(spark, DATA), 11).selectExpr("cell x", "ts y", "seq id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Window" not in plan
    assert "Window" not in index.point_quadtree(spark.range(9).selectExpr("id", "id / 9D x", "id / 9D y"), 2, 1)._jdf.queryExecution().optimizedPlan().toString()


def test_cells_by_table_equal_cells_by_fold(spark):
    rng = np.random.default_rng(9)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500))], "lat double, lon double")
    for level in (1, 5, 16, 30):
        assert C.with_cell(d, level).filter(F.col("cell") != C.encode(F.col("lat"), F.col("lon"), level)).isEmpty()


def test_coverings_and_unions(spark):
    """An interior covering lies in the covering; unions normalise to the top; intersection and difference part a union."""
    out, inner = (shapes.cover(spark, 116.0, 39.5, 116.5, 40.0, 9, inside=i) for i in (False, True))
    cells, within = ({r.cell for r in d.collect()} for d in (out, inner))
    assert within and within < cells
    whole = spark.createDataFrame([(C_FACE,)], "cell long")
    kids = whole.select(F.explode(F.sequence(C.child_begin(F.col("cell"), 3), C.child_end(F.col("cell"), 3) - 1, F.lit(2 << 54))).alias("cell"))
    assert kids.count() == 64 and [r.cell for r in shapes.normalised(kids.union(whole)).collect()] == [C_FACE] == [r.cell for r in shapes.normalised(kids).collect()]
    some = kids.filter("cell % 3 = 0")
    both, rest = shapes.union_intersection(whole, some), shapes.union_difference(whole, some, 3)
    assert both.count() == some.count() and both.count() + rest.count() == 64 and both.join(rest, "cell").isEmpty()


C_FACE = (1 << 61) | (1 << 60)
