"""Index tables: visits, packed rectangle trees, quadtrees, and searches over them (IDX, QRY-1 to QRY-4).

An index here is a table: a tree level is a grouped min/max, a search prunes by the upper levels' rectangles and then tests exactly,
so its result equals a full scan's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..plans.storage import materialise
from ..plans.strategy import ranked, small

FANOUT = 4


def with_cells(points: DataFrame, level: int) -> DataFrame:
    """points with ``cell``; points without coordinates have none and are left out."""
    return C.with_cell(points.dropna(subset=["lat", "lon"]), level)


def cell_points(points: DataFrame, level: int) -> DataFrame:
    """(seq, tid, cell, ts)."""
    return with_cells(points, level).select("seq", "tid", "cell", "ts")


def visits(cell_points: DataFrame) -> DataFrame:
    """IDX-1/2/3, AGG-5: (tid, cell, first_ts); one shuffle, combined on the map side."""
    return cell_points.groupBy("tid", "cell").agg(F.min("ts").alias("first_ts"))


def cell_sets(cell_points: DataFrame) -> DataFrame:
    """AGG-6, AGG-13: (tid, cells, n)."""
    return cell_points.groupBy("tid").agg(F.array_sort(F.collect_set("cell")).alias("cells")).withColumn("n", F.size("cells").cast("long"))


def clustered(cell_points: DataFrame) -> DataFrame:
    """IDX-4: rows of a trajectory together and in order."""
    return cell_points.repartition("tid").sortWithinPartitions("tid", "ts", "seq")


# -- packed rectangle tree ------------------------------------------------------------------------------------------------


def assigned(points: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """IDX-5/6: points (x, y, id) with the leaf that holds each, packed by x, then y, id."""
    return ranked(points, [F.col("x"), F.col("y"), F.col("id")]).withColumn("node", F.floor((F.col("rn") - 1) / fanout)).drop("rn")


def leaves(points: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """IDX-5 to IDX-7: (node, min_x, max_x, min_y, max_y, n) of packed points."""
    return assigned(points, fanout).groupBy("node").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("n"))


def upper(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """IDX-8/10/11, AGG-4: the next level; node k holds nodes fanout * k on, ``n`` children."""
    return level.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.count(F.lit(1)).alias("n"),
    )


def tree(points: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All levels, 0 the leaves, until one has at most ``fanout`` nodes: (level, node, ...). The leaves are written once; each level
    is made from the one below, a quarter of its size, which is written as long as it is large."""
    now, level = materialise(leaves(points, fanout), "leaves"), 0
    out, count = now.withColumn("level", F.lit(0)), now.count()
    while count > fanout:
        now, count, level = upper(now, fanout), -(-count // fanout), level + 1
        if count > WRITE_LEVELS_FROM:
            now = materialise(now, "level")
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out.select("level", "node", "min_x", "max_x", "min_y", "max_y", "n")


#: Levels with more nodes are written before the next is made from them.
WRITE_LEVELS_FROM = 10_000


# -- addresses in a packed tree (IDX-15) ------------------------------------------------------------------------------------


def level_sizes(n: int, fanout: int = FANOUT) -> list[int]:
    """Nodes of each level over n points, the leaves first."""
    out = [-(-n // fanout)] if n else []
    while out and out[-1] > fanout:
        out.append(-(-out[-1] // fanout))
    return out


def level_offsets(n: int, fanout: int = FANOUT) -> list[int]:
    """Where each level starts in a list of all nodes, the top level first."""
    sizes = level_sizes(n, fanout)
    return [sum(sizes[k + 1 :]) for k in range(len(sizes))]


def parent_node(node, fanout: int = FANOUT):
    return F.floor(node / fanout)


def first_child(node, fanout: int = FANOUT):
    return node * fanout


#: Slots of rectangles up to this number are broadcast by a search.
BROADCAST_SLOTS = 20_000


def search(points: DataFrame, rects: DataFrame, fanout: int = FANOUT, slices: int = 4096, rows: int = 64) -> DataFrame:
    """QRY-1 to QRY-3, QRY-16: (rect, id) of points strictly inside; leaves that no rectangle overlaps are pruned.

    rects: (rect, min_x, max_x, min_y, max_y). The extent of x is cut into ``slices`` equal slices at most and that of y into ``rows``,
    as wide as the mean leaf and rectangle at least; a leaf and a rectangle that overlap share the slot where the later of their left
    and of their lower sides lie, so the join of their boxes has an equal key. Leaves carry their points: what meets is not moved again."""
    p = materialise(assigned(points, fanout), "assigned")
    sides = [F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("b"), F.max("y").alias("t")]
    boxes = materialise(p.groupBy("node").agg(*sides, F.collect_list(F.struct("x", "y", "id")).alias("held")).drop("node"), "boxes")
    ends = boxes.agg(F.min("l"), F.max("r"), F.min("b"), F.max("t"), F.avg(F.col("r").cast("double") - F.col("l")), F.avg(F.col("t").cast("double") - F.col("b"))).first()
    if any(x is None for x in ends):
        return rects.crossJoin(p.limit(0)).select("rect", "id")
    # Doubles may round either way, but equally on both sides; the exact test follows.
    low, high, bottom, top = map(float, ends[:4])
    inside = lambda c, a, b: F.least(F.greatest(c.cast("double"), F.lit(a)), F.lit(b))
    q = materialise(rects, "rects").filter(
        (F.col("min_x").cast("double") <= high) & (F.col("max_x").cast("double") >= low) & (F.col("min_x") <= F.col("max_x"))
        & (F.col("min_y").cast("double") <= top) & (F.col("max_y").cast("double") >= bottom) & (F.col("min_y") <= F.col("max_y"))
    )
    mean = q.agg(F.avg(inside(F.col("max_x"), low, high) - inside(F.col("min_x"), low, high)), F.avg(inside(F.col("max_y"), bottom, top) - inside(F.col("min_y"), bottom, top))).first()
    step = lambda a, b, most, *widths: max((b - a) / most, 1e-300, *[w for w in widths if w is not None])
    wide, tall = step(low, high, slices, ends[4], mean[0]), step(bottom, top, rows, ends[5], mean[1])
    at = lambda x: F.floor((inside(x, low, high) - low) / wide)
    up = lambda y: F.floor((inside(y, bottom, top) - bottom) / tall)
    spread = lambda d, l, r, b, t: d.withColumn("slice", F.explode(F.sequence(at(F.col(l)), at(F.col(r))))).withColumn("row", F.explode(F.sequence(up(F.col(b)), up(F.col(t)))))
    met = spread(boxes, "l", "r", "b", "t").join(small(spread(q, "min_x", "max_x", "min_y", "max_y"), BROADCAST_SLOTS), ["slice", "row"])
    hit = met.filter(
        (F.col("l") <= F.col("max_x")) & (F.col("r") >= F.col("min_x")) & (F.col("b") <= F.col("max_y")) & (F.col("t") >= F.col("min_y"))
        & (F.col("slice") == F.greatest(at(F.col("l")), at(F.col("min_x")))) & (F.col("row") == F.greatest(up(F.col("b")), up(F.col("min_y"))))
    )
    within = lambda v: (v["x"] > F.col("min_x")) & (v["x"] < F.col("max_x")) & (v["y"] > F.col("min_y")) & (v["y"] < F.col("max_y"))
    return hit.select("rect", F.explode(F.filter("held", within)).alias("v")).select("rect", "v.id")


def cells_near(visits_: DataFrame, cells: DataFrame, after: int, before: int, reach: int) -> DataFrame:
    """QRY-2: trajectories with a cell point within ``reach`` of one of the cells along the curve and inside the times.

    Stretches of the curve of length ``reach`` + 1 are equal keys: a cell goes to its own stretch and to both beside it."""
    near = F.explode(F.array(*[F.floor(F.col("c") / (reach + 1)) + k for k in (-1, 0, 1)]))
    c = small(cells.select(F.col("cell").alias("c")).distinct().withColumn("stretch", near))
    v = visits_.filter(F.col("ts").between(after, before)).withColumn("stretch", F.floor(F.col("cell") / (reach + 1)))
    return v.join(c, (v["stretch"] == c["stretch"]) & F.col("cell").between(F.col("c") - reach, F.col("c") + reach), "left_semi").select("tid").distinct()


def bitmap_visits(visits_: DataFrame, cells: DataFrame, after: int, before: int) -> DataFrame:
    """QRY-15: (tid, n_cells, first_ts) of trajectories that first met one of the cells inside the times (borders count)."""
    c = small(cells.select("cell").distinct())
    v = visits_.filter(F.col("first_ts").between(after, before)).join(c, "cell", "left_semi")
    return v.groupBy("tid").agg(F.count(F.lit(1)).alias("n_cells"), F.min("first_ts").alias("first_ts"))


def packed_boxes(boxes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """IDX-13, SRT-3: boxes (tid, ...) packed by min_x from the largest down: (tid, node)."""
    r = ranked(boxes, [-F.col("min_x"), F.col("tid")])
    return r.select("tid", F.floor((F.col("rn") - 1) / fanout).alias("node"))


# -- quadtrees ------------------------------------------------------------------------------------------------------------

#: Quarter numbers: top left, top right, bottom left, bottom right.


def _counted(now: DataFrame) -> DataFrame:
    """now with n, the rows at each path: counted by hash, with partial counts before the exchange, and met again by broadcast where
    the nodes are few. A window would bring all rows of a node, at first the whole table, to one task."""
    return now.join(small(now.groupBy(F.col("path").alias("_path")).agg(F.count(F.lit(1)).alias("n"))), F.col("path") == F.col("_path")).drop("_path")


def quadtree(boxes: DataFrame, root: tuple[float, float, float, float], depth: int = 3, least: int = 1) -> DataFrame:
    """IDX-16: (path, tid, min_x, ...) of every node at which a box ends: where ``depth`` is reached or ``least`` boxes or fewer
    are left. A box goes to each quarter that it reaches. Further columns of boxes are kept. root: min_x, min_y, max_x, max_y."""
    now = materialise(boxes.withColumns({"path": F.lit(""), "x0": F.lit(root[0]), "y0": F.lit(root[1]), "x1": F.lit(root[2]), "y1": F.lit(root[3])}), "quarters")
    keep = ["path", *boxes.columns]
    out = None
    for _ in range(depth):
        counted = _counted(now)
        done = counted.filter(F.col("n") <= least).select(*keep)
        out = done if out is None else out.unionByName(done)
        cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        left, right, top, bottom = F.col("min_x") < cx, F.col("max_x") >= cx, F.col("max_y") >= cy, F.col("min_y") < cy
        quarter = [
            (left & top, F.col("x0"), cy, cx, F.col("y1")), (right & top, cx, cy, F.col("x1"), F.col("y1")),
            (left & bottom, F.col("x0"), F.col("y0"), cx, cy), (right & bottom, cx, F.col("y0"), F.col("x1"), cy),
        ]
        kids = F.array(*[F.struct(ok.alias("ok"), F.lit(str(k)).alias("q"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")) for k, (ok, a, b, c, d) in enumerate(quarter)])
        now = materialise(counted.filter(F.col("n") > least).withColumn("kid", F.explode(F.filter(kids, lambda q: q["ok"]))).select(
            F.concat("path", "kid.q").alias("path"), *keep[1:], "kid.x0", "kid.y0", "kid.x1", "kid.y1",
        ), "quarters")
    return out.unionByName(now.select(*keep))


def quadtree_search(nodes: DataFrame, left: float, bottom: float, right: float, top: float, after: int | None = None, before: int | None = None) -> DataFrame:
    """QRY-4: trajectories whose box meets the rectangle (borders do not count); after, before: and whose times (min_ts, max_ts) meet theirs."""
    hit = nodes.filter((F.col("min_x") < right) & (F.col("max_x") > left) & (F.col("min_y") < top) & (F.col("max_y") > bottom))
    if after is not None:
        hit = hit.filter(F.col("max_ts") > after)
    if before is not None:
        hit = hit.filter(F.col("min_ts") < before)
    return hit.select("tid").distinct()


def point_quadtree(points: DataFrame, depth: int = 8, most: int = 16) -> DataFrame:
    """IDX-18: (id, path) of points (id, x, y) in the unit square: nodes split while they hold more than ``most`` points.

    A point's path to ``depth`` is known at once; the counts of its prefixes, an exchange of ``depth`` partial counts, tell where it ends."""
    side = 1 << depth
    bit = lambda c, k: F.shiftright(F.least(F.floor(F.col(c) * side), F.lit(side - 1)).cast("long"), depth - 1 - k).bitwiseAND(F.lit(1))
    digit = [F.when(bit("y", k) == 1, F.when(bit("x", k) == 1, "1").otherwise("0")).otherwise(F.when(bit("x", k) == 1, "3").otherwise("2")) for k in range(depth)]
    deep = materialise(points.select("id", F.concat(*digit, F.lit("")).alias("full")), "paths")
    prefix = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    leaf = deep.groupBy("full").agg(F.count(F.lit(1)).alias("m"))  # points of one deepest square go on as one row
    crowded = leaf.withColumn("l", prefix).groupBy(F.substring("full", F.lit(1), F.col("l")).alias("node"), "l").agg(F.sum("m").alias("n")).filter(F.col("n") > most)
    ends = leaf.select("full").withColumn("l", prefix).withColumn("node", F.substring("full", F.lit(1), F.col("l"))).join(crowded, ["node", "l"])
    # The nodes above a crowded one are crowded too, so their number is the depth at which a square's points end.
    length = ends.groupBy("full").agg(F.count(F.lit(1)).cast("int").alias("k"))
    return deep.join(length, "full", "left").select("id", F.substring("full", F.lit(1), F.coalesce("k", F.lit(0))).alias("path"))
