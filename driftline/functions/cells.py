"""Cell identifiers of a cube-projected sphere along a Hilbert curve, as column expressions.

A cell of level l is face (3 bits), l pairs of curve bits, a one, zeros. A fold over the levels carries the curve position and
the orientation, so an expression of any level is one aggregate; nothing leaves the JVM. Levels up to 30; identifiers of faces 4
and 5 are negative as longs, see ``unsigned``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Hilbert curve's quarter at (orientation, i, j), the (i, j) at (orientation, quarter), and the turn of each quarter. Fixed values.
IJ_TO_POS = [0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0]
POS_TO_IJ = [0, 1, 3, 2, 0, 2, 3, 1, 3, 2, 0, 1, 3, 1, 0, 2]
TURN = [1, 0, 0, 3]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _at(values: list[int], index: Column) -> Column:
    """One expression text: a call for each value would take longer to plan than the query to run."""
    return F.element_at(F.expr(f"array({','.join(map(str, values))})"), (index + 1).cast("int"))


def _st(u: Column) -> Column:
    return F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * u)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * u))


def _uv(s: Column) -> Column:
    return F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)


def face_st(lat: Column, lon: Column) -> Column:
    """struct(face, s, t) of a point in degrees."""
    p, a = F.radians(lat), F.radians(lon)
    xyz = F.struct((F.cos(p) * F.cos(a)).alias("x"), (F.cos(p) * F.sin(a)).alias("y"), F.sin(p).alias("z"))

    def project(v: Column) -> Column:
        x, y, z = v["x"], v["y"], v["z"]
        ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
        face = (
            F.when((ax >= ay) & (ax >= az), F.when(x < 0, 3).otherwise(0))
            .when(ay >= az, F.when(y < 0, 4).otherwise(1)).otherwise(F.when(z < 0, 5).otherwise(2))
        )
        return let(face, lambda f: F.struct(
            f.cast("long").alias("face"),
            _st(F.when(f == 0, y / x).when(f == 1, -x / y).when(f == 2, -x / z).when(f == 3, z / x).when(f == 4, z / y).otherwise(-y / z)).alias("s"),
            _st(F.when(f == 0, z / x).when(f == 1, z / y).when(f == 2, -y / z).when(f == 3, y / x).when(f == 4, -x / y).otherwise(-x / z)).alias("t"),
        ))

    return let(xyz, project)


def _bit(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k).bitwiseAND(F.lit(1))


def from_face_ij(face: Column, i: Column, j: Column, level: int) -> Column:
    """The cell of ``level`` in row and column (i, j) of 2^level of a face."""
    step = lambda st, k: let(
        _at(IJ_TO_POS, st["o"] * 4 + _bit(i, k) * 2 + _bit(j, k)),
        lambda p: F.struct((st["pos"] * 4 + p).alias("pos"), st["o"].bitwiseXOR(_at(TURN, p)).cast("long").alias("o")),
    )
    start = F.struct(F.lit(0).cast("long").alias("pos"), face.bitwiseAND(F.lit(1)).cast("long").alias("o"))
    if level:
        pos = _fold(F.sequence(F.lit(level - 1), F.lit(0), F.lit(-1)), start, step)["pos"]
    else:
        pos = F.lit(0).cast("long")
    return F.shiftleft(face, 61).bitwiseOR(F.shiftleft(pos, 61 - 2 * level)).bitwiseOR(F.lit(1 << (60 - 2 * level)))


def _fold(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, start, step)


def encode(lat: Column, lon: Column, level: int) -> Column:
    """FN-15: the cell of ``level`` that holds a point."""
    n = 1 << level
    place = lambda s: F.least(F.greatest(F.floor(s * n), F.lit(0)), F.lit(n - 1)).cast("long")
    return let(
        let(face_st(lat, lon), lambda f: F.struct(f["face"].alias("face"), place(f["s"]).alias("i"), place(f["t"]).alias("j"))),
        lambda c: from_face_ij(c["face"], c["i"], c["j"], level),
    )


#: Levels that one table of ``with_cell`` covers.
_STEP = 4


@cache
def _step_table(bits: int) -> list[int]:
    """By (i bits, j bits, orientation): the curve position of these bits and the orientation behind them, made from the tables above."""
    out = []
    for key in range(1 << (2 * bits + 2)):
        i, j, o = key >> (bits + 2), (key >> 2) & ((1 << bits) - 1), key & 3
        pos = 0
        for k in range(bits - 1, -1, -1):
            q = IJ_TO_POS[o * 4 + ((i >> k) & 1) * 2 + ((j >> k) & 1)]
            pos, o = pos * 4 + q, o ^ TURN[q]
        out.append(pos << 2 | o)
    return out


def with_cell(df: DataFrame, level: int, lat: str = "lat", lon: str = "lon", out: str = "cell") -> DataFrame:
    """df with ``encode`` of its columns, by projections that each hold one step: nothing is computed twice, and all of it is generated
    code. Curve bits come four levels at once from tables. Null coordinates give the cell 0; filter them before."""
    p, a = F.radians(lat), F.radians(lon)
    keep = [c for c in df.columns if c != out]
    d = df.select(*keep, (F.cos(p) * F.cos(a)).alias("_x"), (F.cos(p) * F.sin(a)).alias("_y"), F.sin(p).alias("_z"))
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    face = F.when((ax >= ay) & (ax >= az), F.when(x < 0, 3).otherwise(0)).when(ay >= az, F.when(y < 0, 4).otherwise(1)).otherwise(F.when(z < 0, 5).otherwise(2))
    d = d.select(*keep, "_x", "_y", "_z", face.cast("long").alias("_f"))
    f = F.col("_f")
    u = F.when(f == 0, y / x).when(f == 1, -x / y).when(f == 2, -x / z).when(f == 3, z / x).when(f == 4, z / y).otherwise(-y / z)
    v = F.when(f == 0, z / x).when(f == 1, z / y).when(f == 2, -y / z).when(f == 3, y / x).when(f == 4, -x / y).otherwise(-x / z)
    d = d.select(*keep, "_f", u.alias("_u"), v.alias("_v"))
    n = 1 << level
    place = lambda c: F.least(F.greatest(F.floor(_st(F.col(c)) * n), F.lit(0)), F.lit(n - 1)).cast("long")
    d = d.select(*keep, "_f", place("_u").alias("_i"), place("_v").alias("_j"))
    got, turn, left = F.shiftleft("_f", 61), F.col("_f").bitwiseAND(F.lit(1)), level
    while left:
        bits = min(_STEP, left)
        left -= bits
        part = lambda c: F.shiftright(F.col(c), left).bitwiseAND(F.lit((1 << bits) - 1))  # noqa: E731, B023
        key = F.shiftleft(part("_i"), bits + 2).bitwiseOR(F.shiftleft(part("_j"), 2)).bitwiseOR(turn)
        d = d.select("*", _at(_step_table(bits), key).cast("long").alias(f"_r{left}"))
        r = F.col(f"_r{left}")
        got, turn = got.bitwiseOR(F.shiftleft(F.shiftright(r, 2), 61 - 2 * level + 2 * left)), r.bitwiseAND(F.lit(3))
    # A generator is where the optimizer stops: a filter on the cell is not moved below, which would unfold all steps in it.
    return d.select(*keep, F.explode(F.array(F.coalesce(got.bitwiseOR(F.lit(1 << (60 - 2 * level))), F.lit(0).cast("long")))).alias(out))


def lsb(cell: Column) -> Column:
    return cell.bitwiseAND(-cell)


def level_of(cell: Column) -> Column:
    return (30 - (F.bit_count(lsb(cell) - 1) / 2)).cast("int")


def face_of(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 61)


def parent(cell: Column, level: int) -> Column:
    bit = 1 << (60 - 2 * level)
    return cell.bitwiseAND(F.lit(-bit)).bitwiseOR(F.lit(bit))


def next_cell(cell: Column) -> Column:
    """FN-19: the next cell of the same level along the curve."""
    return cell + 2 * lsb(cell)


def range_min(cell: Column) -> Column:
    return cell - (lsb(cell) - 1)


def range_max(cell: Column) -> Column:
    return cell + (lsb(cell) - 1)


def child_begin(cell: Column, level: int) -> Column:
    """FN-20."""
    return cell - lsb(cell) + F.lit(1 << (60 - 2 * level))


def child_end(cell: Column, level: int) -> Column:
    return cell + lsb(cell) + F.lit(1 << (60 - 2 * level))


def contains(outer: Column, inner: Column) -> Column:
    return inner.between(range_min(outer), range_max(outer))


def unsigned(cell: Column) -> Column:
    """A long that orders cells of all faces as unsigned identifiers."""
    return cell.bitwiseXOR(F.lit(-(2**63)))


def ij(cell: Column, level: int) -> Column:
    """struct(face, i, j) of a cell of a known level."""
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), face_of(cell).bitwiseAND(F.lit(1)).cast("long").alias("o"))

    def step(st: Column, k: Column) -> Column:
        p = F.call_function("shiftrightunsigned", cell, k * 2 + (61 - 2 * level)).bitwiseAND(F.lit(3))
        return let(p, lambda q: let(_at(POS_TO_IJ, st["o"] * 4 + q), lambda x: F.struct(
            (st["i"] * 2 + F.shiftright(x, 1)).cast("long").alias("i"), (st["j"] * 2 + x.bitwiseAND(F.lit(1))).cast("long").alias("j"),
            st["o"].bitwiseXOR(_at(TURN, q)).cast("long").alias("o"),
        )))

    if not level:
        return F.struct(face_of(cell).alias("face"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    return let(_fold(F.sequence(F.lit(level - 1), F.lit(0), F.lit(-1)), start, step), lambda r: F.struct(face_of(cell).alias("face"), r["i"].alias("i"), r["j"].alias("j")))


def at_st(face: Column, s: Column, t: Column) -> Column:
    """struct(lat, lon) in degrees of a place on a face."""
    def turn(v: Column) -> Column:
        u, w, one = v["u"], v["v"], F.lit(1.0)
        x = F.when(face == 0, one).when(face == 1, -u).when(face == 2, -u).when(face == 3, -one).when(face == 4, w).otherwise(w)
        y = F.when(face == 0, u).when(face == 1, one).when(face == 2, -w).when(face == 3, -w).when(face == 4, -one).otherwise(u)
        z = F.when(face == 0, w).when(face == 1, w).when(face == 2, one).when(face == 3, -u).when(face == 4, -u).otherwise(-one)
        return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda p: F.struct(
            F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"),
        ))

    return let(F.struct(_uv(s).alias("u"), _uv(t).alias("v")), turn)


def center(cell: Column, level: int) -> Column:
    """FN-16: struct(lat, lon) of the middle of a cell of a known level."""
    n = float(1 << level)
    return let(ij(cell, level), lambda c: at_st(c["face"], (c["i"] + 0.5) / n, (c["j"] + 0.5) / n))


def center_st(cell: Column, level: int) -> Column:
    """FN-17: struct(s, t); a cell's side is ``size_st(level)``."""
    n = float(1 << level)
    return let(ij(cell, level), lambda c: F.struct(((c["i"] + 0.5) / n).alias("s"), ((c["j"] + 0.5) / n).alias("t")))


def size_st(level: int) -> float:
    return math.ldexp(1.0, -level)


def rect_of(cell: Column, level: int) -> Column:
    """FN-18: struct(min_lat, max_lat, min_lon, max_lon) of a cell's four corners."""
    n = float(1 << level)
    corners = lambda c: F.array(*[at_st(c["face"], (c["i"] + a) / n, (c["j"] + b) / n) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return let(let(ij(cell, level), corners), lambda v: F.struct(
        F.array_min(v["lat"]).alias("min_lat"), F.array_max(v["lat"]).alias("max_lat"),
        F.array_min(v["lon"]).alias("min_lon"), F.array_max(v["lon"]).alias("max_lon"),
    ))


def edge_neighbors(cell: Column, level: int) -> Column:
    """GEO-1: up to four cells of the same level and face that share an edge (none across a face's border)."""
    n = 1 << level
    def around(c: Column) -> Column:
        sides = F.array(*[F.struct((c["i"] + a).alias("i"), (c["j"] + b).alias("j")) for a, b in ((0, -1), (1, 0), (0, 1), (-1, 0))])
        return F.transform(F.filter(sides, lambda x: x["i"].between(0, n - 1) & x["j"].between(0, n - 1)), lambda x: from_face_ij(c["face"], x["i"], x["j"], level))
    return let(ij(cell, level), around)


def token(cell: Column) -> Column:
    """Hexadecimal without trailing zeros."""
    return F.regexp_replace(F.lower(F.lpad(F.hex(cell), 16, "0")), "0+$", "")


# -- the same in SQL ------------------------------------------------------------------------------------------------------


def encode_sql(relation: str, level: int, lat: str = "lat", lon: str = "lon", out: str = "cell") -> str:
    """SELECT of all columns of the relation and ``out``."""
    n = 1 << level
    st = lambda u: f"CASE WHEN {u} >= 0 THEN 0.5::DOUBLE * sqrt(1 + 3 * {u}) ELSE 1 - 0.5::DOUBLE * sqrt(1 - 3 * {u}) END"
    q = f"SELECT *, cos(radians({lat})) * cos(radians({lon})) AS _x, cos(radians({lat})) * sin(radians({lon})) AS _y, sin(radians({lat})) AS _z FROM ({relation})"
    q = f"""SELECT *, CASE WHEN abs(_x) >= abs(_y) AND abs(_x) >= abs(_z) THEN CASE WHEN _x < 0 THEN 3 ELSE 0 END
      WHEN abs(_y) >= abs(_z) THEN CASE WHEN _y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN _z < 0 THEN 5 ELSE 2 END END::BIGINT AS _f FROM ({q})"""
    q = f"""SELECT *, CASE _f WHEN 0 THEN _y / _x WHEN 1 THEN -_x / _y WHEN 2 THEN -_x / _z WHEN 3 THEN _z / _x WHEN 4 THEN _z / _y ELSE -_y / _z END AS _u,
      CASE _f WHEN 0 THEN _z / _x WHEN 1 THEN _z / _y WHEN 2 THEN -_y / _z WHEN 3 THEN _y / _x WHEN 4 THEN -_x / _y ELSE -_x / _z END AS _v FROM ({q})"""
    q = f"SELECT *, least(greatest(floor(({st('_u')}) * {n}), 0), {n - 1})::BIGINT AS _i, least(greatest(floor(({st('_v')}) * {n}), 0), {n - 1})::BIGINT AS _j, 0::BIGINT AS _p, _f & 1 AS _o FROM ({q})"
    for k in range(level - 1, -1, -1):
        q = f"SELECT * EXCLUDE (_k), _k AS _q FROM (SELECT *, {IJ_TO_POS}[(_o * 4 + ((_i >> {k}) & 1) * 2 + ((_j >> {k}) & 1) + 1)::INT]::BIGINT AS _k FROM ({q}))"
        q = f"SELECT * REPLACE (_p * 4 + _q AS _p, xor(_o, {TURN}[(_q + 1)::INT]::BIGINT) AS _o) FROM ({q})"
        q = f"SELECT * EXCLUDE (_q) FROM ({q})"
    return f"SELECT * EXCLUDE (_x, _y, _z, _f, _u, _v, _i, _j, _p, _o), (_f << 61) | (_p << {61 - 2 * level}) | {1 << (60 - 2 * level)}::BIGINT AS {out} FROM ({q})"


def ij_sql(relation: str, level: int, cell: str = "cell") -> str:
    """SELECT of all columns of the relation and _f, _i, _j: face, row and column of a cell."""
    q = f"SELECT *, ({cell} >> 61) & 7 AS _f, 0::BIGINT AS _i, 0::BIGINT AS _j, ({cell} >> 61) & 1 AS _o FROM ({relation})"
    for k in range(level - 1, -1, -1):
        q = f"SELECT *, ({cell} >> {61 - 2 * level + 2 * k}) & 3 AS _q FROM ({q})"
        q = f"SELECT *, {POS_TO_IJ}[(_o * 4 + _q + 1)::INT]::BIGINT AS _r FROM ({q})"
        q = f"SELECT * EXCLUDE (_q, _r) REPLACE (_i * 2 + (_r >> 1) AS _i, _j * 2 + (_r & 1) AS _j, xor(_o, {TURN}[(_q + 1)::INT]::BIGINT) AS _o) FROM ({q})"
    return f"SELECT * EXCLUDE (_o) FROM ({q})"


def place_sql(relation: str, level: int, i: float, j: float, name: str) -> str:
    """SELECT of all columns of the relation (with _f, _i, _j) and name_lat, name_lon of the place (i, j) in the cell's square."""
    n = float(1 << level)
    uv = lambda s: f"CASE WHEN {s} >= 0.5 THEN (4 * {s} * {s} - 1) / 3 ELSE (1 - 4 * (1 - {s}) * (1 - {s})) / 3 END"
    q = f"SELECT *, (_i + {i}::DOUBLE) / {n}::DOUBLE AS _s, (_j + {j}::DOUBLE) / {n}::DOUBLE AS _t FROM ({relation})"
    q = f"SELECT *, {uv('_s')} AS _u, {uv('_t')} AS _v FROM ({q})"
    q = f"""SELECT *, CASE _f WHEN 0 THEN 1 WHEN 1 THEN -_u WHEN 2 THEN -_u WHEN 3 THEN -1 ELSE _v END::DOUBLE AS _x,
      CASE _f WHEN 0 THEN _u WHEN 1 THEN 1 WHEN 2 THEN -_v WHEN 3 THEN -_v WHEN 4 THEN -1 ELSE _u END::DOUBLE AS _y,
      CASE _f WHEN 0 THEN _v WHEN 1 THEN _v WHEN 2 THEN 1 WHEN 3 THEN -_u WHEN 4 THEN -_u ELSE -1 END::DOUBLE AS _z FROM ({q})"""
    return f"SELECT * EXCLUDE (_s, _t, _u, _v, _x, _y, _z), degrees(atan2(_z, sqrt(_x * _x + _y * _y))) AS {name}_lat, degrees(atan2(_y, _x)) AS {name}_lon FROM ({q})"


def center_sql(relation: str, level: int, cell: str = "cell") -> str:
    """SELECT of all columns of the relation and c_lat, c_lon."""
    return f"SELECT * EXCLUDE (_f, _i, _j) FROM ({place_sql(ij_sql(relation, level, cell), level, 0.5, 0.5, 'c')})"


def rect_sql(relation: str, level: int, cell: str = "cell") -> str:
    """SELECT of all columns of the relation, _f, _i, _j, c_lat, c_lon and min_lat, max_lat, min_lon, max_lon of the corners."""
    q = place_sql(ij_sql(relation, level, cell), level, 0.5, 0.5, "c")
    for k, (i, j) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))):
        q = place_sql(q, level, i, j, f"k{k}")
    many = lambda f, c: f"{f}({', '.join(f'k{k}_{c}' for k in range(4))})"
    return f"SELECT * EXCLUDE ({', '.join(f'k{k}_{c}' for k in range(4) for c in ('lat', 'lon'))}), {many('least', 'lat')} AS min_lat, {many('greatest', 'lat')} AS max_lat, {many('least', 'lon')} AS min_lon, {many('greatest', 'lon')} AS max_lon FROM ({q})"
