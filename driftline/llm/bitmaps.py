"""Sets of 64-bit hashes as small bitmaps in the plan, and rows that are told by their ids without moving their texts."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, packed

#: A bitmap's bits, as powers of two. The largest is 128 KB, and is one constant of the plan; with more entries than it has room for it
#: lets more rows pass and loses none.
LEAST_BITS, MOST_BITS = 16, 20
#: Ids up to this number are broadcast, 8 bytes each.
BROADCAST_IDS = 500_000


def _places(h: Column, size: int) -> tuple[Column, Column]:
    """Two places of a 64-bit hash in a bitmap of a power of two bits, from different bits of it."""
    return h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1))


def constant(bitmap: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(bitmap)), "array<bigint>")


def in_bitmap(words: Column, size: int, h: Column) -> Column:
    """Whether both bits of a 64-bit hash are set in a bitmap of ``size`` words."""

    def held(place: Column) -> Column:
        return F.call_function("shiftright", F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    one, two = _places(h, size * 64)
    return held(one) & held(two)


def bitmap_of(hashes: DataFrame, column: str, bits_each: int) -> list[int]:
    """Bits set by a table of hashes, as 64-bit words; an aggregate by word, so its size and no count of rows bounds what is collected."""
    entries = hashes.select(F.approx_count_distinct(column).alias("n")).first()["n"]
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(bits_each * max(entries, 1)))))
    place = hashes.select(F.explode(F.array(*_places(F.col(column), 1 << power))).alias("place"))
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    out = [0] * (1 << (power - 6))
    for r in place.groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(bits).alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return out


def may_hold(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is one of ids (one column, a written table) where these are few enough to be broadcast; else all rows."""
    if ids.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return docs
    own = ids.select(F.col(ids.columns[0]).alias("_wanted")).distinct()
    return docs.join(F.broadcast(own), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is one of ids (one column; null is like any other). Texts don't shuffle where the ids are few
    enough to be broadcast."""
    bad = materialise(ids.select(F.col(ids.columns[0]).alias("bad_id")).distinct(), "ids")
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return packed(docs, "doc_id").join(F.broadcast(bad) if few else bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
