"""Decisions that the optimizer does not take: order of categories, checked broadcasts, global ranks without one big partition."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, partitions

#: Rows of a side up to which it is broadcast; beyond, the join is left to the optimizer.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a bounded count says that it is small. The count runs df up to that many rows, so df should be a
    pruned side or a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_selectivity(cells: DataFrame, types: Sequence[str]) -> list[str]:
    """Categories from the fewest cells on; one row for each category comes to the driver."""
    n = {r["type"]: r["n"] for r in cells.filter(F.col("type").isin(*types)).groupBy("type").agg(F.countDistinct("cell").alias("n")).collect()}
    return sorted(types, key=lambda t: (n.get(t, 0), t))


def ranked(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """df with ``name``, the rank from 1 by ``order``: a range exchange by all of ``order``, so that equal first keys split too, a sort
    inside partitions, and the rows before each partition. The ranks inside partitions are written once with the rows: what is
    read again is one attempt of each task, and the expressions of df are not computed for a count and again for the result.

    The partitions' counts, one row a partition, come to the driver and go out with the plan."""
    spark = df.sparkSession
    row = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    keys = [F.col(f"_k{i}") for i in range(len(order))]
    dealt = row.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    held = materialise(dealt.select("row", F.monotonically_increasing_id().alias("_at")), "ranked")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    at, starts = 0, []
    for k, n in sorted((r["k"], r["n"]) for r in held.groupBy(part.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((k, at))
        at += n
    table = spark.createDataFrame(pa.table({"_part": pa.array([k for k, _ in starts], pa.int64()), "_start": pa.array([n for _, n in starts], pa.int64())}))
    return held.join(F.broadcast(table), part == F.col("_part")).select("row.*", (F.col("_start") + inside + 1).alias(name))
