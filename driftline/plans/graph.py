"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) from (a, b): the smallest node of each component, by alternating large and small stars.

    Each round halves the distance to the smallest node; the table of stars is written and read again, so lineage stays short.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def state() -> tuple:
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        return r["n"], r["x"]

    mark = state()
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialise(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").filter("u <> v").distinct(), name)
        if (then := state()) == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v")).distinct()
