"""Schemas, and the moving-object tables derived from the driver's star schema.

``points``: one row for each event, ``seq`` is the arrival order. ``poi``: one row for each customer. ``catalog``: one row for
each order. Coordinates come from integers and one division, so every engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("tid", T.IntegerType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()),
    T.StructField("ts", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("speed", T.IntegerType()),
    T.StructField("dir", T.IntegerType()),
])
CELL_POINTS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("tid", T.IntegerType()), T.StructField("ts", T.LongType())])
POI = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("lon", T.FloatType()), T.StructField("lat", T.FloatType()),
])
CATALOG = T.StructType([T.StructField("file_id", T.DecimalType(20, 0)), T.StructField("path", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("int").alias("tid"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"),
        ((11600 + k).cast("double") / F.lit(100.0)).alias("lon"),
        ((39500 + F.round(F.col("value") * 100).cast("long") % 1000).cast("double") / F.lit(1000.0)).alias("lat"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("state"),
        k.alias("speed"), (F.col("event_id") % 8).cast("int").alias("dir"),
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"),
        ((11600 + (key * 37) % 100).cast("double") / F.lit(100.0)).alias("lon"),
        ((39500 + (key * 73) % 1000).cast("double") / F.lit(1000.0)).alias("lat"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.catalog import file_key

    date, tid = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), file_key(date, tid).alias("file_id"),
        F.concat(F.lit("/logs/"), date, F.lit("/"), tid, F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("path"),
    )


POINTS_SQL = """
SELECT event_id AS seq, CAST(user_id AS INTEGER) AS tid, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
       CAST(11600 + k AS DOUBLE) / 100.0::DOUBLE AS lon,
       CAST(39500 + CAST(round(value * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS lat,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS state, k AS speed, CAST(event_id % 8 AS INTEGER) AS dir
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

POI_SQL = """
SELECT c_custkey AS seq, c_name AS name, c_mktsegment AS type,
       CAST(11600 + (c_custkey * 37) % 100 AS DOUBLE) / 100.0::DOUBLE AS lon,
       CAST(39500 + (c_custkey * 73) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS lat
FROM customer"""


def djb2_sql(text: str) -> str:
    return f"list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 33 + c) % 18446744073709551616::HUGEINT)"


_DATE = "strftime(o_orderdate, '%Y%m%d')"
CATALOG_SQL = f"""
SELECT o_orderkey AS seq, {djb2_sql(f"{_DATE} || CAST(o_custkey AS VARCHAR)")} AS file_id,
       '/logs/' || {_DATE} || '/' || o_custkey || '-' || o_orderkey || '.csv' AS path FROM orders"""
