"""File catalogue: a key made from date and trajectory, and the path of its file (CAT-1 to CAT-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CATALOG

_LOW = 0xFFFFFFFF


def djb2(text: Column) -> Column:
    """CAT-1: h = 33 h + code from 5381, modulo 2^64, as decimal(20,0); two halves of 32 bits, so that nothing overflows a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(5381).cast("long").alias("l"))

    def step(s: Column, c: Column) -> Column:
        low = s["l"] * 33 + c
        return F.struct((s["h"] * 33 + F.shiftright(low, 32)).bitwiseAND(F.lit(_LOW)).alias("h"), low.bitwiseAND(F.lit(_LOW)).alias("l"))

    whole = lambda s: (s["h"].cast("decimal(10,0)") * F.lit(2**32).cast("decimal(10,0)") + s["l"].cast("decimal(10,0)")).cast("decimal(20,0)")
    return F.aggregate(codes, start, step, whole)


def file_key(date: Column, tid: Column) -> Column:
    """CAT-2."""
    return djb2(F.concat(date, tid))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: key,path lines; lines that are neither are dropped."""
    return spark.read.schema(CATALOG).csv(path).filter("file_id IS NOT NULL AND path IS NOT NULL")


def earliest(catalog: DataFrame) -> DataFrame:
    """CAT-4: of equal keys the first inserted (smallest seq) counts."""
    return catalog.groupBy("file_id").agg(F.min_by("path", "seq").alias("path"), F.min("seq").alias("seq"))


def lookup(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """CAT-3, CAT-6, JN-1: wanted (file_id, ...) with its path; unknown keys are left out, ``unmatched`` tells them."""
    return wanted.join(earliest(catalog).drop("seq"), "file_id")


def unmatched(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(catalog, "file_id", "left_anti")


def insert(catalog: DataFrame, more: DataFrame) -> DataFrame:
    """CAT-4: appended behind what is there."""
    last = catalog.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return catalog.unionByName(more.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last")).drop("last"))


def delete(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """CAT-5."""
    return catalog.join(keys, "file_id", "left_anti")


def slot(key: Column, size: int) -> Column:
    """CAT-7."""
    return F.pmod(key, F.lit(size))
