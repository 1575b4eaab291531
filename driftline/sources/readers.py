"""Readers of delimited logs (SRC-1 to SRC-20). All of them declare their schema, so nothing is inferred and columns are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..model import CELL_POINTS, POI, POINTS


def _raw(spark: SparkSession, path: str | list[str], names: list[str], sep: str = ",", header: bool = False, recursive: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE").csv(path)


def _typed(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    kinds = {"state": text.parse_int, "speed": text.parse_int, "dir": text.parse_int}
    cols = [
        text.parse_int(F.col("tid")).alias("tid"), text.parse_double(F.col("lon")).alias("lon"), text.parse_double(F.col("lat")).alias("lat"), F.col("ts"),
        *[(f(F.col(n)) if n in have else F.lit(None).cast("int")).alias(n) for n, f in kinds.items()],
    ]
    return df.select(*cols)


def read_log7(spark: SparkSession, path, **kw) -> DataFrame:
    """SRC-2, SRC-8: id, lon, lat, local time, state, speed, dir."""
    d = _raw(spark, path, ["tid", "lon", "lat", "time", "state", "speed", "dir"], **kw)
    return _typed(d.withColumn("ts", text.parse_local(F.col("time"))))


def read_log4(spark: SparkSession, path, **kw) -> DataFrame:
    """SRC-3, SRC-9: id, local time, lon, lat."""
    d = _raw(spark, path, ["tid", "time", "lon", "lat"], **kw)
    return _typed(d.withColumn("ts", text.parse_local(F.col("time"))))


def read_log_headed(spark: SparkSession, path, **kw) -> DataFrame:
    """SRC-7, SRC-10: a header line; skipped column, dd/MM/yyyy time, id, lon, lat, rest ignored."""
    d = _raw(spark, path, ["skipped", "time", "tid", "lon", "lat"], header=True, **kw)
    return _typed(d.withColumn("ts", text.parse_local_dmy(F.col("time"))))


def read_cell_points(spark: SparkSession, path, **kw) -> DataFrame:
    """SRC-4: cell, id, epoch seconds."""
    d = _raw(spark, path, ["cell", "tid", "ts"], **kw)
    return d.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CELL_POINTS])


def read_poi(spark: SparkSession, path, **kw) -> DataFrame:
    """SRC-11: name, type, lon, lat; other rows are dropped."""
    d = _raw(spark, path, ["name", "type", "lon", "lat"], **kw)
    typed = d.select(F.trim("name").alias("name"), F.trim("type").alias("type"), *[F.col(c).try_cast("float").alias(c) for c in ("lon", "lat")])
    return typed.dropna().to(POI)


def read_pipe_lines(spark: SparkSession, path, names: list[str], **kw) -> DataFrame:
    """SRC-18: a pipe-separated table as strings."""
    return _raw(spark, path, names, sep="|", **kw)


def load_by_ids(spark: SparkSession, catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """SRC-1: the logs of the wanted keys. Paths are metadata: as many as files asked for."""
    from .catalog import lookup

    paths = [r["path"] for r in lookup(catalog, wanted).select("path").distinct().toLocalIterator()]
    return read_log7(spark, paths) if paths else spark.createDataFrame([], POINTS)


def list_files(spark: SparkSession, folder: str, recursive: bool = True, glob: str = "*") -> DataFrame:
    """SRC-13 to SRC-15: (path, length) without reading any file."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob)
    return r.load(folder).select("path", "length")


def count_lines(spark: SparkSession, path) -> int:
    """SRC-16, SRC-19, AGG-10."""
    return spark.read.text(path).count()


def split_lines(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """SRC-17: fields by name from a column ``value``."""
    parts = text.split_fields(F.col("value"), sep)
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def random_points(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """SRC-20: n uniform points of the unit square."""
    return spark.range(n).select("id", F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))
