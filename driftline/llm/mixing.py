"""Mixing sources to target weights: floor(rate) copies of each document and one more by a hash-seeded Bernoulli draw.

Defined results: a null source is a source of its own, last in order; a null text has size 0; a source whose documents have no
words has target 0 and takes nothing; rows that share a doc_id draw alike, equal rows too; very long texts count whole; extra columns
are kept, but for those that ``with_copies`` replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.strategy import small
from .runtime import WORD_RE, materialise, n_words, packed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Resharing an excess by weight until none is above its ceiling ends where ``target = min(ceiling * size, weight * level)``.
    Sources in order of ``ceiling * size / weight`` reach their ceilings first, so the level follows from running sums. The
    window holds one row for each source, never documents.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * ceiling)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * share - F.col("before")) / F.col("open_w"))
    # The first source whose ceiling is above the level there sets the level for it and all after it.
    level = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"]
    return s.withColumn("at", level).select(
        "source", "source_size",
        F.when(F.col("at").isNull() | (F.col("cap") <= F.col("w") * F.col("at")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("at")).alias("target"),
    )


def unit_draw(doc_id: Column, seed: str = "mix") -> Column:
    """In [0, 1), from the first 52 bits of an MD5, so that any engine can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


OWN = ("mix_source", "mix_source_size", "mix_target", "mix_copies")


def with_copies(docs: DataFrame, **rule) -> DataFrame:
    """docs, which must have mix_size, with mix_source_size, mix_target, mix_copies: how often the mix takes each row. Columns of docs
    with these names are replaced.

    Sources' sums are combined on the map side and written, a row a source; documents meet them by broadcast if a count says that
    they are few, so a source with a third of all rows does not come together anywhere."""
    docs = docs.drop(*OWN)
    per = source_targets(docs.groupBy("source").agg(F.sum("mix_size").alias("source_size")), **rule)
    per = materialise(per.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), "targets")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(unit_draw(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return docs.join(small(per), F.col("source").eqNullSafe(F.col("mix_source")), "left").withColumn("mix_copies", copies.cast("int")).drop("mix_source")


def mixed(docs: DataFrame, **rule) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    rows = packed(docs, "doc_id", "source", n_words(F.col("text")).alias("mix_size"))
    out = with_copies(rows, **rule).filter("mix_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Sizes are counted once; what is joined and drawn has no texts.
    out = with_copies(materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("mix_size")), "op9"))
    return out.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def copies_sql(docs: str) -> str:
    """A SELECT of docs.*, size, source_size, target, copies over the relation named."""
    return f"""
SELECT d.*, p.source_size, p.target,
       CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size)
         + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0
              < p.target / p.source_size - floor(p.target / p.source_size) THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies
FROM (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS BIGINT) AS size FROM {docs}) d
JOIN (WITH s AS (SELECT source, CAST(sum(CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS BIGINT)) AS BIGINT) AS source_size FROM {docs} GROUP BY source),
  w AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w FROM s),
  c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, sum(source_size) OVER () AS total FROM w),
  l AS (SELECT *, (total * 1.5::DOUBLE - before::DOUBLE) / open_w AS level FROM c),
  a AS (SELECT *, (SELECT level FROM l x WHERE x.cap > x.w * x.level ORDER BY x.cap / x.w, x.level LIMIT 1) AS lvl FROM l)
  SELECT source, source_size, CASE WHEN lvl IS NULL OR cap <= w * lvl THEN cap::DOUBLE ELSE w * lvl END AS target FROM a) p
ON d.source IS NOT DISTINCT FROM p.source"""


SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({copies_sql('documents')})"
