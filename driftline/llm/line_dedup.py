"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble by position.

Defined results: a null or empty text is one empty line and stays as ``''``; a repeated line inside one document counts that
document once; rows that share a doc_id are one document for the count but keep their own text; a null doc_id counts as one
document below all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import LOWER, SPACE, UPPER, materialise

_STRIP = SPACE.encode()
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).translate(_FOLD)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, pos, a, b): the 128-bit hash of each line of ``min_chars`` code points or more, and the hash t of its text.

    At 10^12 different lines a clash of 128 bits has odds near 10^-15."""

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 1000):
                p = part.slice(k, 1000)
                row, pos, a, b = [], [], [], []
                for i, text in enumerate(p.column("text").cast(pa.binary()).to_pylist()):
                    for j, line in enumerate((text or b"").split(b"\n")):
                        key = line_key(line)
                        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                            h = xxhash.xxh3_128_intdigest(key)
                            row.append(i)
                            pos.append(j)
                            a.append((h >> 64) - 2**63)
                            b.append((h & (2**64 - 1)) - 2**63)
                at = pa.array(row, pa.int64())
                yield pa.record_batch([p.column("doc_id").take(at), p.column("t").take(at), pa.array(pos, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "t", "pos", "a", "b"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(explode, "doc_id long, t long, pos int, a long, b long")


#: A line in 1 / HOT_SHARE of all pairs of line and document or more is hot. There are HOT_SHARE such lines at most, 32 bytes each.
HOT_SHARE = 20_000


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row.

    Texts are read once for the hashes and once to be reassembled; between, only hashes move. Counts are combined on the map
    side, so a line that a third of all documents hold is a row a task. Its keeper goes back to the lines by broadcast, as that of
    every hot line; all others meet theirs by shuffle, where no key has more than 1 / HOT_SHARE of the pairs. The positions to drop
    meet their text by doc_id and text hash."""
    lines = materialise(line_hashes(docs, min_chars), "lines").withColumn("known", F.coalesce("doc_id", F.lit(-(2**63))))
    seen = lines.groupBy("a", "b", "known").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("one").alias("n"), F.max("known").alias("keeper"))
    seen = materialise(seen.filter(F.col("n") >= min_docs), "repeated-lines")
    limit = max(min_docs, -(-(seen.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_SHARE))
    keepers = seen.select("a", "b", "keeper", (F.col("n") >= limit).alias("hot"))
    hot, rest = (keepers.filter(c).drop("hot") for c in (F.col("hot"), ~F.col("hot")))
    met = lines.join(F.broadcast(hot.withColumnRenamed("keeper", "hot_keeper")), ["a", "b"], "left")
    kept_apart = met.filter(F.col("hot_keeper").isNotNull()).select("known", "t", "pos", F.col("hot_keeper").alias("keeper"))
    others = met.filter(F.col("hot_keeper").isNull()).join(rest, ["a", "b"]).select("known", "t", "pos", "keeper")
    gone = kept_apart.unionByName(others).filter("known <> keeper").groupBy("known", "t").agg(F.collect_set("pos").alias("gone"))
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("known"), F.xxhash64("text").alias("t"))
    own = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(own, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return d.join(gone, ["known", "t"], "left").select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_TRIM}), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
