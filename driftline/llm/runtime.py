"""Words, packed rows and materialised tables of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, new_path, partitions, shared_dir

__all__ = ["GROUP_BYTES", "LOWER", "SPACE", "SPACE_RE", "UPPER", "WORD_RE", "groups_for", "materialise", "n_words", "new_path", "packed", "partitions", "shared_dir"]

#: The separators of words and the characters stripped from lines: space and x09 to x0D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def packed(docs: DataFrame, *beside: Column | str) -> DataFrame:
    """(row, ...): all columns of docs in one struct, so that no name can clash with those an operator adds."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *beside)


def n_words(c: Column) -> Column:
    """Maximal runs of non-space; null and blank texts have none.

    Every character but the six separators becomes one of two kinds, so no array of words is built."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))
    squeezed = F.regexp_replace(t, SPACE_RE, "\n")
    return F.when(t == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit("\n"), F.lit(""))) + 1).cast("long")


#: Input that one group of an operator with packed groups stands for; a Python task holds one group at a time.
GROUP_BYTES = 64 << 20


def groups_for(df: DataFrame) -> int:
    """How many hash groups packed rows are dealt to: four a shuffle partition, and so many more that a group's share of the input is bounded."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    held = size if size < 1 << 60 else 0  # unknown sizes are reported as the largest long
    return max(4 * partitions(df.sparkSession), -(-held // GROUP_BYTES))
