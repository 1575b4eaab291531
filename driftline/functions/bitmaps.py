"""Set algebra of bitmaps, kept as sorted arrays of distinct longs (BMP-1 to BMP-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def of(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def span(start: Column, end: Column, step: int = 1) -> Column:
    """start to end, end exclusive."""
    return F.when(end > start, F.sequence(start, end - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def add(a: Column, value: Column) -> Column:
    return F.array_sort(F.array_union(a, F.array(value)))


def remove(a: Column, value: Column) -> Column:
    return F.array_remove(a, value)


def contains(a: Column, value: Column) -> Column:
    return F.array_contains(a, value)


def cardinality(a: Column) -> Column:
    return F.size(a).cast("long")


def both(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def either(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def without(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def one_of(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def flip(a: Column, start: Column, end: Column) -> Column:
    """Membership of start to end (exclusive) is turned around."""
    return one_of(a, span(start, end))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(None)).otherwise(F.size(F.array_intersect(a, b)) / n)


def is_subset(a: Column, b: Column, strict: bool = False) -> Column:
    inside = F.size(F.array_except(a, b)) == 0
    return inside & (F.size(a) < F.size(b)) if strict else inside


def rank(a: Column, value: Column) -> Column:
    """How many elements are at most ``value``."""
    return F.size(F.filter(a, lambda e: e <= value)).cast("long")


def select(a: Column, k: Column) -> Column:
    """The element at place k from 0; null beyond."""
    return F.try_element_at(F.array_sort(a), (k + 1).cast("int"))


def lowest(a: Column) -> Column:
    return F.array_min(a)


def highest(a: Column) -> Column:
    return F.array_max(a)
