"""The flagship and the category queries meet every place of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline import model, queries
from driftline.operators import index

from .conftest import DATA


def test_flagship_meets_every_place(spark):
    visits = {}
    for r in index.visits(index.cell_points(model.points(spark, DATA), queries.FINE)).collect():
        visits.setdefault(r.tid, {})[r.cell] = r.first_ts
    places = index.with_cells(model.poi(spark, DATA).filter(F.col("type").isin(*queries.TYPES)), queries.FINE).orderBy("seq").collect()
    want = {}
    for tid, seen in visits.items():
        first = {}
        for p in places:
            if p.cell in seen:
                first.setdefault(p.type, seen[p.cell])
        if len(first) == 3 and max(first.values()) - min(first.values()) < queries.SPAN:
            want[tid] = max(first.values()) - min(first.values())
    assert {r.tid: r.span for r in queries.flagship(spark, DATA).collect()} == want
    assert want and len(want) < len(visits)
