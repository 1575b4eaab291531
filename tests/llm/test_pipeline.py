"""The pipeline against its stages' meaning, and the guard of the entry module."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from driftline.llm import decontamination, mixing, ngram_join, quality, sharding
from tests.conftest import DATA

from . import common as K


def test_run_follows_the_stages(spark):
    """run() equals the stages applied one after the other, each held against brute force elsewhere."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.scored(docs, labels, ["doc_id"], "t").collect()}
    good = [(i, t) for i, t in rows.items() if scores[i] >= quality.THRESHOLD]
    _, comp = K.jaccard_components(good)
    one = {i: t for (i, t), c in zip(good, comp) if i == c}
    bad = {r.doc_id for r in decontamination.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    clean = {i: t for i, t in one.items() if i not in bad}
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert {r.doc_id for r in got} <= set(clean) and all(rows[r.doc_id] == r.text for r in got)
    sizes, source = Counter(), {r.doc_id: r.source for r in docs.collect()}
    words = {i: len(K.WORDS.findall(t or "")) for i, t in clean.items()}
    for i in clean:
        sizes[source[i]] += words[i]
    rate = {s: float(t) / sizes[s] if sizes[s] else 0.0 for s, t in K.mix_targets(sizes).items()}
    # The draw is a fixed hash, so how often each document is taken is known.
    unit = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 16**13
    copies = {i: int(rate[source[i]]) + (unit(i) < rate[source[i]] - int(rate[source[i]])) for i in clean}
    assert Counter(r.doc_id for r in got) == Counter({i: c for i, c in copies.items() if c})
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1


def test_stages_name_five_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing", "sharding"]
    assert all(m for m in (ngram_join, mixing, sharding))


def test_stages_take_odd_rows(spark, tmp_path):
    """Columns named as those that operators add are kept, but for shard and slot, which are the shards'."""
    odd = K.documents(spark).withColumns({"shard": F.lit("mine"), "slot": F.lit(5), "mix_target": F.lit(1.0), "bad_id": F.lit(9), "score": F.lit(0.1)})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, K.ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*[c for c in odd.columns if c not in ("shard", "slot")], "shard", "slot"]
    got = out.collect()
    assert got and all((r.mix_target, r.bad_id, r.score, r.known) == (1.0, 9, 0.1, "k") and r.shard in range(8) for r in got)
    assert not {2, 3, 15, 16, 17} & {r.doc_id for r in got}
    shards = Counter(r.shard for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in shards.items())
