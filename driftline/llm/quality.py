"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and a scaled identity; a score is the logistic of the
difference of the two log densities, from Mahalanobis distances by Cholesky factors that are computed once and sent with the
scoring function.

Training gathers counts, sums and sums of products of each class as whole numbers, which partial aggregation brings to one row a
class, so labels of any number are used whole and every run gives the same scores; nothing is sampled.

Defined results: a null or empty text has all statistics of an empty text and a score like any other; rows without a label, with
a null label or held out are not learned from; a doc_id with several rows or labels counts once for each; without learned rows
of both classes every score is the prior 0.5; extra columns are ignored or, in ``keep_good``, kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import BROADCAST_IDS
from .runtime import materialise

FEATURES = (
    "log_words", "log_word_len", "symbols", "upper", "digits", "bars", "marked_words", "stops", "commas", "distinct",
    "top_word", "repeat_trigrams", "log_line_len", "repeat_lines", "short_words", "sentence_len", "long_words", "letters",
)
_MARKED = re.compile(r"[#$%&*@^~!?]{2,}(?=[\s.,]|$)")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")


def _logit(p: float) -> float:
    """Shares, spread out near 0 and 1 by a bounded amount."""
    return math.log((p + 0.01) / (1.01 - p))


_SYMBOL_BYTES = np.frombuffer(b"#$%&*@^~<>{}[]\\/=+_|!", np.uint8)
_ASCII = re.compile(r"[\x00-\x7f]+")


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; shares as logits and sizes as logarithms, which are nearer to normal."""
    t = text or ""
    n = max(len(t), 1)
    # Characters are counted by byte value; only those beyond ASCII are looked at one by one.
    by = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    wide = "" if t.isascii() else _ASCII.sub("", t)
    w = t.split()
    k = max(len(w), 1)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    low = t.lower().split()
    counts = Counter(low)
    lines = [x for x in t.split("\n") if x]
    grams = max(len(low) - 2, 1)
    distinct_grams = grams
    if len(low) > 2:
        number = {x: i for i, x in enumerate(counts)}
        code = np.fromiter(map(number.__getitem__, low), np.int64, len(low))
        m = len(number)
        if m < 2_000_000:
            distinct_grams = len(np.unique((code[:-2] * m + code[1:-1]) * m + code[2:]))
        else:  # the product of three would not fit
            distinct_grams = len(set(zip(low, low[1:], low[2:])))
    letters = int(by[65:91].sum() + by[97:123].sum()) + sum(map(str.isalpha, wide))
    upper = int(by[65:91].sum()) + sum(map(str.isupper, wide))
    digits = int(by[48:58].sum()) + sum(map(str.isdigit, wide))
    sentences = len(_SENTENCE.findall(t))
    return [
        math.log1p(len(w)),
        math.log1p(int(sizes.sum()) / k),
        _logit(min(1.0, int(by[_SYMBOL_BYTES].sum()) / n)),
        _logit(upper / n),
        _logit(digits / n),
        _logit(min(1.0, int(by[124]) / k)),
        _logit(min(1.0, len(_MARKED.findall(t)) / k)),
        _logit(min(1.0, sentences / k)),
        _logit(min(1.0, int(by[44]) / k)),
        _logit(len(counts) / k),
        _logit(max(counts.values(), default=0) / k),
        _logit(1 - distinct_grams / grams),
        math.log1p(n / max(len(lines), 1)),
        _logit(1 - len(set(lines)) / max(len(lines), 1)),
        _logit(int((sizes <= 3).sum()) / k),
        math.log1p(len(w) / max(sentences, 1)),
        _logit(int((sizes >= 12).sum()) / k),
        _logit(letters / n),
    ]


#: Texts that are Python strings at once.
SLICE = 512


def matrix(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    rows = [features(t) for k in range(0, len(texts), SLICE) for t in texts.slice(k, SLICE).to_pylist()]
    return np.array(rows, np.float64).reshape(len(texts), len(FEATURES))


def _stats(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        x = matrix(part.column("text"))
        at = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
        yield pa.record_batch([part.column("row"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["row", "x"])


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept and x, an array of FEATURES."""
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "text")
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_stats, f"row {kind}, x array<double>").select("row.*", "x")


def held_out(doc_id) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


class Discriminant:
    def __init__(self, mean: dict[int, np.ndarray], cov: dict[int, np.ndarray], prior: dict[int, float], shrink: float, temper: float) -> None:
        d = len(FEATURES)
        self.temper = temper
        pooled = sum(prior[k] * cov[k] for k in cov)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.parts = {}
        for k in cov:
            s = cov[k] / np.outer(self.scale, self.scale)
            p = pooled / np.outer(self.scale, self.scale)
            c = (1 - shrink) * s + shrink * (0.5 * p + 0.5 * np.eye(d))
            low = np.linalg.cholesky(c)
            # The inverse factor turns a distance into one product; cached with the model.
            self.parts[k] = (mean[k] / self.scale, np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), math.log(prior[k]))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x / self.scale
        log = {k: -0.5 * ((((z - m) @ inv.T) ** 2).sum(1) + det) + pr for k, (m, inv, det, pr) in self.parts.items()}
        gap = np.clip((log[1] - log[0]) * self.temper, -40, 40)
        return 1 / (1 + np.exp(-gap))


#: Statistics are learned in steps of this, as whole numbers: their sums are exact, so that order and retries change no digit.
STEP = 2.0**-16


def _moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n, sums) of each label in a batch, from x or from texts: sums of all statistics and of the products of all pairs."""
    d = len(FEATURES)
    upper = np.triu_indices(d)
    for part in parts:
        for k in range(0, part.num_rows, 10_000):  # products below 2^42, so that sums fit
            p = part.slice(k, 10_000)
            found = matrix(p.column("text")) if "text" in part.schema.names else p.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = np.rint(found / STEP).astype(np.int64)
            label = p.column("label").to_numpy(zero_copy_only=False)
            rows = [(v, x[label == v]) for v in (0, 1)]
            rows = [(v, len(own), [*own.sum(0).tolist(), *(own.T @ own)[upper].tolist()]) for v, own in rows if len(own)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["label", "n", "sums"])


def fit(labelled: DataFrame, shrink: float = 0.1, temper: float = 0.5) -> Discriminant | None:
    """From (x, label) or (text, label). Two rows, one a class, come to the driver."""
    d = len(FEATURES)
    n_sums = d + d * (d + 1) // 2
    known = labelled.filter(F.col("label").isin(0, 1)).select(labelled.columns[0], F.col("label").cast("int").alias("label"))
    sums = known.mapInArrow(_moments, "label int, n long, sums array<bigint>").groupBy("label").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(28,0)")) for i in range(n_sums)]).alias("sums"),
    )
    rows = sums.collect()
    if {r["label"] for r in rows} != {0, 1}:
        return None
    mean, cov, total = {}, {}, sum(r["n"] for r in rows)
    for r in rows:
        n, v = r["n"], [int(x) for x in r["sums"]]
        c = np.zeros((d, d))
        for (i, j), p in zip(zip(*np.triu_indices(d)), v[d:]):
            c[i, j] = c[j, i] = (n * p - v[i] * v[j]) / (n * n) * STEP * STEP  # whole numbers up to the division
        mean[r["label"]], cov[r["label"]] = np.array([x / n for x in v[:d]]) * STEP, c
    return Discriminant(mean, cov, {r["label"]: r["n"] / total for r in rows}, shrink, temper)


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns kept, held_out and score, for each row of docs. The statistics are computed once, in a table of numbers."""
    x = materialise(with_features(docs, keep), name)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    model = fit(x.filter(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_id")).select("x", "label"))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            xs = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(FEATURES))
            s = model.score(xs) if model else np.full(part.num_rows, 0.5)
            yield pa.record_batch([part.column("row"), pa.array(s)], names=["row", "score"])

    packed = x.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "x")
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(score, f"row {kind}, score double").select("row.*", "score").withColumn("held_out", held_out(F.col("doc_id")))


THRESHOLD = 0.3


def op5_quality(spark, sf_dir: str) -> DataFrame:
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"], "op5")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects. Texts don't shuffle: the row is scored where it is read."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).filter(F.col("label").isNotNull() & F.col("_id").isNotNull())
    # Only rows with a label are learned from. Where these are few, texts meet their labels by broadcast, and one Python function
    # makes statistics and sums; else statistics move and not texts.
    own = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    few = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    x = own if few else with_features(own, ["doc_id"])
    model = fit(x.join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("_id")).select("text" if few else "x", "label"))
    if model is None:
        return docs
    names = docs.columns

    def good(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(model.score(matrix(part.column("text"))) >= threshold))

    return docs.mapInArrow(good, docs.schema).select(*names)
