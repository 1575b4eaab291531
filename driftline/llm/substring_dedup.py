"""Substring dedup: hash every run of consecutive sentences, join globally, remove sentences covered by a non-first repeated run.

A sentence ends behind one of ``. ! ? ; : ,`` and any quotes and symbols directly after it, followed by space; behind a full-width
or ideographic stop; or at a line's end. Clauses count, so that a passage pasted into the middle of a sentence still has sentences
of its own, and clauses of more than ``STRETCH`` words are cut where their own words say. So of each 50 words that stand in two
places (in equal lines), three sentences in a row with 20 words or more have both ends inside, whatever surrounds them.

The run of sentence i is the shortest one from i with at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words; words are
compared in lower case (A-Z) by hashes of 128 bits. Of equal runs the one with the smallest (doc_id, position) is first and stays; so does every sentence
that no other repeated run covers: the start of a passage before its first whole sentence, and its end behind its last run.

Each task settles repeats among its own runs in blocks, so one block sends at most one row for each hash: a passage that a third
of all documents hold is one row a block at its hash, not a hot group. The rows travel packed, in partitions of the hash.

Defined results: null, empty and short texts have no runs; equal rows (doc_id and text) are one document and are cut alike; rows
that share a doc_id with different texts are told apart by their texts' checksums; null doc_ids come first; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import groups_for, materialise
from .shingles import mix, words_of

MIN_SENTENCES, MIN_WORDS = 3, 20
BLOCK_RUNS = 1_000_000
#: Every stretch of so many words that no clause end divides is cut; with 12, each 50 equal words hold three equal pieces of 20 words together.
STRETCH = 12
_END = re.compile(
    r"(?<![.!?;:,])[.!?;:,]++[^\w\x20\x09-\x0D]*+(?=[\x20\x09-\x0D])[\x20\x09-\x0D]*+|[\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61]++[^\w\x20\x09-\x0D]*+[\x20\x09-\x0D]*+|[\n\r]+[\x20\x09-\x0D]*"
)
_NULL = -(2**63)


#: Stops that need no space behind them, so that they end words too.
_WIDE = re.compile(r"[\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61]++[^\w\x20\x09-\x0D]*+")


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first characters) of words, none of which reaches over a wide stop."""
    if text.isascii() or not (at := [m.end() for m in _WIDE.finditer(text)]):
        return words_of(text)
    parts = [(a, *words_of(text[a:b])) for a, b in zip([0, *at], [*at, len(text)])]
    return np.concatenate([h for _, h, _ in parts]), np.concatenate([first + a for a, _, first in parts])


def _cuts(text: str, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where sentences start, in characters, the first at 0; h and first are the words of the text.

    Clause ends, and in clauses of more than STRETCH words those words that have the least hash of some STRETCH words in a row, the
    clause's first word aside: its words alone decide, so copies are cut alike whatever stands around them."""
    ends = np.fromiter((m.end() for m in _END.finditer(text)), np.int64)
    n = len(h)
    if n > STRETCH:
        clause = np.searchsorted(ends, first, side="right")
        inner = np.concatenate([[False], clause[1:] == clause[:-1]])  # not the first word of its clause
        least = h
        for step in (1, 2, 4, STRETCH - 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.where(inner[: len(least)] & (clause[: len(least)] == clause[STRETCH - 1 :]), least, np.uint64(0))
        pad = np.zeros(STRETCH - 1, np.uint64)
        most = np.concatenate([pad, least, pad])
        for step in (1, 2, 4, STRETCH - 8):
            most = np.maximum(most[:-step], most[step:])
        ends = np.concatenate([ends, first[inner & (most == h)]])
    # Blank pieces belong to the one before; a start without words behind it is none.
    at = np.searchsorted(first, np.unique(ends))
    at = np.unique(at[at < n])
    return np.concatenate([[0], first[at[at > 0]]])


def sentences(text: str) -> list[tuple[int, int]]:
    """(from, to) in characters, which together are the whole text; a text of blanks is one."""
    cuts = _cuts(text, *_words(text)).tolist()
    return list(zip(cuts, [*cuts[1:], len(text)])) if text else []


def runs(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(both halves of a 128-bit hash, first sentence, last sentence + 1) of every run."""
    words, first = _words(text)
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(words) < min_words:
        return none
    cuts = _cuts(text, words, first)
    if len(cuts) < min_sentences:
        return none
    edge = np.concatenate([np.searchsorted(first, cuts), [len(words)]])
    edge[0] = 0
    last = np.maximum(np.searchsorted(edge, edge[:-1] + min_words), np.arange(len(cuts)) + min_sentences)
    ok = np.flatnonzero(last <= len(cuts))
    if not len(ok):
        return none
    # The hash of a word sequence as a difference of prefix sums, undone by the inverse power at its start; two of them from words mixed apart.
    n = len(words)
    power, inverse = _powers(n)
    length = (edge[last[ok]] - edge[ok]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for ws in (words, mix(words ^ np.uint64(0xD1B54A32D192ED03))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(ws * power[:n], dtype=np.uint64)])
        out.append(mix(((total[edge[last[ok]]] - total[edge[ok]]) * inverse[np.minimum(edge[ok], n - 1)]) ^ length))
    return *out, ok, last[ok]


_made: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_made[0]) <= n:
        size = 1 << int(n).bit_length()
        p = 0x9E3779B97F4A7C15 | 1
        q = pow(p, -1, 2**64)
        for k, base in enumerate((p, q)):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            _made[k] = np.cumprod(x, dtype=np.uint64)
    return _made


def _settle(h, g, doc, crc, pos, end):
    """Sorted by (hash, doc, checksum, pos), equal rows once: which rows are the first of their hash."""
    order = np.lexsort((pos, crc, doc, g, h))
    h, g, doc, crc, pos, end = (x[order] for x in (h, g, doc, crc, pos, end))
    new = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    other = np.concatenate([[True], new | (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (pos[1:] != pos[:-1])])
    first = np.concatenate([[True], new])[other]
    return h[other], g[other], doc[other], crc[other], pos[other], end[other], first


def _spans(doc, crc, pos, end) -> list[tuple[int, int, bytes]]:
    """A row a document: (from, to) sentence spans."""
    if not len(doc):
        return []
    order = np.lexsort((pos, crc, doc))
    doc, crc, pos, end = doc[order], crc[order], pos[order], end[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
    return [(int(doc[a]), int(crc[a]), np.stack([pos[a:b], end[a:b]], 1).astype(np.int32).tobytes()) for a, b in zip(cut, [*cut[1:], len(doc)])]


#: Of the packed runs, column after column.
_RUN = (("<u8", 0), ("<u8", 8), ("<i8", 16), ("<u4", 24), ("<i4", 28), ("<i4", 32))
_RUN_BYTES = 36
ROWS = "part int, runs binary, spans binary, doc long, crc long"


def _pack(block: list, n_parts: int) -> pa.RecordBatch:
    h, g, doc, crc, pos, end, first = _settle(*[np.concatenate(x) for x in zip(*block)])
    again = ~first
    rows = _spans(doc[again], crc[again], pos[again], end[again])
    part = (h[first] % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keep = [x[first][order] for x in (h, g, doc, crc, pos, end)]
    edges = np.searchsorted(part[order], np.arange(n_parts + 1))
    packed = [b"".join(x[a:b].astype(t).tobytes() for x, (t, _) in zip(keep, _RUN)) for a, b in zip(edges, edges[1:]) if b > a]
    ids = [k for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return pa.record_batch([
        pa.array([*ids, *[d % n_parts for d, _, _ in rows]], pa.int32()), pa.array([*packed, *[None] * len(rows)], pa.binary()),
        *[pa.array([*[None] * len(ids), *[r[k] for r in rows]], t) for k, t in ((2, pa.binary()), (0, pa.int64()), (1, pa.int64()))],
    ], names=["part", "runs", "spans", "doc", "crc"])


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, crc, spans): spans of sentences to remove, packed int32 pairs; a document may have several rows. A null doc_id is the least long."""
    n_parts = groups_for(docs)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                h, g, a, b = runs(text, min_sentences, min_words)
                if len(h):
                    block.append((h, g, np.full(len(h), _NULL if doc is None else doc, np.int64), np.full(len(h), zlib.crc32(text.encode("utf-8", "surrogatepass")), np.uint32), a, b))
                    held += len(h)
                if held >= BLOCK_RUNS:
                    yield _pack(block, n_parts)
                    block, held = [], 0
        if block:
            yield _pack(block, n_parts)

    def settle(key, table):
        blobs = [b for b in table.column("runs").to_pylist() if b]
        out = [r for r in zip(*(table.column(c).to_pylist() for c in ("doc", "crc", "spans"))) if r[2] is not None]
        if blobs:
            cols = [[np.frombuffer(b, t, len(b) // _RUN_BYTES, o * (len(b) // _RUN_BYTES)) for b in blobs] for t, o in _RUN]
            _, _, doc, crc, pos, end, first = _settle(*map(np.concatenate, cols))
            out += _spans(doc[~first], crc[~first], pos[~first], end[~first])
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("doc", pa.int64()), ("crc", pa.int64()), ("spans", pa.binary())))})

    sent = docs.select("doc_id", "text").mapInArrow(send, ROWS)
    return sent.groupBy("part").applyInArrow(settle, "doc long, crc long, spans binary")


def cut(text: str, spans: list[bytes]) -> tuple[str, int, int]:
    """(text without the spans, sentences, sentences removed)."""
    own = sentences(text)
    gone = np.zeros(len(own) + 1, np.int64)
    for s in spans:
        pairs = np.frombuffer(s, np.int32).reshape(-1, 2)
        np.add.at(gone, pairs[:, 0], 1)
        np.add.at(gone, pairs[:, 1], -1)
    covered = np.cumsum(gone)[:-1] > 0
    return "".join(text[a:b] for (a, b), c in zip(own, covered) if not c), len(own), int(covered.sum())


def dedup_substrings(docs: DataFrame, **rule) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of the documents that lose sentences; all others stay as they are.

    One of several rows with one doc_id is treated like the others."""
    spans = materialise(repeated_spans(docs, **rule), "spans").groupBy("doc", "crc").agg(F.collect_list("spans").alias("spans"))
    key = F.coalesce(F.col("doc_id"), F.lit(_NULL))
    met = docs.select("doc_id", "text").join(spans, (key == F.col("doc")) & (F.crc32(F.col("text").cast("binary")) == F.col("crc"))).select("doc_id", "text", "spans")

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [cut(t or "", s) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
            yield pa.record_batch([part.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string())], names=["doc_id", "n_sentences", "n_removed", "text"])

    return met.mapInArrow(remove, "doc_id long, n_sentences long, n_removed long, text string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
