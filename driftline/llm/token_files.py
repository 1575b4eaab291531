"""Token ids in Arrow stream files of fixed-size-list batches: equal-length sequences and their masks.

A file holds one shard of the documents, in doc_id order, as one run of ids cut into sequences of ``length``; the last is padded
with the end id and its mask is false there. Column ``ids`` is fixed_size_list<uint16 or uint32>[length], ``mask`` is
fixed_size_list<bool>[length]. The values of a batch lie in one buffer, so sequence i of a batch is a slice of it: readers map
the file and copy nothing. Batches hold ``rows`` sequences each, so sequence i is in batch i // rows.

Defined results: a null or empty text is the end id alone; repeated and null doc_ids keep their own ranges, nulls first; an
empty table writes no files; extra columns are ignored.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import new_path, partitions

END = 2
_encoders: dict[str, "Encoder"] = {}


class _Odd(Exception):
    """Spaces stand together or at the end, so words cannot be told by single spaces."""


class Encoder:
    """A byte-level BPE of the tokenizers library, with a bounded memory of the words met.

    The pattern of byte-level BPE never joins what stands before ' x' (x not a space) with what follows, and no id crosses a
    piece of the pattern, so ids are looked up by word, then by piece; only an unknown piece goes to the library's model.
    A full memory becomes the old one, from which words that are met again come back.
    """

    KEPT = 500_000

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 2**16 else np.uint32
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.before = regex.compile(r"(?= \S)")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.table = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.added = [t for t in (str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) if t]
        self.words: dict[str, bytes] = {}  # of words behind a space, without it
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        found = self.pieces.get(p)
        if found is None:
            found = self.old_pieces.get(p)
            if found is None:
                shown = p.encode("utf-8").decode("latin-1").translate(self.table)
                found = np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()
            if len(self.pieces) >= self.KEPT:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[p] = found
        return found

    def word(self, w: str) -> bytes:
        found = self.old_words.get(w)
        if found is None:
            if not w or w[0].isspace():
                raise _Odd
            found = self.loose(" " + w)
        if len(self.words) >= self.KEPT:
            self.old_words, self.words = self.words, {}
        self.words[w] = found
        return found

    def loose(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):  # special tokens inside a text: as the library takes them
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        first, *rest = text.split(" ")
        get = self.words.get
        try:
            ids = [get(w) or self.word(w) for w in rest]
        except _Odd:
            return b"".join(map(self.loose, self.before.split(text)))
        return self.loose(first) + b"".join(ids)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def batch(ids: np.ndarray, length: int, sch: pa.Schema) -> pa.RecordBatch:
    """Whole sequences from a run of ids; the last one is padded."""
    rows = -(-len(ids) // length)
    padded = np.full(rows * length, END, ids.dtype)
    padded[: len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=sch)


MANIFEST = "shard int, path string, first_id long, doc_ids binary, lengths binary, tokens long"


def writer(tokenizer: str, folder: str, length: int, rows: int):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrows"  # a name for each attempt; only the manifest's count
        sch = schema(enc.dtype, length)
        end = np.array([END], enc.dtype).tobytes()
        out, held, ids, lens, nulls, total = None, [], [], [], [], 0
        size = np.dtype(enc.dtype).itemsize
        stream = None
        pending = 0
        full = length * rows
        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                got = (enc.encode(text) if text else b"") + end
                held.append(got)
                pending += len(got) // size
                ids.append(doc or 0)
                nulls.append(doc is None)
                lens.append(len(got) // size)
                if pending >= full:
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        stream = fs.open_output_stream(f"{base}/{name}")
                        out = pa.ipc.new_stream(stream, sch)
                    run = np.frombuffer(b"".join(held), enc.dtype)
                    whole = len(run) // full * full
                    for k in range(0, whole, full):
                        out.write_batch(batch(run[k : k + full], length, sch))
                    held, pending = [run[whole:].tobytes()], len(run) - whole
        if not ids:
            return
        if out is None:
            fs.create_dir(base, recursive=True)
            stream = fs.open_output_stream(f"{base}/{name}")
            out = pa.ipc.new_stream(stream, sch)
        if pending:
            out.write_batch(batch(np.frombuffer(b"".join(held), enc.dtype), length, sch))
        out.close()
        stream.close()
        # The index goes out in pieces of bounded size; nulls are told by a length below zero.
        signed = np.where(nulls, -np.array(lens, np.int64), np.array(lens, np.int64))
        at = 0
        for k in range(0, len(ids), 100_000):
            own = signed[k : k + 100_000]
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([at], pa.int64()), pa.array([np.array(ids[k : k + 100_000], np.int64).tobytes()]), pa.array([own.tobytes()]), pa.array([int(np.abs(own).sum())], pa.int64())], names=["shard", "path", "first_id", "doc_ids", "lengths", "tokens"])
            at += int(np.abs(own).sum())

    return write


class TokenFile:
    """Random access to the sequences of one file, by memory map where it is local."""

    def __init__(self, path: str) -> None:
        fs, name = open_fs(path)
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else pa.BufferReader(fs.open_input_file(name).read_buffer())
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size
        self.rows = self.batches[0].num_rows
        self.flat = [b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def sequence(self, i: int) -> np.ndarray:
        k = i % self.rows
        return self.flat[i // self.rows][k * self.length : (k + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        k = i % self.rows
        return self.batches[i // self.rows].column("mask").flatten().slice(k * self.length, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n; a view where they lie in one batch."""
        step = self.rows * self.length
        parts, end = [], first + n
        while first < end:
            b, k = divmod(first, step)
            take = min(end - first, step - k)
            parts.append(self.flat[b][k : k + take])
            first += take
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = 2048, rows: int = 64, shards: int | None = None) -> DataFrame:
    """Writes the files once and returns their manifest: a row for each 100,000 documents of a shard at most.

    One range exchange by doc_id; every task writes its own file under a name of its own, and the manifest, itself a table in
    the shared folder, names the files of the attempts that counted."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    manifest = new_path(spark, "token-manifest")
    ordered = docs.select("doc_id", "text").repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(writer(tokenizer, folder, length, rows), MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    # One number a shard; the window over them holds as many rows as there are files.
    per = manifest.groupBy("shard").agg(F.sum("tokens").alias("n"))
    before = per.withColumn("shard_start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    work = manifest.join(F.broadcast(before), "shard").repartition(partitions(manifest.sparkSession), "shard", "first_id")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                f = TokenFile(r["path"])
                ids, lens = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["lengths"], np.int64)
                at = r["first_id"] + np.concatenate([[0], np.cumsum(np.abs(lens))[:-1]])
                sums = [zlib.crc32(np.ascontiguousarray(f.tokens(int(a), int(n)), "<u4").tobytes()) for a, n in zip(at, np.abs(lens))]
                yield pa.record_batch([pa.array(ids, mask=lens < 0), pa.array(at + r["shard_start"]), pa.array(np.abs(lens)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
