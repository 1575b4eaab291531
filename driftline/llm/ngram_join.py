"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

Documents with one shingle set are one class. Two classes can only reach the threshold t if their sizes differ by a factor of t
at most and if they share one of the first n - ceil(t n) + 1 shingles in any fixed order of all shingles. The steps:

1. ``common_shingles``: shingles that stand out in some block of documents, to be last in the order, and a bitmap of those that many
   documents would lead with, to be behind all others: a phrase of many documents makes no group where they have rarer ones. Both
   only steer which shingles meet; the result is the same with any such tables, so their bounds lose nothing.
2. ``signatures``: for each row its set's size, digest and bitmap; and the leading shingles, packed by hash partition.
3. ``meet``: classes that share a leading shingle. Up to ``PAIRS_TO`` of them and in fitting size bands are pairs at once; the
   members of larger groups fetch their bitmaps first.
4. ``tiles``: large groups as tiles in size order. Bit counts bound each overlap from above:
   2 |x and y| <= |x| + |y| - bits(bitmap x xor bitmap y). A tile sends a spanning forest of what passes, never all pairs.
5. ``connected``: classes joined by what passed. True components lie inside these.
6. ``verify``: inside each, breadth-first search by bitmap bound and exact sorted-array intersection; again a spanning forest
   of true links. Groups of over ``TILE_MEMBERS`` and components of over ``UNIT_SHINGLES`` are cut into size bands, the bands into
   blocks, and only blocks of one band or of neighbouring ones meet.

So links, members and sets are spread over tasks by hashes, no step emits the pairs of a group, and each link between different
sets is either tested or implied by a path of tested links.

Defined results: null and blank texts have an empty set and are linked with nothing; a repeated doc_id has a row for each of its
rows; a null doc_id is linked like any other but never names a component unless all ids there are null; an empty table gives an
empty result; extra columns are ignored or, in ``without_near_copies``, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components as connected
from ..plans.strategy import small
from .bitmaps import may_hold, without_ids
from .runtime import groups_for, materialise
from .shingles import mix, shingle_sets

K = 5
NUM, DEN = 80, 100  # links: DEN * intersection >= NUM * union
COMMON_IN_BLOCK, COMMON_KEPT = 4, 1 << 17
#: Shingles that so many documents would lead with are heavy; their bitmap has 16 bits for each, 2^HEAVY_BITS (8 MB) at most.
HEAVY_FROM, HEAVY_BITS = 10, 26
BLOCK_SHINGLES = 1_500_000
PAIRS_TO = 16
SPREAD_FROM = 50_000
TILE_MEMBERS = 4096
UNIT_SHINGLES = 4_000_000


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, shingle sets) of whole texts, up to about BLOCK_SHINGLES at once."""
    ids, sets, held = [], [], 0
    for part in parts:
        for k in range(0, part.num_rows, 256):
            p = part.slice(k, 256)
            own = shingle_sets(p.column("text").to_pylist(), K)
            ids += p.column("doc_id").to_pylist()
            sets += own
            held += sum(map(len, own))
            if held >= BLOCK_SHINGLES:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d >> 64, d & (2**64 - 1)


def bitmap(s: np.ndarray) -> np.ndarray:
    """2^k bits, at least two for each shingle, as 64-bit words; low hash bits are places, so halves fold onto each other."""
    n = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[(s & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def fold(words: np.ndarray) -> np.ndarray:
    if words.shape[-1] == 1:
        return words
    half = words.shape[-1] // 2
    return words[..., :half] | words[..., half:]


def band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.05)).astype(np.uint16)


#: Sizes a factor of DEN / NUM apart are so many bands apart at most.
BANDS_APART = int(np.ceil(np.log(DEN / NUM) / np.log(1.05))) + 1


def _take(n: int) -> int:
    """How many leading shingles a set of n must show."""
    return n - -(-NUM * n // DEN) + 1


def _by_part(columns: tuple[np.ndarray, ...], n_parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Columns, of which the first is shingles, by the hash partition of these: where each partition starts, and the columns in its order."""
    part = (mix(columns[0]) >> np.uint64(32)).astype(np.int64) % n_parts
    by = np.argsort(part, kind="stable")
    return np.searchsorted(part[by], np.arange(n_parts + 1)), [c[by] for c in columns]


def common_shingles(docs: DataFrame, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by how common they are, up to COMMON_KEPT hashes: those in COMMON_IN_BLOCK different sets of one block or more; those of
    them that were met SPREAD_FROM times or more; and the bitmap of heavy ones, by the low bits of ``mix``.

    For the bitmap, half as many shingles again as a set must show are counted, by hash partition: each once a block, with its count."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _blocks(parts):
            every = [s for s in {digest(s): s for s in sets if len(s)}.values()]
            if not every:
                continue
            h, n = np.unique(np.concatenate(every), return_counts=True)
            h, n = h[n >= COMMON_IN_BLOCK], n[n >= COMMON_IN_BLOCK]
            t, m = np.unique(np.concatenate([s[: _take(len(s)) * 3 // 2] for s in every]), return_counts=True)
            (h_of, h), (t_of, t) = (_by_part(x, n_parts) for x in ((h, n), (t, np.minimum(m, 255).astype(np.uint8))))
            t = (mix(t[0]) & np.uint64(0xFFFFFFFF)).astype(np.uint32), t[1]
            full = [k for k in range(n_parts) if t_of[k + 1] > t_of[k] or h_of[k + 1] > h_of[k]]
            blobs = lambda edge, cols: pa.array([b"".join(c[edge[k] : edge[k + 1]].tobytes() for c in cols) for k in full], pa.binary())
            yield pa.record_batch([pa.array(full, pa.int32()), blobs(h_of, h), blobs(t_of, t)], names=["part", "often", "seen"])

    def total(key, table):
        def summed(column, kind, width):
            kinds = np.dtype(kind), np.dtype(width)
            own = [(x, len(x) // (kinds[0].itemsize + kinds[1].itemsize)) for x in table.column(column).to_pylist()]
            what, at = np.unique(np.concatenate([np.frombuffer(x, kinds[0], n) for x, n in own]), return_inverse=True)
            return what, np.bincount(at, np.concatenate([np.frombuffer(x, kinds[1], n, n * kinds[0].itemsize) for x, n in own]), len(what)).astype(np.int64)

        (h, n), (t, m) = summed("often", np.uint64, np.int64), summed("seen", np.uint32, np.uint8)
        t = t[m >= HEAVY_FROM].astype(np.int64)
        return pa.table({"h": pa.concat_arrays([pa.array(_signed(h)), pa.nulls(len(t), pa.int64())]), "n": pa.concat_arrays([pa.array(n), pa.nulls(len(t), pa.int64())]), "t": pa.concat_arrays([pa.nulls(len(h), pa.int64()), pa.array(t)])})

    counted = docs.select("doc_id", "text").mapInArrow(count, "part int, often binary, seen binary").groupBy("part").applyInArrow(total, "h long, n long, t long")
    counted = materialise(counted, "counted")
    rows = counted.filter("h IS NOT NULL").select("h", "n").orderBy(F.desc("n"), "h").limit(COMMON_KEPT).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64)[::-1].copy(), rows.column("n").to_numpy()[::-1]
    many = counted.filter("t IS NOT NULL").select("t")
    size = 1 << min(HEAVY_BITS, max(16, (16 * many.count()).bit_length()))
    place = F.col("t").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = many.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return h, h[n >= SPREAD_FROM], bits.view(np.uint64)


class Order:
    """Rare shingles by hash, then heavy ones by hash, then common ones from the least common on."""

    def __init__(self, common: np.ndarray, heavy: np.ndarray) -> None:
        self.heavy = heavy
        by_hash = np.argsort(common, kind="stable")
        self.sorted, self.rank = common[by_hash], by_hash  # each hash and its place in `common`
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def light_first(self, s: np.ndarray, take: int) -> np.ndarray:
        at = mix(s) & np.uint64(64 * len(self.heavy) - 1)
        heavy = (self.heavy[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        light = s[~heavy]
        return light[:take] if len(light) >= take else np.concatenate([light, s[heavy][: take - len(light)]])

    def leading(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        take = _take(n)
        if not len(self.sorted):
            return self.light_first(s, take)
        maybe = np.flatnonzero(self.seen[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, s[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == s[maybe]
        if not hit.any():
            return self.light_first(s, take)
        common = np.zeros(n, bool)
        common[maybe[hit]] = True
        rare = self.light_first(s[~common], take)
        if len(rare) >= take:
            return rare
        last = s[maybe[hit]][np.argsort(self.rank[at[hit]], kind="stable")]
        return np.concatenate([rare, last[: take - len(rare)]])


SIGNED = "doc_id long, n long, h1 long, h2 long, bits binary, part int, lead binary"


def signatures(docs: DataFrame, common: np.ndarray, spread: np.ndarray, heavy: np.ndarray, n_parts: int) -> DataFrame:
    """Rows of two kinds: a document's (doc_id, n, h1, h2, bits), and (part, lead): packed leading shingles of a block. Members of
    the groups that are known to be very large (``spread``) don't gather in a partition: they are in part -1, as (g, h1)."""
    far = np.sort(mix(spread))

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(common, heavy)
        for ids, sets in _blocks(parts):
            h1, h2, n = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))
            bits: list[bytes | None] = []
            lead, owner, met = [], [], set()
            for k, s in enumerate(sets):
                if not len(s):
                    bits.append(None)
                    continue
                d = digest(s)
                h1[k], h2[k] = d
                bits.append(bitmap(s).tobytes())
                if d not in met:  # equal sets send once from each block
                    met.add(d)
                    first = order.leading(s)
                    lead.append(first)
                    owner.append(np.full(len(first), k, np.int64))
            m = len(sets)
            none = pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n), pa.array(_signed(h1)), pa.array(_signed(h2)), pa.array(bits, pa.binary()), *none], names=[x.split()[0] for x in SIGNED.split(", ")])
            if not lead:
                continue
            t, o = np.concatenate(lead), np.concatenate(owner)
            t = mix(t)
            part = (t >> np.uint64(32)).astype(np.int64) % n_parts
            apart = np.isin(t, far) if len(far) else np.zeros(len(t), bool)
            g = (part[apart] << 32) | (t[apart] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            straight = g.tobytes() + h1[o[apart]].tobytes()
            t, o, part = t[~apart], o[~apart], part[~apart]
            by = np.argsort(part, kind="stable")
            t, o = (t[by] & np.uint64(0xFFFFFFFF)).astype(np.uint32), o[by]
            edge = np.searchsorted(part[by], np.arange(n_parts + 1))
            size = band(n)
            full = [k for k in range(n_parts) if edge[k + 1] > edge[k]]
            blobs = [t[edge[k] : edge[k + 1]].tobytes() + h1[o[edge[k] : edge[k + 1]]].tobytes() + size[o[edge[k] : edge[k + 1]]].tobytes() for k in full]
            if straight:
                full.append(-1)
                blobs.append(straight)
            m = len(full)
            yield pa.record_batch([*[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.binary()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNED)


def meet(lead: DataFrame) -> DataFrame:
    """(a, b, g): with g null a pair of classes, else class a in the large group g.

    A group falls apart where its sizes have a gap that no link spans. Large groups are named by their least class and so merged with
    all that share it: classes that are alike meet in many groups of nearly the same members, and go out once for most of them."""

    def run(key, table):
        part = key[0].as_py()
        ts, hs, bs = [], [], []
        for blob in table.column("lead").to_pylist():
            n = len(blob) // 14
            ts.append(np.frombuffer(blob, np.uint32, n))
            hs.append(np.frombuffer(blob, np.uint64, n, 4 * n))
            bs.append(np.frombuffer(blob, np.uint16, n, 12 * n))
        t, h, b = np.concatenate(ts), np.concatenate(hs), np.concatenate(bs).astype(np.int32)
        by = np.lexsort((h, b, t))
        t, h, b = t[by], h[by], b[by]
        own = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])
        t, h, b = t[own], h[own], b[own]
        at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (np.diff(b) > BANDS_APART)]))
        n = np.diff(np.concatenate([at, [len(t)]]))
        left, right = [], []
        for s in range(2, PAIRS_TO + 1):
            first = at[n == s]
            if len(first):
                i, j = np.triu_indices(s, 1)
                x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                fit = np.abs(b[x] - b[y]) <= BANDS_APART
                left.append(h[x[fit]])
                right.append(h[y[fit]])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left else np.empty((0, 2), np.uint64)
        big = np.flatnonzero(n > PAIRS_TO)
        rows = np.concatenate([np.arange(at[k], at[k] + n[k]) for k in big]) if len(big) else np.empty(0, np.int64)
        members = np.unique(np.stack([np.repeat(np.minimum.reduceat(h, at)[big], n[big]), h[rows]], 1), axis=0)
        g, own = (_signed(np.ascontiguousarray(members[:, k])) for k in (0, 1))
        a = np.concatenate([_signed(np.ascontiguousarray(pairs[:, 0])), own])
        return pa.table({
            "a": pa.array(a), "b": pa.concat_arrays([pa.array(_signed(np.ascontiguousarray(pairs[:, 1]))), pa.nulls(len(g), pa.int64())]),
            "g": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(g)]),
        })

    def straight(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for blob in part.column("lead").to_pylist():
                n = len(blob) // 16
                yield pa.record_batch([pa.array(np.frombuffer(blob, np.int64, n, 8 * n)), pa.nulls(n, pa.int64()), pa.array(np.frombuffer(blob, np.int64, n))], names=["a", "b", "g"])

    out = "a long, b long, g long"
    return lead.filter("part >= 0").groupBy("part").applyInArrow(run, out).union(lead.filter("part < 0").mapInArrow(straight, out))


class Tile:
    """Members in size order with their bitmaps, also folded once, so that neighbouring lengths can be compared."""

    def __init__(self, n: np.ndarray, bits: list[bytes]) -> None:
        self.n = n
        own = [np.frombuffer(b, np.uint64) for b in bits]
        self.words = np.fromiter(map(len, own), np.int64, len(own))
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words):
            native = np.flatnonzero(self.words == w)
            double = np.flatnonzero(self.words == 2 * w)
            rows = [own[k] for k in native] + [fold(own[k]) for k in double]
            self.level[int(w)] = np.concatenate([native, double]), np.stack(rows)
        self.own = own

    def near(self, k: int, open_: np.ndarray) -> np.ndarray:
        """Open members whose overlap with k may reach the threshold by size and bit count."""
        out, n = [], self.n
        w = int(self.words[k])
        for width, mine in ((w, self.own[k]), (w // 2, fold(self.own[k]) if w > 1 else None)):
            if width not in self.level or mine is None or width == 0:
                continue
            who, rows = self.level[width]
            if width != w:
                native = self.words[who] == width
                who, rows = who[native], rows[native]
            ok = open_[who] & (n[who] * DEN >= n[k] * NUM) & (n[who] * NUM <= n[k] * DEN)
            who = who[ok]
            if len(who):
                apart = np.bitwise_count(rows[ok] ^ mine).sum(1, dtype=np.int64)
                most = (n[who] + n[k] - apart) // 2
                out.append(who[(DEN + NUM) * most >= NUM * (n[who] + n[k])])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def forest(count: int, near) -> list[tuple[int, int]]:
    """A spanning forest by breadth-first search; near(k, open) gives the open members linked with k."""
    open_ = np.ones(count, bool)
    out = []
    for root in range(count):
        if not open_[root]:
            continue
        open_[root] = False
        todo = [root]
        while todo:
            k = todo.pop()
            found = near(k, open_)
            if len(found):
                open_[found] = False
                out += [(k, int(x)) for x in found]
                todo += found.tolist()
    return out


#: Bands of the tiles: sizes that may link are in one band or in neighbouring ones.
def _wide_band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(DEN / NUM)).cast("long")


def _dealt(rows: DataFrame, group: str, weight: Column, most: int, n_parts: int) -> DataFrame:
    """rows, which have n and h1, with (gi, gj, unit). A group of ``most`` or less is one unit. A larger one is cut into size bands and
    each band into blocks by hash; blocks of one band or of neighbouring bands go out as pairs, each row to the pairs of its block. Sets
    in bands further apart cannot link, so these never meet."""
    b = rows.withColumns({"band": _wide_band(F.col("n")), "weight": weight})
    per = b.groupBy(group, "band").agg(F.sum("weight").alias("w"))
    large = per.groupBy(group).agg(F.sum("w").alias("w")).filter(F.col("w") > most).select(group)
    per = materialise(per.join(large, group, "left_semi").select(group, "band", F.ceil(F.col("w") / most).cast("long").alias("k")), "bands")
    beside = lambda name, step: per.select(group, (F.col("band") + step).alias("band"), F.col("k").alias(name))
    cut = materialise(per.join(beside("below", 1), [group, "band"], "left").join(beside("above", -1), [group, "band"], "left"), "blocks")
    # Only bands of large groups have a row here, so the members of a group don't come together to be dealt out.
    r = b.join(small(cut), [group, "band"], "left").withColumn("fits", F.col("k").isNull())
    blocks = lambda band, k: F.transform(F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.shiftleft(band, 32).bitwiseOR(i))
    own = F.shiftleft("band", 32).bitwiseOR(F.pmod(F.xxhash64("h1"), F.col("k")))
    every = F.concat(blocks(F.col("band"), F.col("k")), blocks(F.col("band") - 1, F.coalesce("below", F.lit(0).cast("long"))), blocks(F.col("band") + 1, F.coalesce("above", F.lit(0).cast("long"))))
    none = F.lit(-1).cast("long")
    r = r.withColumn("own", F.when(F.col("fits"), none).otherwise(own)).withColumn("other", F.explode(F.when(F.col("fits"), F.array(none)).otherwise(every)))
    # A pair of different blocks also tests each block itself; a block without any other is a pair with itself.
    alone = (F.col("k") == 1) & F.col("below").isNull() & F.col("above").isNull()
    r = r.filter(F.col("fits") | (F.col("own") != F.col("other")) | alone)
    r = r.withColumns({"gi": F.least("own", "other"), "gj": F.greatest("own", "other")})
    return r.withColumn("unit", F.pmod(F.xxhash64(group, "gi", "gj"), F.lit(n_parts)).cast("int")).select(*rows.columns, "gi", "gj", "unit")


def _groups(table: pa.Table, group: str) -> Iterator[pa.Table]:
    t = table.sort_by([(group, "ascending"), ("gi", "ascending"), ("gj", "ascending"), ("n", "ascending"), ("h1", "ascending")])
    keys = [t.column(c).to_numpy() for c in (group, "gi", "gj")]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if t.num_rows else np.empty(0, bool)
    at = np.flatnonzero(new)
    for a, b in zip(at, [*at[1:], t.num_rows]):
        yield t.slice(a, b - a)


def _edges(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in out]) if out else np.empty(0, np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def tiles(members: DataFrame, classes: DataFrame, n_parts: int) -> DataFrame:
    """(a, b) from members (g, h1), which fetch their bitmaps when they are dealt out."""

    def run(key, table):
        out = []
        for t in _groups(table, "g"):
            h, n = t.column("h1").to_numpy(), t.column("n").to_numpy()
            tile = Tile(n, t.column("bits").to_pylist())
            e = np.array(forest(len(n), tile.near), np.int64).reshape(-1, 2)
            out.append((h[e[:, 0]], h[e[:, 1]]))
        return _edges(out)

    sized = members.join(classes.select("h1", "n"), "h1").select("g", "h1", "n")
    dealt = _dealt(sized, "g", F.lit(1), TILE_MEMBERS, n_parts)
    work = dealt.select("g", "gi", "gj", "unit", "h1", "n").join(classes.select("h1", "bits"), "h1")
    return work.groupBy("unit").applyInArrow(run, "a long, b long")


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bit counts may reach the threshold."""
    c = classes.select("h1", "n", "bits")
    p = pairs.join(c.withColumnsRenamed({"h1": "a", "n": "na", "bits": "xa"}), "a").join(c.withColumnsRenamed({"h1": "b", "n": "nb", "bits": "xb"}), "b")
    p = p.filter((F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for na, nb, xa, xb in zip(*(part.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                while len(x) > len(y):
                    x = fold(x)
                while len(y) > len(x):
                    y = fold(y)
                most = (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2
                keep.append((DEN + NUM) * most >= NUM * (na + nb))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return p.mapInArrow(run, "a long, b long")


def exact_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """True links among sets in size order, as a spanning forest."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    tile = Tile(n, [bitmap(s).tobytes() for s in sets])

    def near(k: int, open_: np.ndarray) -> np.ndarray:
        who = tile.near(k, open_)
        if not len(who):
            return who
        mine = sets[k]
        every = np.concatenate([sets[x] for x in who])
        at = np.searchsorted(mine, every)
        at[at == len(mine)] = 0
        both = np.add.reduceat((mine[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(n[who])[:-1]]))
        return who[DEN * both >= NUM * (n[who] + n[k] - both)]

    return forest(len(sets), near)


def verify(docs: DataFrame, candidates: DataFrame, n_parts: int) -> DataFrame:
    """(a, b) true links, a spanning forest of each component, from candidates (rep, h1, h2, n, label), which are a written table."""
    # A merge join at every size: the candidates are a share of all documents, so they are never the side to broadcast.
    # Where candidates are few, other rows don't move.
    some = may_hold(docs.select("doc_id", "text"), candidates.select("rep"))
    texts = some.join(candidates.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep")
    keep = ["label", "h1", "n"]

    def shingled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 256):
                p = part.slice(k, 256)
                sets = shingle_sets(p.column("text").to_pylist(), K)
                want = zip(p.column("h1").to_pylist(), p.column("h2").to_pylist())
                same = [bool(len(s)) and tuple(x - 2**64 if x >= 2**63 else x for x in digest(s)) == w for s, w in zip(sets, want)]
                rows = p.filter(pa.array(same, pa.bool_()))
                yield pa.record_batch([*[rows.column(c) for c in keep], pa.array([s.tobytes() for s, ok in zip(sets, same) if ok], pa.binary())], names=[*keep, "shingles"])

    # Sets move once, to their unit. A doc_id with several rows may bring its set twice.
    sets = texts.mapInArrow(shingled, "label long, h1 long, n long, shingles binary")
    work = sets.join(_dealt(candidates.select("label", "h1", "n"), "label", F.col("n"), UNIT_SHINGLES, n_parts).drop("n"), ["label", "h1"])

    def run(key, table):
        out = []
        for t in _groups(table, "label"):
            h = t.column("h1").to_numpy()
            first = np.concatenate([[True], h[1:] != h[:-1]])
            h = h[first]
            s = [np.frombuffer(x, np.uint64) for x, ok in zip(t.column("shingles").to_pylist(), first) if ok]
            e = np.array(exact_forest(s), np.int64).reshape(-1, 2)
            out.append((h[e[:, 0]], h[e[:, 1]]))
        return _edges(out)

    return work.groupBy("unit").applyInArrow(run, "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, first_copy): a row for each row of docs; first_copy is the smallest doc_id with this set."""
    n_parts = groups_for(docs)
    signed = materialise(signatures(docs, *common_shingles(docs, n_parts), n_parts), "signatures")
    rows = signed.filter("n IS NOT NULL").select("doc_id", "n", "h1", "h2", "bits")
    classes = materialise(
        rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes",
    )
    met = materialise(meet(signed.filter("part IS NOT NULL").select("part", "lead")), "met")
    pairs = met.filter("g IS NULL").select("a", "b").distinct()
    members = met.filter("g IS NOT NULL").select("g", F.col("a").alias("h1")).distinct()
    maybe = materialise(possible(pairs, classes).union(tiles(members, classes, n_parts)), "possible")
    loose = materialise(connected(maybe, "loose"), "loose-labels")
    candidates = materialise(classes.join(loose, F.col("h1") == F.col("node")).select("rep", "h1", "h2", "n", "label"), "candidates")
    links = materialise(verify(docs, candidates, n_parts), "links")
    final = materialise(connected(links, "true"), "true-labels")
    labelled = classes.select("h1", "h2", "rep").join(final, F.col("h1") == F.col("node"), "left").withColumn("label", F.coalesce("label", "h1"))
    top = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labelled.join(top, "label").select("h1", "h2", F.col("rep").alias("first_copy"), "component_id")
    full = rows.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    empty = F.col("n") == 0
    return full.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("first_copy")).alias("first_copy"),
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest doc_id. Of rows that share it, all stay. Texts stay where they are."""
    stays = components(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    return without_ids(docs, stays.filter(~F.col("stays")).select("doc_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
