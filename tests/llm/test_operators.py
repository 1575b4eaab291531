"""Every operator on a small table with odd cases, against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import bitmaps, decontamination, license_scan, line_dedup, media_avi, mixing, ngram_join, quality, queries, sharding, substring_dedup, token_files
from tests.conftest import DATA, rows_of, sql_rows

from . import common as K


@pytest.fixture(scope="module")
def docs(spark):
    return K.documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return K.documents(spark, [])


def test_sql_agrees(spark, duck):
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        assert rows_of(df) == sql_rows(duck, sql, df.columns), name


# 1 -----------------------------------------------------------------------------------------------------------------------


def test_join_against_all_pairs(spark, docs):
    sets, want = K.jaccard_components(K.ROWS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect())
    assert got == Counter((row[0], len(s), c) for row, s, c in zip(K.ROWS, sets, want))


def test_join_over_a_whole_table(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    sets, want = K.jaccard_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_join"](spark, DATA).collect()}
    assert got == {r[0]: (len(s), c) for r, s, c in zip(rows, sets, want)}


def test_join_in_large_groups_and_blocks(spark, monkeypatch):
    """Near copies in a group over the limit of pairs, with blocks so small that every group is dealt out."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 60, i % 4):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w), "en", "a"))
    monkeypatch.setattr(ngram_join, "TILE_MEMBERS", 20)
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 1000)
    _, want = K.jaccard_components(rows)
    for spread in (50_000, 20):
        monkeypatch.setattr(ngram_join, "SPREAD_FROM", spread)
        got = {r.doc_id: r.component_id for r in ngram_join.components(K.documents(spark, rows)).collect()}
        assert got == {r[0]: c for r, c in zip(rows, want)}


def test_members_of_large_groups_do_not_grow_with_shared_shingles(spark):
    """A phrase of 40 unlike documents makes no group; 40 near copies go to few groups, not to one for each shingle they share."""
    phrase, base = "seen in all of these", [f"b{k}" for k in range(300)]
    rows = [(i, " ".join([*(f"u{i}_{k}" for k in range(60)), phrase]), "en", "a") for i in range(40)]
    rows += [(100 + i, " ".join(f"e{i}" if k == 7 * i else w for k, w in enumerate(base)), "en", "a") for i in range(40)]
    docs = K.documents(spark, rows).coalesce(1)
    signed = ngram_join.signatures(docs, *ngram_join.common_shingles(docs, 4), 4)
    met = ngram_join.meet(signed.filter("part IS NOT NULL").select("part", "lead")).distinct().collect()
    of = {r.h1: r.doc_id for r in signed.filter("n > 0").collect()}
    members = [of[r.a] for r in met if r.g is not None]
    assert set(members) == set(range(100, 140)) and len(members) <= 3 * 40
    assert all(of[r.a] >= 100 for r in met)
    _, want = K.jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in ngram_join.components(docs).collect()} == {r[0]: c for r, c in zip(rows, want)}


def test_bit_counts_bound_overlaps_from_above():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in rng.integers(20, 120, 2))
        a, b = ngram_join.bitmap(x), ngram_join.bitmap(y)
        while len(a) != len(b):
            a, b = (ngram_join.fold(a), b) if len(a) > len(b) else (a, ngram_join.fold(b))
        assert (len(x) + len(y) - int(np.bitwise_count(a ^ b).sum())) // 2 >= len(np.intersect1d(x, y))


def test_join_keeps_one_and_its_columns(docs, none):
    out = ngram_join.without_near_copies(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[1] == 1 and not {2, 3, None} & set(ids) and ids[4] == ids[5] == ids[6] == 1
    assert ngram_join.components(none).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = [(100, "a  b", "", ""), (101, " lead and trail \n\n x", "", ""), (102, "it's we'll  <|endoftext|> 12 3.4 \t\t!", "", ""), (103, " nbsp  em  ", "", "")]
    d = docs.union(K.documents(spark, odd))
    manifest = token_files.write_token_files(d, path, length=16, rows=4, shards=3)
    got = token_files.read_token_files(manifest).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((row[0], library.encode(row[1] or "", add_special_tokens=False).ids + [2]) for row in [*K.ROWS, *odd]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.read_token_files(token_files.write_token_files(none, path)).count() == 0


def test_token_files_give_equal_sequences_without_copies(spark, docs):
    import public_tokenizers

    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), length=16, rows=4, shards=1)
    r = manifest.first()
    f = token_files.TokenFile(r.path)
    assert f.batches[0].schema.field("ids").type.list_size == 16
    assert f.sequence(5).base is not None and list(f.sequence(5)) == list(f.tokens(80, 16))
    last = sum(b.num_rows for b in f.batches) - 1
    assert int(f.mask(last).sum()) == (r.tokens - 1) % 16 + 1 and f.mask(0).all()


# 3 -----------------------------------------------------------------------------------------------------------------------


def items(spark, rows=((1, K.ITEM), (2, None), (3, ""), (4, "too short"), (5, "five words and no more"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_templates_catch_other_parameters_but_not_broken_ones(spark, docs, none):
    d = docs.union(K.documents(spark, [(30, "He said: five, words and NO more!", "", "")]))
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(d, items(spark)).collect()}
    assert {(15, 1), (16, 1), (30, 5)} <= found
    # 17 has one of two equal numbers changed: only windows that hold one of the two slots still match.
    whole = {r.doc_id: r.n_windows for r in decontamination.leaks(d, items(spark)).collect() if r.item_id == 1}
    assert whole[15] == whole[16] and whole.get(17, 0) < whole[15]
    assert decontamination.leaks(none, items(spark)).count() == 0 and decontamination.leaks(docs, items(spark, [])).count() == 0


def test_templates_shuffled_join_gives_the_same(spark, docs, monkeypatch):
    want = rows_of(decontamination.leaks(docs, items(spark)))
    monkeypatch.setattr(decontamination, "small", lambda d: d)
    assert rows_of(decontamination.leaks(docs, items(spark))) == want


@pytest.mark.parametrize("few", [500_000, 0])
def test_without_leaks_keeps_the_rest(spark, docs, monkeypatch, few):
    monkeypatch.setattr(bitmaps, "BROADCAST_IDS", few)
    out = decontamination.without_leaks(docs, items(spark))
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in K.ROWS) - Counter([15, 16, 17])


def test_decontamination_stays_native(spark):
    plan = decontamination.op3_decontamination(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 4 -----------------------------------------------------------------------------------------------------------------------

MIT = """Copyright (c) 2020 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark, docs, none):
    got = {(r.doc_id, r.licence, r.kind) for r in license_scan.scan(docs).collect()}
    assert got == {(19, "MIT", "reference"), (19, "proprietary", "reference")}
    found = license_scan.licences(f"Some words before.\n{MIT}\nand after")
    assert [(f["licence"], f["kind"], len(f["sentences"])) for f in found] == [("MIT", "text", 3)]
    shuffled = "THE SOFTWARE IS PROVIDED nothing. Permission is hereby given to nobody."
    assert license_scan.licences(shuffled) == [] and license_scan.licences(None) == [] and license_scan.scan(none).count() == 0
    clue = license_scan.licences("See the License for the specific language governing permissions and limitations under the License.")
    assert [f["kind"] for f in clue] == ["clue"]
    assert license_scan.licences("# SPDX-License-Identifier: GPL-2.0-only")[0]["licence"] == "GPL-2.0-only"


def test_licence_lines_of_a_whole_table(spark, duck):
    want = duck.execute("""SELECT doc_id, count(*) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
      WHERE l IN ('Released under the MIT License.', 'Licensed under the Apache License, Version 2.0.', 'Licensed under CC BY-NC 4.0.',
      'This work is licensed under the GNU General Public License, version 3.', 'All rights reserved.') GROUP BY doc_id""").fetchall()
    got = Counter(r.doc_id for r in queries.QUERIES["op4_license_scan"](spark, DATA).filter("kind = 'reference'").collect())
    assert got == Counter(dict(want))


# 5 -----------------------------------------------------------------------------------------------------------------------


def test_quality_is_right_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    out = queries.QUERIES["op5_quality"](spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    r = out.join(labels, "doc_id").filter("held_out").selectExpr("avg(int(predicted = quality)) a", "avg(if(quality = 1, predicted, null)) k", "count(*) n").first()
    assert r.n > 300 and r.a >= 0.95 and r.k >= 0.98
    assert all(int(x.held_out) == int(zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in out.limit(500).collect())


def test_quality_defined_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (99, 1)], "doc_id long, quality int")
    got = quality.scored(docs, labels, ["doc_id"], "t").collect()
    assert len(got) == len(K.ROWS) and {r.score for r in got} == {0.5}  # one class only
    assert quality.scored(none, labels, ["doc_id"], "t").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert all(np.isfinite(quality.features(t)).all() for t in (None, "", " ", "x", K.BASE, "\n\n", "|" * 99))


# 6 -----------------------------------------------------------------------------------------------------------------------


def brute_spans(rows):
    seen, gone = {}, defaultdict(set)
    for i, text in sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()))):
        parts = substring_dedup.sentences(text)
        words = [[w for w in K.WORDS.findall(text[a:b].translate(K.FOLD))] for a, b in parts]
        for k in range(len(parts)):
            e, n = k, 0
            while e < len(parts) and (e - k < substring_dedup.MIN_SENTENCES or n < substring_dedup.MIN_WORDS):
                n += len(words[e])
                e += 1
            if e - k < substring_dedup.MIN_SENTENCES or n < substring_dedup.MIN_WORDS:
                continue
            key = tuple(w for x in words[k:e] for w in x)
            if key in seen and seen[key] != (i, text, k):
                gone[i, text] |= set(range(k, e))
            seen.setdefault(key, (i, text, k))
    return {(i, "".join(t[a:b] for n, (a, b) in enumerate(substring_dedup.sentences(t)) if n not in g)) for (i, t), g in gone.items()}


def test_spans_against_brute_force(spark, docs, duck, none):
    got = {(r.doc_id, r.text) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == brute_spans(K.ROWS)
    assert {10} <= {i for i, _ in got} and not {9, 7, 11} & {i for i, _ in got}
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {(r.doc_id, r.text) for r in queries.QUERIES["op6_substring_dedup"](spark, DATA).collect()} == brute_spans(rows)
    assert substring_dedup.dedup_substrings(none).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, none):
    got = {}
    for r in media_avi.text_media(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in K.ROWS:
        raw = (text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert want in {(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got[i]}
    assert got[1][0].media_sha256 == got[2][0].media_sha256 and media_avi.text_media(none).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 12])
def test_frames_are_baseline_jpeg(blocks):
    """The decoder of even blocks and the general one read the same coefficients, which hold the bytes."""
    payload = np.random.default_rng(2).integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    shape = media_avi.shape(blocks)[1:]
    frame = media_avi.Frame(media_avi.encode_frame(payload, *shape))
    fast, plain = media_avi._even_blocks(frame), media_avi._all_blocks(frame)
    assert (fast == plain).all() and media_avi.stored_bytes(plain)[:blocks].tobytes() == payload


def test_feature_is_that_of_decoded_pictures(spark, duck):
    """Every stored film decoded block by block by the general decoder; the film itself is compared by its own bytes."""
    rows = duck.execute("SELECT doc_id, text FROM documents WHERE length(text) < 3000 ORDER BY doc_id LIMIT 25").fetchall() + [(999, None)]
    got = {r.doc_id: r for r in media_avi.text_media(K.documents(spark, [(i, t, "", "") for i, t in rows])).collect()}
    films = {r.media_id: bytes(r.media) for r in media_avi.text_films(K.documents(spark, [(i, t, "", "") for i, t in rows])).collect()}
    for i, t in rows:
        film = films[i]
        info = media_avi.parse_avi(film)
        frames = [media_avi.Frame(film[a : a + n]) for a, n in info["frames"]]
        pictures = [media_avi.picture(f, media_avi._all_blocks(f)) for f in frames]
        starts = media_avi.shots([np.histogram(p, 32, (0, 256))[0] / p.size for p in pictures])
        assert got[i].feature == f"frames={len(frames)};shots={','.join(f'{s / 25:.2f}' for s in starts)}"
        assert (got[i].media_bytes, got[i].media_sha256) == (len(film), hashlib.sha256(film).hexdigest())


def test_frames_without_tables_and_broken_ones():
    """Motion-JPEG leaves Huffman tables out; an empty frame repeats the last; a broken one costs itself."""
    def flat(level):
        diff = (level - 128) * 8
        size = abs(diff).bit_length()
        codes = ["00", "010", "011", "100", "101", "110", "1110", "11110", "111110", "1111110", "11111110", "111111110"]
        bits = codes[size] + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "") + "1010"
        bits += "1" * (-len(bits) % 8)
        head = b"\xff\xd8" + media_avi._segment(0xDB, b"\0" + b"\1" * 64) + media_avi._segment(0xC0, b"\x08\0\x08\0\x08\1\1\x11\0") + media_avi._segment(0xDA, b"\1\1\0\0\x3f\0")
        return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"

    frames = [flat(200)] * 4 + [b""] + [flat(200)[:30]] + [flat(200)] * 4 + [flat(30)] * 5
    film = media_avi._chunk(b"RIFF", b"AVI " + media_avi._list(b"movi", *[media_avi._chunk(b"00dc", f) for f in frames]))
    assert [(c["first_frame"], c["n_frames"], c["bad_frames"]) for c in media_avi.clips(film)] == [(0, 10, 1), (10, 5, 0)]


def grey_jpeg(level):
    """A flat 16x16 picture by DC coefficients alone."""
    head = media_avi._header(16, 16)
    bits = ""
    last = 0
    for _ in range(4):
        diff, last = (level - 128) * 8 - last, (level - 128) * 8
        size = abs(diff).bit_length()
        code = {0: "110", 9: "10", 10: "0"}[size]
        bits += code + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "") + "10"
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_clips_are_timed(spark):
    frames = [grey_jpeg(200)] * 10 + [grey_jpeg(40)] * 15 + [grey_jpeg(220)] * 5
    assert {int(media_avi.decode_jpeg(f).mean()) for f in frames} == {200, 40, 220}
    avi = media_avi.write_avi(b"x")
    # The same container around other frames.
    data = [media_avi._chunk(b"00dc", f) for f in frames]
    at, rows = 4, []
    for c in data:
        rows.append(b"00dc" + np.array([16, at, len(c) - 8], "<u4").tobytes())
        at += len(c)
    head = avi[12 : avi.index(b"LIST", avi.index(b"plen"))]
    body = b"AVI " + head + media_avi._list(b"movi", *data) + media_avi._chunk(b"idx1", b"".join(rows))
    film = media_avi._chunk(b"RIFF", body)
    got = spark.createDataFrame([(1, film), (2, b"no film"), (3, None)], "media_id long, media binary")
    clips = [(r.media_id, r.first_frame, r.n_frames, r.start_s, r.end_s) for r in media_avi.clip_rows(got).orderBy("clip").collect()]
    assert clips == [(1, 0, 10, 0.0, 0.4), (1, 10, 15, 0.4, 1.0), (1, 25, 5, 1.0, 1.2)]
    # Without an index the movi list is walked.
    bare = media_avi._chunk(b"RIFF", b"AVI " + head + media_avi._list(b"movi", *data))
    assert media_avi.clips(bare) == media_avi.clips(film)


# 8 -----------------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, docs, none):
    for d, n in ((docs, len(K.ROWS)), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 1000)):
        slots = defaultdict(list)
        for r in sharding.shard_rows(d).collect():
            slots[r.shard_no].append(r.shard_slot)
        assert sum(map(len, slots.values())) == n and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(docs).columns == [*[c for c in docs.columns if c != "shard_no"], "shard_no", "shard_slot"]
    assert sharding.shard_rows(none).count() == 0


def ring_walk(points, shards, slack=0.0):
    """Shard of each row, one row at a time: first every row whose own shard has room, arc by arc in ring order, then the others clockwise."""
    nodes = sharding.virtual_nodes(shards, 64)
    ring = [p for p, _ in nodes]
    room = sharding.bounds(len(points), shards, slack)
    arc = [bisect_left(ring, p) % len(ring) for p in points]
    out, late = [None] * len(points), []
    for k in sorted(range(len(points)), key=lambda k: (arc[k], points[k] >> 20, points[k], k)):
        s = nodes[arc[k]][1]
        if room[s]:
            room[s] -= 1
            out[k] = s
        else:
            late.append(k)
    for k in late:
        at = arc[k]
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        out[k] = nodes[at][1]
    return out


def test_shards_against_a_walk_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", sharding.ring_point(F.col("doc_id"), F.col("text")).alias("p")).orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], ring_walk([r.p for r in rows], 8)))
    assert {r.doc_id: r.shard for r in queries.QUERIES["op8_sharding"](spark, "/root/testdata/sf0.01").collect()} == want


@pytest.mark.parametrize("slack, most", [(0.0, 0.19), (0.1, 0.15)])
def test_bounded_loads_move_little(slack, most):
    points = np.random.default_rng(5).integers(0, sharding.RING, 20_000).tolist()
    a, b = (np.array(ring_walk(points, s, slack)) for s in (8, 9))
    assert all(np.bincount(x, minlength=s).max() <= (1 + slack) * len(points) / s + 2 for x, s in ((a, 8), (b, 9)))
    assert (a != b).mean() < most  # plain modulo would move 8 of 9, and 1 of 9 must move


# 9 -----------------------------------------------------------------------------------------------------------------------


def test_mix_targets_and_copies(docs, none):
    from driftline.llm.runtime import n_words

    out = mixing.with_copies(docs.select("doc_id", "source", n_words(F.col("text")).alias("mix_size"))).collect()
    sizes = Counter()
    for _, t, _, s in K.ROWS:
        sizes[s] += len(K.WORDS.findall(t or ""))
    want = K.mix_targets(sizes)
    for r in out:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - float(want[r.source])) < 1e-6 * max(1, r.mix_target)
        rate = r.mix_target / r.mix_source_size if r.mix_source_size else 0
        assert r.mix_copies in (int(rate), int(rate) + 1) and r.mix_copies <= 2
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and Counter(r.doc_id for r in mix.collect()) == sum((Counter({r.doc_id: r.mix_copies}) for r in out), Counter())
    assert mixing.mixed(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    out = mixing.op9_mixing(spark, "/root/testdata/sf0.1").groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert sum(r.t for r in out) == pytest.approx(sum(r.target for r in out), rel=0.03)
    assert all(r.t == pytest.approx(r.target, rel=0.15) for r in out)


# 10 ----------------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    by = defaultdict(set)
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(K.FOLD)
    small = lambda i: -(2**63) if i is None else i
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                by[key(x)].add(small(i))
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(by.get(key(x), ())) < 3 or max(by[key(x)]) == small(i)]
        out[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


def test_lines_against_brute_force(docs, none):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs).collect())
    assert got == brute_lines(K.ROWS)
    assert line_dedup.dedup_lines(none).count() == 0
