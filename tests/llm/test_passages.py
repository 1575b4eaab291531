"""Every repeated passage of 50 words has a run of its own, whatever surrounds it."""

from __future__ import annotations

import numpy as np
import pytest

from driftline.llm import substring_dedup

from . import common as K

WORDS = [f"p{k * 7919 % 997}" for k in range(54)]
PASSAGES = {
    "no stops": " ".join(WORDS),
    "two whole clauses": " ".join(w + ("," if k in (8, 24, 40) else "") for k, w in enumerate(WORDS)),
    "quotes": " ".join(w + ('."' if k % 9 == 8 else "") for k, w in enumerate(WORDS)),
    "symbols": " ".join(w + (".&&&" if k % 9 == 8 else "") for k, w in enumerate(WORDS)),
    "one word": " ".join(["same"] * 54),
}


def test_passages_inside_sentences_are_removed(spark):
    texts = [f"before {k} it {p} after {k} it" for p in PASSAGES.values() for k in range(2)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(K.documents(spark, rows)).collect()}
    for n, name in enumerate(PASSAGES):
        assert 2 * n + 1 in got and len(texts[2 * n + 1].split()) - len(got[2 * n + 1].split()) >= substring_dedup.MIN_WORDS, name


@pytest.mark.parametrize("stops", [0, 3, 10, 40])
def test_each_fifty_words_share_a_run(stops):
    rng = np.random.default_rng(stops)
    word = lambda: f"w{rng.integers(400)}" + ("", ",", ". ", '."')[rng.integers(1, 4) if rng.integers(100) < stops else 0].strip()
    for _ in range(400):
        passage = " ".join(word() for _ in range(50))
        a, b = (set(substring_dedup.runs(" ".join([*(word() for _ in range(rng.integers(1, 30))), passage, *(word() for _ in range(rng.integers(1, 30)))]))[0].tolist()) for _ in range(2))
        assert a & b, passage


def test_ideographic_stops_and_pieces_are_the_text():
    parts = lambda t: [t[a:b] for a, b in substring_dedup.sentences(t)]
    assert parts("東京です。「はい。」そう、です") == ["東京です。「", "はい。」", "そう、", "です"] and parts('He said "so." Next et.&&& more a.b') == ['He said "so." ', "Next et.&&& ", "more a.b"]
    for t in (*PASSAGES.values(), " \t\n", "..." * 50, *(r[1] or "" for r in K.ROWS)):
        assert "".join(parts(t)) == t
