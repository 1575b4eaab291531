"""Licence sentences in any wrapping, the distance between them, and a matcher by brute force."""

from __future__ import annotations

import re
import textwrap

import pytest

from driftline.llm import license_scan as L

from . import common as K

MIT = [L.SENTENCES[k] for k in ("grant-mit", "notice-mit", "asis-mit", "liability-mit")]


@pytest.mark.parametrize("width", [20, 28, 36, 40, 72, 120])
@pytest.mark.parametrize("prefix", ["", "# ", " * ", "    // "])
def test_wrapped_texts_are_whole(width, prefix):
    text = "\n\n".join(textwrap.fill(s, width, initial_indent=prefix, subsequent_indent=prefix, break_on_hyphens=False, break_long_words=False) for s in MIT)
    found = L.licences(f"Some words before.\n{text}\nand after")
    assert [(f["licence"], f["kind"], len(f["sentences"])) for f in found] == [("MIT", "text", 4)]


@pytest.mark.parametrize("name", sorted(L.SENTENCES))
def test_every_sentence_is_found_alone(name):
    s = L.SENTENCES[name]
    one = L.normalise(s)
    for text in (s, f"before it\n{s}\nbehind it", "\n".join(s.split(" ", 1))):
        got = [i[3] for i in L.BOOK.identify(text)]
        assert got and L.BOOK.hint.search(text), text
        if not any(o != name and (one.startswith(L.normalise(v)) or L.normalise(v).startswith(one)) for o, v in L.SENTENCES.items()):
            assert name in got or ";" in s[:-1] or ". " in s, (text, got)


def test_distance_is_kept():
    at = lambda n: f"{MIT[0]}\n" + "".join(f"unrelated line {k}\n" for k in range(n)) + f"{MIT[1]}\n{MIT[2]}"
    assert [L.licences(at(n))[0]["licence"] for n in (0, 2, 3, 300)] == ["MIT", "MIT", None, None]


def test_a_caller_adds_sentences_and_rules(spark):
    book = L.BOOK.extended({"own-a": "You may eat this cake.", "own-b": "You may not sell it."}, [("Cake-1.0", "text", ("own-a", "own-b"))])
    assert [f["licence"] for f in book.licences("You may eat this\ncake. You may\nnot sell it.")] == ["Cake-1.0"]
    docs = K.documents(spark, [(1, "You may eat this cake. You may not sell it.", "en", "a")] * 2 + [(2, "x " * 50_000 + MIT[0], "en", "a")])
    assert sorted((r.doc_id, r.licence, r.kind) for r in L.scan(docs, book).collect() if r.licence) == [(1, "Cake-1.0", "text")] * 2
    assert [r.doc_id for r in L.scan(docs).collect()] == []  # a sentence in the middle of a line is none


def brute(text):
    """Identifiers at each start of a line or sentence, by joining all that follows and comparing with every known sentence."""
    cuts = [0, *[m.end() for m in re.finditer(r"[\r\n]+|(?<=[.;!])\s+", text)]]
    pieces = [t for t in (text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])) if t.strip()]
    flat = lambda s: " ".join(L.normalise(s).split())
    norm = [flat(L._BULLET.sub("", p.strip())) for p in pieces]
    known = {flat(s): k for k, s in L.SENTENCES.items()}
    out, k = [], 0
    while k < len(norm):
        best = None
        for j in range(k, len(norm)):
            whole = " ".join(x for x in norm[k : j + 1] if x)
            if whole in known:
                best = (j, known[whole])
            if not any(s.startswith(whole) for s in known):
                break
        if best:
            out.append((k, best[1], best[0]))
            k = best[0] + 1
        else:
            k += 1
    return out


def test_identifiers_against_brute_force(duck):
    rows = [t for t, in duck.execute("SELECT text FROM documents WHERE text ILIKE '%licens%' OR text ILIKE '%rights reserved%' OR text ILIKE '%copyright%'").fetchall()]
    rows += ["\n".join(MIT), textwrap.fill(" ".join(L.SENTENCES.values()), 50), "(c) 2020 Me\nAll rights\nreserved."]
    assert len(rows) > 5
    for t in rows:
        assert [(i[0], i[3], i[4]) for i in L.BOOK.identify(t)] == brute(t)


def test_texts_without_a_hint_hold_no_sentence(duck):
    for t, in duck.execute("SELECT text FROM documents").fetchall():
        if t and not L.BOOK.hint.search(t):
            assert not L.BOOK.identify(t)
