"""A small table of documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"pa{chr(97 + k % 26)}{chr(97 + k // 3 % 26)}{k}{'.' if k % 7 == 6 else ''}" for k in range(60))
BASE = " ".join(f"w{k * 7919 % 997}x" for k in range(120))
NEAR = " ".join("changed" if k == 60 else f"w{k * 7919 % 997}x" for k in range(120))
LINE = "this line stands in many of the documents"
ITEM = "what is the distance in 25 km when Paris sends 25 trains each of 40 seconds over the long bridge"
ITEM2 = ITEM.replace("25", "31").replace("40", "77").replace("Paris", "Madrid")
BROKEN = ITEM.replace("25", "31", 1).replace("40", "77")

#: (doc_id, text, lang, source, and columns whose names operators might use themselves).
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, None, "a"), (4, None, "en", "b"), (5, "", "en", None), (6, " \t\n\x0b ", "en", "b"),
    (7, "one two three", "en", "b"), (8, "One TWO  three", "en", None), (9, f"first words {PASSAGE} last words here", "en", "c"),
    (10, f"other start, {PASSAGE} another end of it", "de", "c"), (11, f"{LINE}\nalpha\n  {LINE.upper()}\t\nbeta", "en", "c"),
    (12, f"{LINE}\ngamma", "en", "d"), (13, f"delta\n{LINE}\n", "en", "d"), (14, "x" * 30_000 + " " + " ".join(f"long{k}" for k in range(30_000)), "fr", "d"),
    (15, f"so, {ITEM}, they asked", "en", "d"), (16, f"so, {ITEM2}, they asked", "en", "a"), (17, f"so, {BROKEN}, they asked", "en", "a"),
    (18, "Ünïcödé ÀÉ straße 東京 \U0001F600 text", "en", "a"), (19, "Released under the MIT License.\nAll rights reserved.", "en", "a"),
    (None, BASE, None, None), (20, "same id, first text", "en", "a"), (20, "same id, second text", "en", "a"), (21, "equal row", "en", "b"), (21, "equal row", "en", "b"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, known string, label int, h1 string, n int, t string, words string, mix_size int, mix_copies int, shard_no string, row string, x int"


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    full = [(i, t, l, s, len(t or ""), "k", 7, "h", 3, "t", "w", 1, 9, "s", "r", 4) for i, t, l, s in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def shingles(text, k=5):
    w = WORDS.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(rows):
    """(place in rows) -> smallest doc_id of its component, by all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    top = defaultdict(list)
    for i in range(len(rows)):
        top[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in top.items()}
    return sets, [rows[i][0] if not sets[i] else least[find(i)] for i in range(len(rows))]


def mix_targets(sizes, weights=(5, 2, 1)):
    """source -> target by repeated resharing, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        above = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not above:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in above:
            out[s] = Fraction(2 * sizes[s])
            open_.discard(s)
        left -= sum(out[s] for s in above)
    return out
