"""Copies of benchmark items that differ from them in capitals and sentence starts only, or in a name that starts a sentence."""

from __future__ import annotations

from driftline.llm import bitmaps, decontamination

from . import common as K

ITEMS = [
    (1, "What is the capital city of the northern island near France"),
    (2, "Tom has twelve apples left. Tom gives two apples away. Tom keeps the others there. Tom counts them again"),
    (3, "Add 3 and 4 and 5 and 6"),
]
TEXTS = [
    "They asked him What is the capital city of the northern island near France and he left",
    "so: " + ITEMS[1][1].replace("Tom", "Ann") + ". The end",
    "now add 3 and 4 and 5 and 6 please",
    "now add 3 and 4 and 5 and 7 please",
]


def test_copies_inside_sentences_and_with_other_first_names(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = K.documents(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert {(0, 1), (1, 2), (2, 3)} <= found
    assert not {(3, 1), (3, 2), (0, 2)} & found


TRIP = "a train leaves {0} at noon and needs {1} to reach {2} while the fare stays {3} for each of the riders"
PLANTED = [
    TRIP.format("Paris", "3 hours", "New York", "$25"), TRIP.format("San Marino City", "1 hour", "Rome", "30 dollars"), TRIP.format("Bo Al Ed", "12h", "NASA", "7 USD"),
    TRIP.format("Rome", "3 hours", "Rome", "$25"),  # one name in both slots is another question
]


def test_other_units_names_and_signs_are_one_template(spark):
    items = spark.createDataFrame([(1, "So we know that " + PLANTED[0]), (2, "Oslo is just about 5 km away from Rome"), (3, "seven plain words that nobody else writes")], "item_id long, text string")
    texts = [f"They say that {p} as a rule" for p in PLANTED] + ["and Bergen is just about 70 miles away from York too", "here seven plain words that nobody else writes stand"]
    docs = K.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    found = {(r.doc_id, r.item_id): r.n_windows for r in decontamination.leaks(docs, items).collect()}
    assert set(found) - {(3, 1)} == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 3)}
    assert found[0, 1] == found[1, 1] == found[2, 1] > found.get((3, 1), 0)  # only windows without both names match


def test_bitmaps_hold_what_was_put_in(spark):
    h = spark.range(3000).selectExpr("xxhash64(id) AS h")
    bits = bitmaps.bitmap_of(h, "h", 64)
    words = bitmaps.constant(bits)
    assert h.filter(~bitmaps.in_bitmap(words, len(bits), h["h"])).isEmpty()
    others = spark.range(10_000, 20_000).selectExpr("xxhash64(id) AS h")
    assert others.filter(bitmaps.in_bitmap(words, len(bits), others["h"])).count() < 100
