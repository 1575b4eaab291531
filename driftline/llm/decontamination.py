"""Benchmark decontamination by templates, in DataFrame functions alone.

Numbers, names and units become typed placeholders, so a benchmark question with other numbers or names has the same template.
Every window of ``WINDOW`` template words of every whole text meets the windows of the benchmark in a hash join; a match counts if
its slots are consistent, which is to say that equal values stand in equal slots and different values in different ones on both
sides. A benchmark item shorter than a window is one window of its own length, down to ``SHORTEST`` words.

Each text is compared in three forms, and a document holds an item if any of them matches:

0. names are runs of capitalised words inside sentences ("New York" is one slot, so is "NASA"),
1. the same with words that start a sentence as names too,
2. word by word without slots, so that verbatim copies match wherever they stand and however few literal words they have.

The windows reported are those of the first form that matches, counted in that form's words.

A number starts with a digit. A unit is a word of ``UNITS`` behind a number, written apart or not, or a sign at either side of
it; units that differ in spelling only have one value. Words are compared in lower case without punctuation.

Only a document that holds an anchor is put into forms: each window of the benchmark has one, a pair of adjacent words, and a document
without the pair cannot hold the window. Anchors and window hashes are tested against bitmaps of a fixed largest size, so what goes
out with the plan is bounded however large the benchmark is, and only windows that pass are rows.

Defined results: null, empty and short texts match nothing; items without text or with fewer than SHORTEST words match nothing; windows
with fewer than ``LITERAL`` words besides placeholders match only word by word; equal items are all reported; repeated and null
doc_ids are reported like any other, once for each doc_id and item; ties don't arise, as rows are keyed by doc_id and item; very
long texts are compared whole; empty tables give an empty result; extra columns are ignored or, in ``without_leaks``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import small
from .bitmaps import bitmap_of, constant, in_bitmap, without_ids
from .runtime import materialise, partitions

WINDOW, SHORTEST, LITERAL = 12, 5, 5
FORMS = 3
#: Spellings of each unit; a plural s is understood.
UNITS = {
    "millimeter": "mm millimetre", "centimeter": "cm centimetre", "meter": "m metre", "kilometer": "km kilometre", "inch": "inches", "foot": "ft feet",
    "yard": "yd", "mile": "mi", "milligram": "mg", "gram": "g gramme", "kilogram": "kg kilo", "pound": "lb lbs", "ounce": "oz", "ton": "tonne",
    "milliliter": "ml millilitre", "liter": "l litre", "gallon": "gal", "cup": "", "pint": "", "quart": "", "second": "s sec", "minute": "min", "hour": "h hr", "day": "",
    "week": "", "month": "", "year": "yr", "decade": "", "dollar": "usd buck", "cent": "", "euro": "eur", "sterling": "gbp", "yen": "jpy", "rupee": "inr",
    "percent": "pct", "degree": "", "mph": "", "kmh": "kph", "volt": "v", "watt": "w", "kilowatt": "kw", "joule": "j", "newton": "n", "hertz": "hz", "byte": "",
    "kilobyte": "kb", "megabyte": "mb", "gigabyte": "gb", "piece": "", "dozen": "", "time": "", "page": "", "point": "", "person": "people",
}
SIGNS = {"$": "dollar", "€": "euro", "£": "sterling", "¥": "yen", "₹": "rupee", "%": "percent", "°": "degree"}
CANONICAL = {spelling: unit for unit, more in UNITS.items() for s in (unit, *more.split()) for spelling in (s, s + "s")} | {"feet": "foot", "inches": "inch"}
#: Placeholders, from the private use area; the mark between the digits of one number; the mark between the words of one name.
NAME, NUMBER, UNIT, JOINT, TIE = "\ue001", "\ue002", "\ue003", "\ue004", "\ue006"
MARKS = NAME + NUMBER + UNIT + JOINT + TIE
_W, _NOT_W = r"[\p{L}\p{M}\p{N}]", rf"[^\p{{L}}\p{{M}}\p{{N}}{MARKS}]"
_UNITS = "|".join(sorted(CANONICAL, key=lambda u: (-len(u), u)))
#: Whole-text substitutions (pattern, replacement by parts), in order and without look-around, so that SQL engines can share them.
DIGITS = [
    *[(rf"[{s}] ?([0-9][0-9.,:]*)", ("", 1, f" {u} ")) for s, u in SIGNS.items()],
    *[(rf"([0-9]) ?[{s}]", ("", 1, f" {u} ")) for s, u in SIGNS.items()],
    *[(r"([0-9])[.,:]([0-9])", ("", 1, JOINT, 2, ""))] * 2,
]
TIES = [
    *[(rf"({_W}) (\p{{Lu}})", ("", 1, TIE, 2, ""))] * 2,
    (rf"(^|{_NOT_W})([\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\p{{M}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}{JOINT}]*){TIE}", ("", 1, "", 2, " ")),
]
#: Names of each form, and what is done in lower case.
NAMES = [
    [(r"([\p{L}\p{M}\p{N},;] )(\p{Lu})", ("", 1, NAME, 2, "")), (rf"(^|{_NOT_W})(\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}]*){TIE}", ("", 1, "", 2, f" {NAME}"))],
    [(rf"(^|{_NOT_W})(\p{{Lu}})", ("", 1, NAME, 2, ""))],
    [(TIE, (" ",))],
]
LOWER = [
    (rf"([0-9])({_UNITS})($|{_NOT_W})", ("", 1, " ", 2, "", 3, "")),
    (rf"(^|{_NOT_W})([0-9])", ("", 1, NUMBER, 2, "")),
    (rf"({NUMBER}[\p{{N}}{JOINT}]+[^\p{{L}}\p{{M}}\p{{N}}]* ){NAME}?({_UNITS})($|{_NOT_W})", ("", 1, UNIT, 2, "", 3, "")),
]
REST = rf"{_NOT_W}+"
TOKENS = r"[^\p{L}\p{M}\p{N}]+"
SLOT = f"[{NAME}{NUMBER}{UNIT}]"


def _replaced(t: Column, steps: list) -> Column:
    for regex, parts in steps:
        t = F.regexp_replace(t, regex, "".join(f"${p}" if isinstance(p, int) else p.replace("$", r"\$") for p in parts))
    return t


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARKS, " " * len(MARKS))


def form_texts(text: Column) -> list[Column]:
    """The text in each form: words one space apart, a word that fills a slot with its placeholder in front."""
    clean = _clean(text)
    common = _replaced(F.when(clean.rlike("[0-9]"), _replaced(clean, DIGITS)).otherwise(clean), TIES)
    out = []
    for k, names in enumerate(NAMES):
        low = F.lower(_replaced(common, names))
        slots = F.when(low.rlike("[0-9]"), _replaced(low, LOWER)).otherwise(low) if k < 2 else low
        out.append(F.trim(F.regexp_replace(slots, REST, " ")))
    return out


def is_slot(word: Column) -> Column:
    return (word >= NAME) & (word < JOINT)


def pattern(values: Column) -> Column:
    """For each slot, where its value first stood: equal on both sides if the slots are consistent."""
    return F.transform(values, lambda v: F.array_position(values, v))


def _canonical(values: Column) -> Column:
    """Slot values, with one spelling a unit."""
    table = F.expr("map(" + ", ".join(f"'{UNIT}{x}'" for kv in sorted(CANONICAL.items()) if kv[0] != kv[1] for x in kv) + ")")
    return F.transform(values, lambda v: F.when(v.startswith(UNIT), F.coalesce(F.try_element_at(table, v), v)).otherwise(v))


def windows(forms: DataFrame, key: str, sizes: list[int], whole: bool, bitmap: list[int] | None = None) -> DataFrame:
    """(key, form, size, pos, hash, words) of windows of (key, words0, words1, words2), arrays of each form's words. ``whole``: windows
    of ``sizes[0]`` words and, of shorter texts, the one that is the whole text; else windows of all sizes whose hash is in the bitmap."""
    template = lambda ws: F.transform(ws, lambda w: F.xxhash64(F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(w)))
    d = forms.select(key, *[f"words{k}" for k in range(FORMS)], *[template(F.col(f"words{k}")).alias(f"hashes{k}") for k in range(FORMS)])
    empty = F.array().cast("array<struct<size:int,pos:int,hash:bigint>>")

    def made(k: int) -> Column:
        h, n = F.col(f"hashes{k}"), F.size(f"hashes{k}")

        def at(size: Column) -> Column:
            return F.coalesce(F.transform(
                F.when(n >= size, F.sequence(F.lit(1), n - size + 1)), lambda i: F.struct(size.alias("size"), i.alias("pos"), F.xxhash64(F.slice(h, i, size), size).alias("hash")),
            ), empty)

        found = at(F.when((n >= SHORTEST) & (n < sizes[0]), n).otherwise(F.lit(sizes[0]))) if whole else F.concat(*[at(F.lit(s)) for s in sizes])
        return F.transform(found, lambda w: F.struct(F.lit(k).alias("form"), w["size"].alias("size"), w["pos"].alias("pos"), w["hash"].alias("hash")))

    found = F.concat(*[made(k) for k in range(FORMS)])
    if bitmap is not None:
        words = constant(bitmap)
        found = F.filter(found, lambda w: in_bitmap(words, len(bitmap), w["hash"]))
    own = lambda w: F.coalesce(*[F.when(w["form"] == k, F.slice(f"words{k}", w["pos"], w["size"])) for k in range(FORMS)])
    each = F.transform(found, lambda w: F.struct(w["form"].alias("form"), w["size"].alias("size"), w["pos"].alias("pos"), w["hash"].alias("hash"), own(w).alias("words")))
    out = d.select(key, F.explode(each).alias("w")).select(key, "w.*")
    literal = F.size(F.filter("words", lambda w: ~is_slot(w)))
    return out.filter((F.col("form") == FORMS - 1) | (literal >= F.least(F.lit(LITERAL), F.col("size"))))


def _formed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, *[F.split(t, " ").alias(f"words{k}") for k, t in enumerate(form_texts(F.col("text")))])


def _anchor_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words, F.lit(len(words)))


def _anchor(words: Column) -> Column:
    """struct(kind, hash): of a window the three adjacent words with most letters together; if there are none, two or one; null without any.
    Only words of letters count, and no units, which a text may write in other ways."""
    units = F.expr(f"array({', '.join(repr(u) for u in sorted(CANONICAL))})")
    fit = F.transform(words, lambda w: F.when(w.rlike(r"^[\p{L}\p{M}]+$") & ~F.array_contains(units, w), w))

    def best(ws: Column, k: int) -> Column:
        def here(w: Column, i: Column) -> Column:
            more = [w, *[F.get(ws, i + j) for j in range(1, k)]]
            return F.struct(sum((F.length(x) for x in more[1:]), F.length(w)).alias("n"), F.lit(k).alias("kind"), _anchor_hash(more).alias("hash"))

        top = F.array_max(F.transform(ws, here))  # a null word makes n null, and nulls are the least
        return F.when(top["n"].isNotNull(), F.struct(top["kind"].alias("kind"), top["hash"].alias("hash")))

    return F.transform(F.array(fit), lambda ws: F.coalesce(best(ws, 3), best(ws, 2), best(ws, 1)))[0]


def _holds_anchor(text: Column, bitmap: list[int], kinds: list[int]) -> Column:
    """Whether a text has an anchor of one of the kinds. Words are made once."""
    tokens = F.split(F.regexp_replace(F.lower(_clean(text)), TOKENS, " "), " ")

    def any_of(both: Column) -> Column:
        ts = both["tokens"]

        def here(w: Column, i: Column) -> Column:
            out = F.lit(False)
            for k in kinds:
                out = out | in_bitmap(both["bits"], len(bitmap), _anchor_hash([w, *[F.get(ts, i + j) for j in range(1, k)]]))
            return out

        return F.array_contains(F.transform(ts, here), True)

    return F.exists(F.array(F.struct(tokens.alias("tokens"), constant(bitmap).alias("bits"))), any_of)


def leaks(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word): documents and the items they hold, with the words of the first form that matches."""
    # A benchmark is a small file; its windows are made by all tasks.
    own = benchmark.select("item_id", "text").repartition(partitions(docs.sparkSession))
    items = windows(_formed(own, "item_id"), "item_id", [length], whole=True)
    values = lambda ws: pattern(_canonical(F.filter(ws, is_slot)))
    known = materialise(items.select("item_id", "form", "size", "hash", values(F.col("words")).alias("item_slots"), _anchor(F.col("words")).alias("anchor")), "templates")
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").isNull().cast("int")).alias("loose"), F.collect_set("size").alias("sizes"), F.collect_set("anchor.kind").alias("kinds")).first()
    if not stats["n"]:
        return docs.select("doc_id").limit(0).crossJoin(benchmark.select("item_id").limit(0)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("last_word"))
    texts = docs.select("doc_id", "text")
    if not stats["loose"]:  # every window has an anchor
        texts = texts.filter(_holds_anchor(F.col("text"), bitmap_of(known, "anchor.hash", 512), sorted(stats["kinds"])))
    found = windows(_formed(texts, "doc_id"), "doc_id", sorted(stats["sizes"], reverse=True), False, bitmap_of(known, "hash", 16))
    met = found.join(small(known.select("item_id", "form", "size", "hash", "item_slots")), ["form", "size", "hash"]).filter(values(F.col("words")) == F.col("item_slots"))
    by_form = met.groupBy("doc_id", "item_id", "form").agg(
        F.countDistinct("pos").alias("n_windows"), F.min("pos").cast("long").alias("first_word"), (F.max(F.col("pos") + F.col("size")) - 1).cast("long").alias("last_word"),
    )
    first = F.min(F.struct("form", "n_windows", "first_word", "last_word")).alias("m")
    return by_form.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "m.n_windows", "m.first_word", "m.last_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; a row without doc_id goes if any such row holds one."""
    return without_ids(docs, leaks(docs, benchmark).select("doc_id"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def leaks_sql(docs: str) -> str:
    """The same by exact templates: lists of words are joined, not hashes, and all windows of all texts are made."""

    def replaced(t: str, steps: list) -> str:
        for regex, parts in steps:
            t = f"regexp_replace({t}, '{regex}', '{''.join(chr(92) + str(p) if isinstance(p, int) else p for p in parts)}', 'g')"
        return t

    def formed(rel: str, key: str, k: int) -> str:
        common = f"SELECT {key}, {replaced(f'''translate(coalesce(text, ''), '{MARKS}', '{' ' * len(MARKS)}')''', [*DIGITS, *TIES])} AS c FROM {rel}"
        low = f"lower({replaced('c', NAMES[k])})"
        return f"SELECT {key}, {k} AS form, string_split(trim(regexp_replace({replaced(low, LOWER) if k < 2 else low}, '{REST}', ' ', 'g')), ' ') AS ws FROM ({common})"

    slot = f"('{NAME}', '{NUMBER}', '{UNIT}')"
    units = "MAP {" + ", ".join(f"'{UNIT}{a}': '{UNIT}{b}'" for a, b in sorted(CANONICAL.items()) if a != b) + "}"

    def wins(rel: str, key: str, sizes: str) -> str:
        forms = " UNION ALL ".join(formed(rel, key, k) for k in range(FORMS))
        return f"""
SELECT {key}, form, size, p AS pos, list_transform(ws[p:p + size - 1], lambda w: CASE WHEN w[1] IN {slot} THEN w[1] ELSE w END) AS t,
  list_transform(list_filter(ws[p:p + size - 1], lambda w: w[1] IN {slot}), lambda x: coalesce(({units})[x], x)) AS v
FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM (SELECT f.*, size FROM ({forms}) f JOIN ({sizes}) z ON len(ws) >= size AND (z.own IS NULL OR len(ws) = z.own)))"""

    of_item = f"SELECT CASE WHEN n = {WINDOW} THEN {WINDOW} ELSE n END AS size, CASE WHEN n < {WINDOW} THEN n END AS own FROM range({SHORTEST}, {WINDOW + 1}) r(n)"
    return f"""
WITH b AS ({wins('benchmark', 'item_id', of_item)}), z AS (SELECT DISTINCT size, NULL AS own FROM b),
d AS ({wins(docs, 'doc_id', 'SELECT * FROM z')}),
m AS (SELECT d.doc_id, b.item_id, d.form, count(DISTINCT d.pos) AS n_windows, min(d.pos) AS first_word, max(d.pos + d.size) - 1 AS last_word
FROM d JOIN b ON d.form = b.form AND d.size = b.size AND d.t = b.t
WHERE (d.form = {FORMS - 1} OR d.size - len(d.v) >= least({LITERAL}, d.size))
  AND list_transform(d.v, lambda x: list_position(d.v, x)) = list_transform(b.v, lambda x: list_position(b.v, x))
GROUP BY d.doc_id, b.item_id, d.form)
SELECT doc_id, item_id, n_windows, first_word, last_word FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY form) = 1"""


SQL = leaks_sql("documents")
