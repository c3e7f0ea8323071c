"""Problem 5: one consistent form for text that looks the same.

A transducer over grapheme clusters. Its mapping is computed before from Unicode's own data and checked for conflicts:
single characters (widths, spaces, what has no width), clusters of a base and its accents, and the steps by which a longer
cluster takes up one accent after the other. A compiled pattern takes the longest cluster; plain stretches are copied at
native speed, in the same single pass. Letters that look alike are folded by the word they stand in, as only the word
tells to which script they belong.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

# Letters of Cyrillic and Greek that are drawn like Latin ones.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХ": "ABESIJKMHOPCTYX",
    "аеѕіјорсухԁԛԝһ": "aesijopcyxdqwh",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οϲϳ": "ocj",
    "Ӏӏ": "Il",
}
# Hyphens and letter pairs that are drawn like others.
SIGNS = {"‐": "-", "‑": "-", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "\u2028": "\n", "\u2029": "\n"}
#: Code points that can need a form: the first two planes, compatibility ideographs and tags; the rest is its own form.
CODES = (*range(0x80, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0))
#: Kinds of compatibility decomposition that only change width or line breaking.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


def _add(table: dict[str, str], key: str, to: str) -> None:
    if table.get(key, to) != to:
        raise ValueError(f"conflict: {key!r} maps to {table[key]!r} and {to!r}")
    if key != to:
        table[key] = to


def mapping() -> dict[str, str]:
    """Single characters to their form; "" for those without visible width. Checked for conflicts and idempotence."""
    table: dict[str, str] = {}
    add = lambda key, to: _add(table, key, to)

    for code in CODES:
        ch = chr(code)
        category = unicodedata.category(ch)
        if category == "Zs":
            add(ch, " ")
        elif category == "Cf" and not 0x600 <= code <= 0x605 and code not in (0x6DD, 0x70F, 0x8E2) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
            add(ch, "")
        else:
            kind, _, rest = unicodedata.decomposition(ch).partition(" ")
            if kind in SAME_LOOK and ch not in SIGNS:
                add(ch, "".join(chr(int(x, 16)) for x in rest.split()))
    for key, form in SIGNS.items():
        add(key, form)
    for key, form in table.items():
        again = "".join(table.get(ch, ch) for ch in form)
        if again != form:
            raise ValueError(f"not idempotent: {key!r}")
    return table


def cluster_mapping(singles: dict[str, str]) -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    """(clusters of a base and its accents to their form, steps of a form and one more accent). Every composed letter has
    its whole decomposition and its last step as keys. Checked for conflicts, against the steps and for idempotence."""
    clusters: dict[str, str] = {}
    steps: dict[tuple[str, str], str] = {}
    for code in CODES:
        ch = chr(code)
        parts = unicodedata.decomposition(ch)
        if not parts or parts[0] == "<" or unicodedata.normalize("NFC", ch) != ch or ch in singles:
            continue
        base, *rest = (chr(int(x, 16)) for x in parts.split())
        if len(rest) == 1:
            _add(clusters, base + rest[0], ch)
            _add(clusters, unicodedata.normalize("NFD", ch), ch)
            steps[base, rest[0]] = ch
    for key, form in clusters.items():
        if form in clusters or compose(unicodedata.normalize("NFD", key), steps) != form:
            raise ValueError(f"conflict: {key!r} maps to {form!r} and not by steps")
    return clusters, steps


def compose(letters: str, steps: dict[tuple[str, str], str]) -> str:
    """A cluster's letters with the accents in their canonical order, each taken up by the base where there is a step for
    it and none of its class stands between."""
    base, marks = letters[0], sorted(letters[1:], key=unicodedata.combining)
    left: list[str] = []
    for mark in marks:
        to = steps.get((base, mark))
        if to is not None and not (left and unicodedata.combining(left[-1]) == unicodedata.combining(mark)):
            base = to
        else:
            left.append(mark)
    return base + "".join(left)


#: Letters of each script that look like Latin ones, and the way back.
TO_LATIN = {key: form for keys, forms in LOOKALIKES.items() for key, form in zip(keys, forms)}
FROM_LATIN = {script: {form: key for key, form in TO_LATIN.items() if unicodedata.name(key).startswith(script)} for script in ("CYRILLIC", "GREEK")}
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
LETTERS = re.compile(r"[^\W\d_]+")


def one_script(m: re.Match) -> str:
    """A word in one script: Latin, unless one of its letters has no Latin look-alike, then that letter's script."""
    word = m[0]
    own = next((c for c in word if FOREIGN.match(c) and c not in TO_LATIN), None)
    if own is None:
        return "".join(TO_LATIN.get(c, c) for c in word)
    back = FROM_LATIN["GREEK" if own < "\u0400" else "CYRILLIC"]
    return "".join(back.get(TO_LATIN.get(c, c), c) for c in word)


class Transducer:
    def __init__(self):
        self.table = mapping()
        self.whole, self.steps = cluster_mapping(self.table)
        one = lambda keys: "".join(f"{chr(a)}-{chr(b)}" if b > a else re.escape(chr(a)) for a, b in _runs(sorted(map(ord, keys))))
        zero = one(k for k, v in self.table.items() if len(k) == 1 and v == "")
        marks_of = [ch for ch in map(chr, CODES) if unicodedata.combining(self.table.get(ch, ch)[:1] or " ")]
        marks = one(marks_of)
        split_of = [chr(c) for c in CODES if unicodedata.normalize("NFC", chr(c)) != chr(c) and not unicodedata.combining(chr(c))]
        # A run of special characters is searched at native speed; clusters are told apart inside it: a base with marks,
        # where what has no width may stand anywhere, or what has no width alone.
        # Beyond the first plane one range stands for all, as a character class is only fast within it.
        low = one(ch for ch in {*self.table, *marks_of, *split_of} if len(ch) == 1 and ch < "\U00010000")
        self.special = re.compile(f"[\r{low}\U00010000-\U0010ffff]+")
        self.joins = re.compile(f"[{zero}{marks}]")
        self.clusters = re.compile(f"\r|[\\s\\S][{zero}{marks}]*")
        self.memo: dict[str, str] = {}

    def cluster(self, text: str) -> str:
        got = self.memo.get(text)
        if got is None:
            form = "".join(self.table.get(ch, ch) for ch in text)
            if len(form) == 1:
                got = unicodedata.normalize("NFC", form)
            else:
                got = self.whole.get(form)
            if got is None:
                apart = unicodedata.normalize("NFD", form)
                got = compose(apart, self.steps) if apart and not unicodedata.combining(apart[0]) and all(map(unicodedata.combining, apart[1:])) else unicodedata.normalize("NFC", form)
            if len(self.memo) < 100_000:
                self.memo[text] = got
        return got

    def runs(self, text: str) -> Iterator[tuple[int, int]]:
        """Where anything may change: runs of special characters, with the base of marks that stand first."""
        last = 0
        for m in self.special.finditer(text):
            a, b = m.span()
            if a > last and self.joins.match(text, a):
                a -= 1
            yield a, b
            last = b

    def __call__(self, text: str) -> str:
        out, last = [], 0
        for a, b in self.runs(text):
            out.append(text[last:a])
            out += [self.cluster(m[0]) if m[0] != "\r" else "" if text[m.end() : m.end() + 1] == "\n" else "\n" for m in self.clusters.finditer(text, a, b)]
            last = b
        if last:
            out.append(text[last:])
            text = "".join(out)
        return LETTERS.sub(one_script, text) if FOREIGN.search(text) else text

    def with_map(self, text: str) -> tuple[str, list[int] | None]:
        """The form, and for each of its characters (and its end) the position in the text; None if nothing changed."""
        out, at, last = [], [], 0
        for a, b in self.runs(text):
            out.append(text[last:a])
            at.extend(range(last, a))
            for m in self.clusters.finditer(text, a, b):
                form = self.cluster(m[0]) if m[0] != "\r" else "" if text[m.end() : m.end() + 1] == "\n" else "\n"
                out.append(form)
                at.extend([m.start()] * len(form))
            last = b
        if last:
            out.append(text[last:])
            at.extend(range(last, len(text) + 1))
            text = "".join(out)
        if FOREIGN.search(text):
            # Letters are folded one by one, so positions hold.
            form = LETTERS.sub(one_script, text)
            return form, at if last else list(range(len(form) + 1)) if form != text else None
        return text, at if last else None


def _runs(codes: list[int]) -> Iterator[tuple[int, int]]:
    start = last = None
    for c in codes:
        if start is None:
            start = last = c
        elif c == last + 1:
            last = c
        else:
            yield start, last
            start = last = c
    if start is not None:
        yield start, last


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def canonical(text: Column) -> Column:
    """The consistent form of a text; null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = transducer()
        for part in parts:
            yield pd.Series([None if x is None else run(x) for x in part], dtype="object")

    return form(text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, form): digests of each text that isn't null and of its form; only they are shuffled."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("x"), canonical(F.col(text_col)).alias("y"))
    return cut(own.select("id", F.unhex(F.sha2("x", 256)).alias("raw"), F.unhex(F.sha2("y", 256)).alias("form")))


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, strings, links): of each row whose text isn't null the class of rows of one form, named by its
    smallest id, the different strings in it, and the rows of it that hold another string. No pair is made."""
    keyed = _keyed(docs, id_col, text_col)
    strings = keyed.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    forms = strings.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("strings"), F.sum("n").alias("rows"))
    each = strings.select("form", "raw", "n").join(forms, "form").select("raw", "class_id", "strings", (F.col("rows") - F.col("n")).alias("links"))
    return salted_join(keyed, each, "raw", F.xxhash64("id"), "inner").select(F.col("id").alias(id_col), "class_id", "strings", "links")


def same_look(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b) with a < b: rows whose texts are different strings of one consistent form. Null texts have no pairs.

    Variants of a form are paired first and their rows joined to the pairs, so copies of one string never meet each
    other, however many there are; the rows of one string are dealt to several partitions.
    """
    keyed = _keyed(docs, id_col, text_col)
    several = keyed.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form", F.lit(True).alias("met"))
    rows = cut(salted_join(keyed, several, "form", F.xxhash64("id"), "inner").drop("met"))
    variants = rows.select("form", "raw").distinct()
    pairs = variants.select("form", F.col("raw").alias("ra")).join(variants.select("form", F.col("raw").alias("rb")), "form").where("ra < rb").select("ra", "rb")
    left = salted_join(rows.select(F.col("raw").alias("ra"), F.col("id").alias("ia")), pairs, "ra", F.xxhash64("ia"), "inner")
    right = rows.select(F.col("raw").alias("rb"), F.col("id").alias("ib"))
    met = salted_join(left, right, "rb", F.xxhash64("ia"), "inner")
    return met.where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()
