"""Text expressions: positions of matches in code points, lines, snippets, HTML, sort keys, hash zones."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


MATCHES = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, positions in code points, half-open. In Arrow batches: the
    work is one reading of the text, where an expression would copy what it has found for every match. Null stays null."""
    compiled = re.compile(pattern)

    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"start": m.start(), "end": m.end(), "value": m[0]} for m in compiled.finditer(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])))

    return found(text)


def part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def line_number(text: Column, position: Column) -> Column:
    """1-based line of a position."""
    before = F.substring(text, F.lit(1), position)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, start: Column, end: Column, width: int = 28) -> Column:
    """The value in » « with its surroundings, line ends shown."""
    left = F.greatest(start - width, F.lit(0))
    shown = F.concat(part(text, left, start), F.lit("»"), part(text, start, end), F.lit("«"), F.substring(text, end + 1, F.lit(width)))
    return F.replace(shown, F.lit("\n"), F.lit("⏎"))


# Elements whose end is a line end.
BLOCKS = "p|div|tr|li|h[1-6]|table|blockquote"
_SCRIPT, _BLOCK, _TAG = re.compile(r"(?is)<(script|style)\b.*?</\1>"), re.compile(rf"(?i)</(?:{BLOCKS})>"), re.compile(r"<[^>]+>")


def html_text(page: str) -> str:
    """Script and style dropped, block ends as line ends, other tags as blanks, entities written out, blanks and empty
    lines squeezed."""
    plain = unescape(_TAG.sub(" ", _BLOCK.sub("\n", _SCRIPT.sub(" ", page))))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", plain)).strip()


def html_to_text(page: Column) -> Column:
    """html_text as a column, in Arrow batches: the entities are those of the standard, some two thousand. Null stays null."""

    @F.arrow_udf("string")
    def done(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html_text(x) for x in pages.to_pylist()], pa.string())

    return done(page)


def plain_key(name: Column) -> Column:
    """Sort key without diacritics, in lower case."""
    marked = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return F.translate(F.lower(name), "".join(marked), "".join(unicodedata.normalize("NFD", c)[0].lower() for c in marked))


def zone(name: Column, parts: int = 10) -> Column:
    """0 .. parts-1 from the first 32 bits of the sha256; zone 0 is held out."""
    return (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint") % parts).cast("int")


def decoded(body: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1; a byte order mark is dropped."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(body.cast("string")), F.decode(body, "ISO-8859-1")), "^\\uFEFF", "")


# Signs that no text holds, the length of a block and the share of such signs that makes it binary, and how
# far before the cut the begin of the binary part is looked for.
UNREADABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")
BLOCK, SHARE, LOOK_BACK = 200, 0.2, 120


def readable_part(text: str) -> tuple[str, int]:
    """(text up to its binary tail, signs that are left out): cut at the first unreadable sign of the first block that is
    binary, and further back as long as two unreadable signs or more lie in the stretch before the cut."""
    for at in range(0, len(text), BLOCK):
        bad = [m.start() for m in UNREADABLE.finditer(text, at, min(len(text), at + BLOCK))]
        if len(bad) > SHARE * min(BLOCK, len(text) - at):
            cut = bad[0]
            while len(before := [m.start() for m in UNREADABLE.finditer(text, max(0, cut - LOOK_BACK), cut)]) >= 2:
                cut = before[0]
            return text[:cut].rstrip(), len(text) - cut
    return text, 0


def without_binary_tail(text: Column) -> Column:
    """readable_part as a column; null stays null."""

    @F.arrow_udf("string")
    def done(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else readable_part(x)[0] for x in texts.to_pylist()], pa.string())

    return done(text)


# Names of the months, in order.
MONTHS = {
    "de": ("Januar", "Februar", "Maerz", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "it": ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}


def date_shown(day: Column, lang: Column, style: Column) -> Column:
    """A date in one of three spellings: 0 as 05.03.2021, 1 with the month written in the language (others count as
    German), 2 as 0, in English as 2021-03-05."""
    names = F.create_map(*[F.lit(x) for lang_, own in MONTHS.items() for x in (lang_, "|".join(own))])
    own = F.coalesce(F.element_at(names, lang), F.lit("|".join(MONTHS["de"])))
    month = F.element_at(F.split(own, "[|]"), F.month(day))
    stop = F.when(lang.isin("fr", "it", "en"), " ").otherwise(". ")
    dotted = F.date_format(day, "dd.MM.yyyy")
    written = F.concat(F.dayofmonth(day).cast("string"), stop, month, F.lit(" "), F.year(day).cast("string"))
    return F.when(style == 0, dotted).when(style == 1, written).when(lang == "en", F.date_format(day, "yyyy-MM-dd")).otherwise(dotted)


# What announces a date of birth.
BIRTH = ("geboren am", "geboren", "geburtsdatum", "geb", "né le", "née le", "date de naissance", "naissance", "nato il", "nata il", "data di nascita", "born on", "date of birth")


def announces_birth(before: Column) -> Column:
    """Whether the last forty signs of the sentence that ends a text announce a date of birth."""
    tail = F.regexp_extract(before, r"[^.\n;]*$", 0)
    near = F.lower(F.substring(tail, F.greatest(F.length(tail) - 39, F.lit(1)), F.lit(40)))
    return F.regexp_replace(near, r"(?U)[^\w\s]", " ").rlike(r"(?U)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in BIRTH) + r")\b")


def marked(template: Column, *values: Column) -> Column:
    """A message with each {} filled in turn; values beyond the last {} are left out."""
    parts = F.split(template, r"\{\}", -1)
    filled = F.zip_with(parts, F.array(*[v.cast("string") for v in values]), lambda p, v: F.concat(F.coalesce(p, F.lit("")), F.when(p.isNotNull(), F.coalesce(v, F.lit(""))).otherwise("")))
    return F.when(F.size(parts) > len(values), F.array_join(filled, "")).otherwise(F.concat(F.array_join(F.slice(filled, 1, F.size(parts) - 1), ""), F.element_at(parts, -1)))
