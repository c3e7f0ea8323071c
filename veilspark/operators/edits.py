"""Edits of masked texts and of gold: broken placeholders, leftovers, manual masks, replacement with shifted spans."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .mask import PLACEHOLDER
from .recognise import lists_array

# A placeholder as it may come back from elsewhere, with escaped signs; and one whose opening bracket is gone.
ESCAPED = re.compile(r"\\?\[([A-Za-z][A-Za-z0-9_\\]*?)\\?_(\d+)([a-z]?)\\?\]")
BROKEN = re.compile(r"(?:(?<=[^\[\\])|^)\\?([A-Z][A-Z0-9_]*?)\\?_(\d+)([a-z]?)\]", re.M)
_GOOD = re.compile(PLACEHOLDER)


def unescaped_text(text: str) -> str:
    """Markdown escapes undone, inside placeholders only."""
    return ESCAPED.sub(lambda m: f"[{m[1].replace(chr(92), '')}_{m[2]}{m[3]}]", text)


def repaired_text(text: str, known: set[str]) -> tuple[str, list[str]]:
    """(text, placeholders that were mended): an opening bracket is added where the dictionary knows the placeholder, and
    nowhere else."""
    done: dict[str, None] = {}

    def mend(m: re.Match) -> str:
        name = f"[{m[1].replace(chr(92), '')}_{m[2]}{m[3]}]"
        if name not in known:
            return m[0]
        done[name] = None
        return name

    return BROKEN.sub(mend, text), list(done)


def leftovers_of(text: str) -> list[str]:
    """What looks like a placeholder and is none, in order of appearance."""
    good = set(_GOOD.findall(text))
    return list(dict.fromkeys(m[0] for m in ESCAPED.finditer(text) if m[0] not in good))


def repaired(text: Column, words: Column) -> Column:
    """struct<text, mended>: escapes undone, then broken placeholders mended as far as the dictionary confirms them. Null
    texts stay null; a null dictionary confirms none."""

    @F.arrow_udf("struct<text:string,mended:array<string>>")
    def done(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = [(None, []) if t is None else repaired_text(unescaped_text(t), set(k or ())) for t, k in zip(texts.to_pylist(), keys.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["text", "mended"])

    return done(text, F.map_keys(words))


def leftovers(text: Column) -> Column:
    """array<string> of signs that look like a placeholder and are none; nothing is repaired. Null texts have none."""

    @F.arrow_udf("array<string>")
    def done(texts: pa.Array) -> pa.Array:
        return pa.array([leftovers_of(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return done(text)


def next_placeholder(words: Column, tag: Column) -> Column:
    """The first placeholder of a tag that the dictionary doesn't hold."""
    own = F.filter(F.transform(F.map_keys(F.coalesce(words, F.create_map().cast("map<string,string>"))), lambda k: F.when(k.startswith(F.concat(F.lit("["), tag, F.lit("_"))), F.regexp_extract(k, r"_([0-9]+)\]$", 1).try_cast("int"))), lambda n: n.isNotNull())
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(own) + 1), own))
    return F.concat(F.lit("["), tag, F.lit("_"), free.cast("string"), F.lit("]"))


EDITED = "struct<text string, dictionary map<string,string>>"


def _edited(text: Column, words: Column) -> Column:
    return F.struct(text.alias("text"), words.alias("dictionary"))


def _known(words: Column) -> Column:
    return F.coalesce(words, F.create_map().cast("map<string,string>"))


def unmasked(text: Column, words: Column, placeholder: Column) -> Column:
    """struct<text, dictionary> with one placeholder taken back everywhere; an unknown one changes nothing."""
    value = F.element_at(_known(words), placeholder)
    return _edited(F.when(value.isNull(), text).otherwise(F.replace(text, placeholder, value)), F.map_filter(_known(words), lambda k, v: value.isNull() | (k != placeholder)))


def masked_value(text: Column, words: Column, value: Column, tag: Column) -> Column:
    """struct<text, dictionary> with a value masked wherever it stands as whole words, under the next free placeholder of
    the tag; a value that stands nowhere, or is empty, changes nothing."""
    name = next_placeholder(words, tag)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    there = (F.length(value) > 0) & F.regexp(text, pattern)
    changed = F.regexp_replace(text, pattern, F.regexp_replace(name, F.lit(r"([\\$])"), F.lit(r"\\$1")))
    return _edited(F.when(there, changed).otherwise(text), F.when(there, F.map_concat(_known(words), F.map_from_arrays(F.array(name), F.array(value)))).otherwise(_known(words)))


def retagged(text: Column, words: Column, placeholder: Column, tag: Column) -> Column:
    """struct<text, dictionary> with one placeholder given to another tag under its next free number; an unknown one
    changes nothing."""
    value, name = F.element_at(_known(words), placeholder), next_placeholder(words, tag)
    rest = F.map_filter(_known(words), lambda k, v: k != placeholder)
    return _edited(F.when(value.isNull(), text).otherwise(F.replace(text, placeholder, name)), F.when(value.isNull(), _known(words)).otherwise(F.map_concat(rest, F.map_from_arrays(F.array(name), F.array(value)))))


def placeholder_of(words: Column, prefix: Column, value: Column) -> Column:
    """The first placeholder of a tag that stands for a value; null if there is none."""
    own = F.filter(F.map_entries(_known(words)), lambda e: (e["value"] == value) & (F.regexp_extract(e["key"], r"^\[(.*)_[^_]*$", 1) == prefix))
    return F.get(F.transform(own, lambda e: e["key"]), F.lit(0))


Place = tuple[str, int, int]


def shifted(text: str, spans: list[Place], pairs: list[tuple[str, str]]) -> tuple[str, list[Place], list[str]]:
    """(text, spans, findings) after each old value is replaced by a new one, one pair after the other. Later spans move,
    spans around a place grow or shrink; a span that a place overlaps by half raises, as its edge would be a guess."""
    found = []
    for old, new in pairs:
        if not old:
            raise ValueError("nothing to replace")
        places, at = [], text.find(old)
        while at >= 0:
            places.append(at)
            at = text.find(old, at + len(old))
        if not places:
            found.append(f"not found: {old}")
            continue
        for tag, a, b in spans:
            for p in places:
                if a < p < b < p + len(old) or p < a < p + len(old) < b:
                    raise ValueError(f"{tag} [{a}:{b}] overlaps [{p}:{p + len(old)}] by half")
        by = len(new) - len(old)
        spans = [(tag, a + by * sum(p + len(old) <= a for p in places), b + by * sum(p < b for p in places)) for tag, a, b in spans]
        text = text.replace(old, new)
        found.append(f"{old} -> {new}, {len(places)}x, {by:+d}")
    return text, spans, found


def replace_in_gold(text: Column, spans: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct<text, spans, findings> of gold with values replaced; see shifted. Null texts stay null."""

    @F.arrow_udf("struct<text:string,spans:array<struct<tag:string,start:int,end:int>>,findings:array<string>>")
    def done(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(texts.to_pylist(), own.to_pylist()):
            places = [(x["tag"], x["start"], x["end"]) for x in s or () if x is not None]
            rows.append((None, places, []) if t is None else shifted(t, places, pairs))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), lists_array([r[1] for r in rows], ["tag", "start", "end"], [pa.string(), pa.int32(), pa.int32()]), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["text", "spans", "findings"])

    return done(text, F.transform(spans, lambda s: F.struct(s["tag"].alias("tag"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))


def open_cases(suspicious: Column) -> Column:
    """Of the finds of suspicion.suspicious those that bar a text from becoming gold: single words, of which most are no
    names, are left out."""
    return F.filter(suspicious, lambda s: (s["kind"] != "Grossschreibung") | s["value"].contains(" "))
