"""Numbered placeholders, following of names through a document, dictionary, and exact restoration."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import ACTIONS, PROPAGATED
from ..functions.text import bind, part
from . import kernel
from .recognise import NONE, RULES, Recogniser, Rule, in_order, lists_array, spans_array, spans_of

#: A placeholder: tag or user-defined name, number, letter of a variant.
PLACEHOLDER = r"\[[A-Za-z][A-Za-z0-9_]*_[0-9]+[a-z]*\]"
ENTRY = "struct<tag:string,value:string,placeholder:string,start:int,end:int>"
MASKED = f"struct<spans:{NONE},entries:array<{ENTRY}>,masked:string>"
RESULT = f"struct<spans:{NONE},entries:array<{ENTRY}>,masked:string,dropped:array<struct<tag:string,value:string,reason:string>>,widened:int>"


def names_for(excluded: tuple[str, ...] = (), rules: dict[str, Rule] | None = None, labels: dict[str, str] | None = None) -> kernel.Names:
    """Actions, labels and stages of the contract and of the user's rules; excluded tags stay readable, even those of
    rules. Labels of rules must not meet each other or a tag: one placeholder would stand for two values."""
    names = kernel.Names(labels=dict(labels or {}))
    for rule in (rules or {}).values():
        names.actions[rule.tag], names.stages[rule.tag] = "mask", 2
        names.labels[rule.tag] = rule.label or rule.tag
    for tag in excluded:
        names.actions[tag] = "tag_only"
    return names


def _entries(rows: list[list[kernel.Entry]]) -> pa.Array:
    return lists_array(rows, ["tag", "value", "placeholder", "start", "end"], [pa.string()] * 3 + [pa.int32()] * 2)


def propagate(text: Column, spans: Column, tags: tuple[str, ...] = PROPAGATED) -> Column:
    """The spans and every other free place where their values stand as whole words, by start."""

    @F.arrow_udf(NONE)
    def found(texts: pa.Array, own: pa.Array) -> pa.Array:
        return spans_array([kernel.follow(t or "", s, tags) for t, s in zip(texts.to_pylist(), spans_of(own))])

    return found(text, spans)


def masking(text: Column, spans: Column, names: kernel.Names | None = None, follow: bool = True) -> Column:
    """struct<spans, entries, masked>: resolved and followed spans, what is replaced by what, and the text with it. A
    null text has no entries and stays null."""
    own = names or kernel.Names()

    @F.arrow_udf(MASKED)
    def done(texts: pa.Array, given: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        rows = [kernel.masked(t or "", s if t else [], own, follow) for t, s in zip(texts, spans_of(given))]
        return pa.StructArray.from_arrays([spans_array([r[0] for r in rows]), _entries([r[1] for r in rows]), pa.array([None if t is None else r[2] for t, r in zip(texts, rows)], pa.string())], names=["spans", "entries", "masked"])

    return done(text, spans)


def numbered(text: Column, spans: Column, excluded: tuple[str, ...] = (), labels: dict[str, str] | None = None, rules: dict[str, Rule] | None = None) -> Column:
    """array<struct<tag, value, placeholder, start, end>> of the spans to be replaced, in their order; spans are taken as
    they are."""
    own = names_for(excluded, rules, labels)

    @F.arrow_udf(f"array<{ENTRY}>")
    def done(texts: pa.Array, given: pa.Array) -> pa.Array:
        return _entries([kernel.numbered(t or "", s if t else [], own) for t, s in zip(texts.to_pylist(), spans_of(given))])

    return done(text, spans)


def replaced(text: Column, entries: Column) -> Column:
    """The text with each entry's place replaced by its placeholder, from left to right."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(entries, start, lambda a, e: F.struct(e["end"].alias("at"), F.concat(a["out"], part(text, a["at"], e["start"]), e["placeholder"]).alias("out")))
    return bind(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def dictionary(entries: Column) -> Column:
    return F.map_from_entries(F.array_distinct(F.transform(entries, lambda e: F.struct(e["placeholder"], e["value"]))))


def _shown(df: DataFrame, keep_dictionary: bool, more: tuple[str, ...] = ()) -> DataFrame:
    words = dictionary(F.col("_r.entries")) if keep_dictionary else F.create_map().cast("map<string,string>")
    out = df.withColumn("masked", F.col("_r.masked")).withColumn("dictionary", words).withColumn("masked_spans", F.col("_r.spans"))
    for name in more:
        out = out.withColumn(name, F.col(f"_r.{name}"))
    return out.drop("_r")


def mask_table(df: DataFrame, text_col: str, spans_col: str, excluded: tuple[str, ...] = (), keep_dictionary: bool = True, follow: bool = True, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The table with masked, dictionary and masked_spans, in one pass over its texts. Null texts stay null; their
    dictionary is empty. Spans of the user's rules (tags X_...) are replaced under the rules' placeholders."""
    spans = F.coalesce(F.col(spans_col).cast(NONE), F.array().cast(NONE))
    return _shown(df.withColumn("_r", masking(F.col(text_col), spans, names_for(excluded, rules), follow)), keep_dictionary)


def filter_texts(
    df: DataFrame, text_col: str, scored_col: str | None = None, rules: dict[str, Rule] | None = None, thresholds: dict[str, float] | None = None,
    excluded: tuple[str, ...] = (), keep_dictionary: bool = True, follow: bool = True,
) -> DataFrame:
    """The whole chain in one pass over the texts: recognise, apply the user's rules, merge with the scored spans of a
    model, mask.

    scored_col, if any, holds array<struct<tag, start, end, score>>. The table comes back with masked, dictionary,
    masked_spans, dropped (scored spans that were left out, with the reason) and widened. Null texts stay null.
    """
    own, names = rules or {}, names_for(excluded, rules)
    made: list[tuple[Recogniser, Recogniser | None]] = []

    @F.arrow_udf(RESULT)
    def done(texts: pa.Array, scored: pa.Array) -> pa.Array:
        if not made:
            made.append((Recogniser(RULES), Recogniser(own, iban=False) if own else None))
        rows, kinds = [], texts.to_pylist()
        for text, given in zip(kinds, scored.to_pylist()):
            text = text or ""
            found = made[0][0](text) + (made[0][1](text) if made[0][1] else [])
            model = [(s["tag"], s["start"], s["end"], s["score"]) for s in given or () if s is not None and 0 <= s["start"] < s["end"] <= len(text)]
            spans, dropped, widened = kernel.merge(text, model, found, thresholds)
            rows.append((*kernel.masked(text, spans, names, follow), dropped, widened))
        return pa.StructArray.from_arrays([
            spans_array([r[0] for r in rows]), _entries([r[1] for r in rows]), pa.array([None if t is None else r[2] for t, r in zip(kinds, rows)], pa.string()),
            lists_array([r[3] for r in rows], ["tag", "value", "reason"], [pa.string()] * 3), pa.array([r[4] for r in rows], pa.int32()),
        ], names=["spans", "entries", "masked", "dropped", "widened"])

    kind = "array<struct<tag:string,start:int,end:int,score:double>>"
    scored = F.col(scored_col).cast(kind) if scored_col else F.lit(None).cast(kind)
    return _shown(df.withColumn("_r", done(F.col(text_col), scored)), keep_dictionary, ("dropped", "widened"))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def restore(text: Column, words: Column, strict: bool = False) -> Column:
    """Placeholders replaced by their values in one pass; unknown ones, and those with a null value, stay. With strict
    they raise. A null dictionary restores nothing."""
    found, gaps = placeholders(text), F.split(text, PLACEHOLDER, -1)
    known = F.coalesce(words, F.create_map().cast("map<string,string>"))

    def value(p: Column) -> Column:
        got = F.element_at(known, p)
        return F.coalesce(got, F.raise_error(F.concat(F.lit("unknown placeholder: "), p))) if strict else F.coalesce(got, p)

    whole = F.concat(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("p")), lambda x: F.concat(x["g"], F.coalesce(F.when(x["p"].isNotNull(), value(x["p"])), F.lit("")))))
    return F.array_join(whole, "")


def restore_report(text: Column, words: Column) -> Column:
    """struct<restored, missing, hints>: distinct placeholders with a value, those without, and for those the known
    placeholder that differs in case only."""
    known = F.coalesce(words, F.create_map().cast("map<string,string>"))
    distinct = F.array_distinct(placeholders(text))

    def report(ps: Column) -> Column:
        missing = F.filter(ps, lambda p: F.element_at(known, p).isNull())
        lower = F.map_keys(known)
        hints = F.flatten(F.transform(missing, lambda p: F.filter(lower, lambda k: (F.lower(k) == F.lower(p)) & (k != p))))
        return F.struct((F.size(ps) - F.size(missing)).alias("restored"), missing.alias("missing"), hints.alias("hints"))

    return bind(distinct, report)


def unescaped(text: Column) -> Column:
    r"""Markdown escapes inside placeholders undone: \[NAME\_1\] is [NAME_1]."""
    return F.regexp_replace(F.regexp_replace(text, r"\\\[([A-Za-z][A-Za-z0-9]*(?:\\?_[A-Za-z0-9]+)*)\\\]", "[$1]"), r"(\[[A-Za-z0-9_]*)\\_", "$1_")


def as_markup(text: Column, spans: Column) -> Column:
    """Spans written into the text as [[TAG:value]]."""
    entries = F.transform(in_order(spans), lambda s: F.struct(s["tag"].alias("tag"), F.lit("").alias("value"), F.concat(F.lit("[["), s["tag"], F.lit(":"), part(text, s["start"], s["end"]), F.lit("]]")).alias("placeholder"), s["start"].alias("start"), s["end"].alias("end")))
    return replaced(text, entries)


def from_markup(marked: DataFrame, text_col: str) -> DataFrame:
    """(.., text, spans, findings) of texts with [[TAG:value]]; unknown tags, empty values and open brackets are found."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part_ in parts:
            rows = [_parsed(x) for x in part_[text_col]]
            yield part_.drop(columns=[text_col]).assign(text=[r[0] for r in rows], spans=[r[1] for r in rows], findings=[r[2] for r in rows])

    keys = ", ".join(f"`{n}` {t}" for n, t in marked.dtypes if n != text_col)
    return marked.mapInPandas(run, f"{keys}, text string, spans array<struct<tag:string,start:int,end:int>>, findings array<string>")


def _parsed(text: str | None) -> tuple[str | None, list[dict], list[str]]:
    if text is None:
        return None, [], []
    out, spans, findings, last = "", [], [], 0
    for m in re.finditer(r"\[\[([A-Za-z_0-9]+):(.*?)\]\]", text, re.S):
        out += text[last : m.start()]
        if m[1] not in ACTIONS:
            findings.append(f"unknown tag {m[1]}")
        if not m[2].strip():
            findings.append(f"empty value of {m[1]}")
        spans.append({"tag": m[1], "start": len(out), "end": len(out) + len(m[2])})
        out += m[2]
        last = m.end()
    out += text[last:]
    if "[[" in out or "]]" in out:
        findings.append("open brackets")
    return out, spans, findings
