"""Span algebra on arrays of spans: overlap exclusion, coalescing, thresholds, widening, merging of sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import part
from . import kernel
from .recognise import NONE, lists_array, spans_array, spans_of


def lookup(table: dict, key: Column, default) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key), F.lit(default))


def resolve(spans: Column) -> Column:
    """Non-overlapping spans, lower stage first, then longest, then in the given order; unknown tags come last, and empty
    spans are left out."""

    @F.arrow_udf(NONE)
    def done(own: pa.Array) -> pa.Array:
        return spans_array([kernel.resolve(s) for s in spans_of(own)])

    return done(spans)


def coalesce(intervals: Column, touching: bool = True) -> Column:
    """array<struct<start, end>> of united intervals; with touching, neighbours without a gap are united, too."""
    kind = "array<struct<start:int,end:int>>"
    ordered = F.array_sort(F.transform(intervals, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = (s["start"] <= last["end"]) if touching else (s["start"] < last["end"])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(meets, grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast(kind), step)


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The same for spans in rows: (keys, start, end) of each island, by one window over each key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", (F.coalesce(F.col(start) > reach, F.lit(True))).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return flagged.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covers(intervals: Column, start: Column, end: Column) -> Column:
    """Whether one interval holds the whole of [start, end); coalesce first."""
    return F.exists(intervals, lambda s: (s["start"] <= start) & (s["end"] >= end))


def free(intervals: Column, start: Column, end: Column) -> Column:
    return ~F.exists(intervals, lambda s: (s["start"] < end) & (start < s["end"]))


_WORD_END, _WORD_START = r"[\p{L}\p{N}_'’]*$", r"^[\p{L}\p{N}_'’]*"


def widen(text: Column, start: Column, end: Column, most: int = 50) -> Column:
    """struct<start, end> moved out to word boundaries, by so many signs at most, where the edge lies inside a word."""
    inside = F.regexp_count(F.concat(F.substring(text, start, F.lit(2))), F.lit(r"^[\p{L}\p{N}_'’]{2}$"))
    left = F.when((start > 0) & (inside == 1), F.length(F.regexp_extract(part(text, F.greatest(start - most, F.lit(0)), start), _WORD_END, 0))).otherwise(0)
    outside = F.regexp_count(F.substring(text, end, F.lit(2)), F.lit(r"^[\p{L}\p{N}_'’]{2}$"))
    right = F.when(outside == 1, F.length(F.regexp_extract(F.substring(text, end + 1, F.lit(most)), _WORD_START, 0))).otherwise(0)
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


def merge(text: Column, scored: Column, found: Column, thresholds: dict[str, float] | None = None) -> Column:
    """struct<spans, dropped, widened> from model spans (tag, start, end, score) and recognised spans; the rules are those
    of kernel.merge."""
    kind = f"struct<spans:{NONE},dropped:array<struct<tag:string,value:string,reason:string>>,widened:int>"

    @F.arrow_udf(kind)
    def done(texts: pa.Array, given: pa.Array, own: pa.Array) -> pa.Array:
        rows = []
        for t, sc, s in zip(texts.to_pylist(), given.to_pylist(), spans_of(own)):
            rows.append(kernel.merge(t or "", [(x["tag"], x["start"], x["end"], x["score"]) for x in sc or () if x is not None], s, thresholds))
        return pa.StructArray.from_arrays([spans_array([r[0] for r in rows]), lists_array([r[1] for r in rows], ["tag", "value", "reason"], [pa.string()] * 3), pa.array([r[2] for r in rows], pa.int32())], names=["spans", "dropped", "widened"])

    return done(text, scored, found)
