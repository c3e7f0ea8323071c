"""Reports over masked tables: figures of each text, counts by tag and source, and sinks that keep clear text apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import ACTIONS, STAGES, THRESHOLDS, TAGS
from ..functions.text import line_number, part
from .edits import placeholder_of
from .spans import lookup

_MASKED = [t for t, action in ACTIONS.items() if action == "mask"]


def figures(text: Column, spans: Column, words: Column, more: tuple[str, ...] = ()) -> Column:
    """struct<chars, masked_chars, share, spans, entries>; share is rounded to three places, 0 for an empty text. more
    names tags of the user's rules."""
    masked = F.aggregate(F.filter(spans, lambda s: s["tag"].isin(*_MASKED, *more)), F.lit(0), lambda a, s: a + (s["end"] - s["start"]))
    chars = F.coalesce(F.length(text), F.lit(0))
    return F.struct(chars.alias("chars"), masked.alias("masked_chars"), F.round(masked / F.greatest(F.lit(1), chars), 3).alias("share"), F.size(spans).alias("spans"), F.coalesce(F.size(F.map_keys(words)), F.lit(0)).alias("entries"))


def findings(df: DataFrame, key: str, text_col: str, spans_col: str, words_col: str, confidence_col: str | None = None) -> DataFrame:
    """(key, tag, start_pos, end_pos, placeholder, plain, source, stage, budget, protected, line): a row for each span, without
    its value, as a report goes further than the dictionary may."""
    t = F.col("s.tag")
    rows = df.select(key, F.col(text_col).alias("_t"), F.col(words_col).alias("_w"), F.explode(spans_col).alias("s"))
    value = part(F.col("_t"), F.col("s.start"), F.col("s.end"))
    plain = lookup(ACTIONS, t, "mask") != "mask"
    budgets, protected = {x.name: x.budget or "" for x in TAGS}, {x.name: x.protected for x in TAGS}
    return rows.select(
        key, t.alias("tag"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.when(~plain, placeholder_of(F.col("_w"), t, value)).alias("placeholder"), plain.alias("plain"), F.col("s.source").alias("source"),
        lookup(STAGES, t, 2).alias("stage"), F.nullif(lookup(budgets, t, ""), F.lit("")).alias("budget"), lookup(protected, t, False).alias("protected"), line_number(F.col("_t"), F.col("s.start")).alias("line"),
    )


def histogram(spans: DataFrame, *by: str) -> DataFrame:
    """(by, n, docs): spans and documents for each value, tag or source."""
    return spans.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def never_seen(spans: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(tag): tags of the contract, or of a list, that no span has."""
    all_ = spans.sparkSession.createDataFrame([(t,) for t in (wanted or list(STAGES))], "tag string")
    return all_.join(spans.select("tag").distinct(), "tag", "left_anti")


def scored_report(scored: DataFrame) -> DataFrame:
    """(tag, least, upper_median, n, threshold) of scored spans."""
    from .evaluate import confidence

    return confidence(scored).withColumn("threshold", lookup(THRESHOLDS, F.col("tag"), None).cast("double"))


def write_report(df: DataFrame, path: str, with_values: bool = False) -> None:
    """Findings as JSON lines; columns that hold clear text are only written if asked for."""
    clear = [c for c in ("text", "value", "original", "dictionary", "masked_value") if c in df.columns]
    (df if with_values else df.drop(*clear)).write.mode("errorifexists").json(path)


def write_dictionary(df: DataFrame, key: str, words_col: str, path: str) -> None:
    """(key, placeholder, value) as JSON lines: always clear text, so it has a folder of its own."""
    df.select(key, F.explode(words_col).alias("placeholder", "value")).write.mode("errorifexists").json(path)


def sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """n rows in the order of the column's md5, the same ones every time; ties by the column."""
    return df.orderBy(F.md5(F.col(column).cast("string")), column).limit(n)
