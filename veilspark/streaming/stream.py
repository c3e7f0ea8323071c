"""The same expressions on streams. Masking is stateless; the rate of details per event-time window is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mask import mask_table
from ..operators.recognise import recognised


def masked_stream(texts: DataFrame, text_col: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """A stream with masked text and dictionary; each row is masked by itself, without state."""
    return mask_table(texts.withColumn("_found", recognised(text_col, names, iban=names is None)), text_col, "_found").drop("_found", "masked_spans")


def details_per_window(events: DataFrame, time_col: str, text_col: str, width: str = "1 hour", late: str = "2 hours", names: tuple[str, ...] = ("EMAIL", "PHONE")) -> DataFrame:
    """(window_start, tag, details) by event time; rows later than the watermark are left out. Works on streams and on
    tables."""
    found = events.withColumn("_found", recognised(text_col, names, iban=False))
    if events.isStreaming:
        found = found.withWatermark(time_col, late)
    rows = found.select(time_col, F.explode(F.transform("_found", lambda s: s["tag"])).alias("tag"))
    return rows.groupBy(F.window(time_col, width), "tag").agg(F.count("*").alias("details")).select(F.col("window.start").alias("window_start"), "tag", "details")
