"""The queries of the training-data problems; each runs its operator over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical, chunking, language, mixing, packing, personal, residue, scans, splits
from .common import label_col, latest, stacked, spread, table
from .tokens import token_count

SEED = 7
# Shares of the splits.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _limits(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(F.col("purpose") == purpose).first()
    return int(row["max_tokens"]), int(row["overlap_tokens"] or 0)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", token_count(F.col("text")).alias("tokens"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split(table(spark, d, "examples"), table(spark, d, "templates"), SHARES, SEED)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = splits.groups(table(spark, d, "examples"), table(spark, d, "templates"))
    return rows.where("group_key is not null").select("example_id", "group_key")


def _texts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Texts of documents and examples as (tbl, rec_id, text, ...); re-delivered examples once, by their id and text."""
    docs = spread(table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text", *more))
    return docs.unionByName(_examples(spark, d, *more).select(F.lit("examples").alias("tbl"), F.col("example_id").alias("rec_id"), "text", *more))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    labelled = stacked(table(spark, d, t).select("text", "lang") for t in ("templates", "documents", "examples"))
    return language.segments(_texts(spark, d, "lang").withColumnRenamed("lang", "label"), language.fit(labelled), ["tbl", "rec_id", "label"], "text")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.documents(_segments(spark, d).drop("label"), ["tbl", "rec_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    full = _segments(spark, d).where(F.col("full") & ~F.col("lang").eqNullSafe(label_col(F.col("label"))))
    return full.select("tbl", "rec_id", "lang").distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = scans.decisions(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return found.select("doc_id", "kind", "piece").distinct()


def _finder(spark: SparkSession, d: str) -> personal.Finder:
    return personal.fit(table(spark, d, "examples"), table(spark, d, "name_weights"))


def _readable(spark: SparkSession, d: str) -> DataFrame:
    masks = spread(table(spark, d, "mask_results").select(F.lit("mask_results").alias("tbl"), F.col("mask_id").alias("rec_id"), "text"))
    return _texts(spark, d).unionByName(masks)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.details(_readable(spark, d), _finder(spark, d), ["tbl", "rec_id"], "text").drop("score")


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.masked(_readable(spark, d), _finder(spark, d), ["tbl", "rec_id"], "text")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", canonical.canonical(F.col("text")).alias("text"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.classes(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = canonical.same_look(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return found.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def _examples(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Examples, each once."""
    rows = table(spark, d, "examples").select("example_id", "text", *more, "geladen_am")
    return latest(rows, "example_id", "geladen_am").drop("geladen_am")


def p6_marked(spark: SparkSession, d: str) -> DataFrame:
    return residue.mark_residue(_examples(spark, d), table(spark, d, "templates"), "example_id", "text", table(spark, d, "examples").select("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_marked(spark, d).where("residue").select("example_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limits(spark, d, "container")
    return packing.pack(_sized(spark, d), "doc_id", "tokens", capacity)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).where("piece_no > 0").select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limits(spark, d, "container")
    return packing.fill_report(p7_containers(spark, d), capacity)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.mix(docs, table(spark, d, "mix_targets"), "doc_id", "source", token_count(F.col("text")), seed=SEED)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where(~F.col("reachable")).select("source")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limits(spark, d, "window")
    return chunking.chunk(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", limit, overlap)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece_no = 1").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None of the problems can be stated in SQL at this size; tests/llm holds them against brute force."""
    return {}
