"""Shared by the operators of this package: table access, parallelism, lineage cuts and label spelling."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = ("de", "fr", "it", "en", "es")

# The ways in which tables spell the five languages.
LABELS = {
    "de": ("de", "deu", "ger", "deutsch", "german", "allemand", "tedesco", "alemán"),
    "fr": ("fr", "fra", "fre", "français", "francais", "french", "französisch", "francese"),
    "it": ("it", "ita", "italiano", "italian", "italienisch", "italien"),
    "en": ("en", "eng", "english", "englisch", "anglais", "inglese", "inglés"),
    "es": ("es", "spa", "esp", "español", "espanol", "spanish", "spanisch", "espagnol", "castellano"),
}
_PLAIN = {form: lang for lang, forms in LABELS.items() for form in forms}


def label_of(raw: str | None) -> str | None:
    """The language a label names, whatever its spelling; None if it names none of the five."""
    if raw is None:
        return None
    head = re.split(r"[-_@. ]", raw.strip().lower())[0]
    return _PLAIN.get(head)


def label_col(raw: Column) -> Column:
    """label_of as an expression."""
    head = F.split(F.lower(F.trim(raw)), r"[-_@. ]")[0]
    table = F.create_map(*[F.lit(x) for pair in _PLAIN.items() for x in pair])
    return F.element_at(table, head)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """At least as many partitions as the session has cores: a single small file else keeps all work in one task."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names, or in one of our own where none is named."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return df.checkpoint(eager=True)


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the newest version; a null version is the oldest. Combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(key).agg(F.max_by(row, F.struct(version)).alias("_row")).select(
        key, *[F.col("_row")[c].alias(c) for c in rest]
    )


def hash_sample(df: DataFrame, column: str, rows: int, of: int) -> DataFrame:
    """At most rows rows of df, which has about `of`, by hash order of a column, each value of it once. A threshold on the
    hash leaves about twice the rows, and copies are put together, before anything is sorted."""
    h = F.xxhash64(column)
    if of > 4 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * rows / of))
    return df.dropDuplicates([column]).orderBy(h).limit(rows)


def text_sample(df: DataFrame, column: str, rows: int, chars: int, by: str | None = None) -> dict[str, list[str]]:
    """Distinct texts for a fit on the driver, under the value of `by` (or ""): of each value at most so many, by hash
    order, and so many characters in all; texts are taken whole, and one that would exceed the characters is passed over.

    Hashes alone are counted over all rows. A threshold on them leaves about twice the rows, whatever the size of the
    table, and copies of a text are put together before anything is sent.
    """
    own = df.where(F.length(column) > 0).select((F.col(by) if by else F.lit("")).alias("_by"), F.col(column).alias("_x"), F.xxhash64(column).alias("_h"))
    kinds = {r["_by"]: r["n"] for r in own.groupBy("_by").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    if not kinds:
        return {}
    top = 1 << 30
    parts = {k: min(top, int(top * 2 * rows / max(1, n))) for k, n in kinds.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("_by"))
    some = own.where(F.pmod("_h", F.lit(top)) < limit)
    sizes = some.groupBy("_by", "_h").agg(F.first(F.length("_x")).alias("n"))
    chosen: dict[str, list[int]] = {k: [] for k in kinds}
    spent = dict.fromkeys(kinds, 0)
    for r in sorted(sizes.collect(), key=lambda r: r["_h"] & 0xFFFFFFFFFFFFFFFF):
        k = r["_by"]
        if len(chosen[k]) < rows and spent[k] + r["n"] <= chars:
            chosen[k].append(r["_h"])
            spent[k] += r["n"]
    wanted = [(k, h) for k, hs in chosen.items() for h in hs]
    if not wanted:
        return {k: [] for k in kinds}
    pick = F.broadcast(df.sparkSession.createDataFrame(wanted, "_by string, _h bigint"))  # rows x kinds at most
    got = some.join(pick, ["_by", "_h"], "left_semi").groupBy("_by", "_h").agg(F.first("_x").alias("_x")).collect()
    out: dict[str, list[str]] = {k: [] for k in kinds}
    for r in sorted(got, key=lambda r: r["_h"] & 0xFFFFFFFFFFFFFFFF):
        out[r["_by"]].append(r["_x"])
    return out


#: Partitions that the rows of one key are dealt to.
SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, keys: str | list[str], salt: Column, how: str = "left") -> DataFrame:
    """A join of a table in which one key may hold most rows with a smaller one: the rows of a key go to SALTS partitions
    by the salt, and the other side comes once for each."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [keys, "_salt"] if isinstance(keys, str) else [*keys, "_salt"]
    return many.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(copies, on, how).drop("_salt")


def stacked(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of some tables of the same columns."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
