"""Lists of names, places and organisations from registers: normal form, building, fingerprints, sizes that never shrink."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_key


def normal(value: Column) -> Column:
    """Composed letters, no white space at the edges and single blanks inside; null stays null."""

    @F.arrow_udf("string")
    def done(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else " ".join(unicodedata.normalize("NFC", v).split()) for v in values.to_pylist()], pa.string())

    return done(value)


def built(rows: DataFrame, name: str = "name") -> DataFrame:
    """Distinct rows with a normal, not empty name, in the order of a list: by the name without diacritics, then the name."""
    own = rows.withColumn(name, normal(F.col(name))).where(F.length(name) > 0).distinct()
    return own.orderBy(plain_key(F.col(name)), name)


def write_list(rows: DataFrame, path: str, tag: str, source: str = "") -> None:
    """A built list as JSON lines, and beside it one line about it: tag, source, count and fingerprint. Parts are sorted
    within and follow each other, so the same rows give the same list."""
    own = built(rows)
    own.write.mode("errorifexists").json(f"{path}/entries")
    about = fingerprint(rows).withColumn("tag", F.lit(tag)).withColumn("source", F.lit(source))
    about.coalesce(1).write.mode("errorifexists").json(f"{path}/meta")


def fingerprint(rows: DataFrame, name: str = "name") -> DataFrame:
    """(n, fingerprint) of a list's values, whatever their order: sixteen hexadecimal digits. The values are digested in
    4,096 groups and the digests once more, so no task sees them all."""
    own = rows.withColumn(name, normal(F.col(name))).where(F.length(name) > 0).select(F.to_json(F.struct(*sorted(rows.columns))).alias("v")).distinct()
    # Sums of digests are the same in any order and combine before they are shuffled.
    digits = lambda at: F.sum(F.conv(F.substring(F.sha2("v", 256), at, 12), 16, 10).cast("decimal(38,0)"))
    parts = own.agg(F.count("*").alias("n"), *[digits(1 + 12 * k).alias(f"d{k}") for k in range(5)])
    return parts.select("n", F.substring(F.sha2(F.concat_ws("|", "n", *[f"d{k}" for k in range(5)]), 256), 1, 16).alias("fingerprint"))


def checked_size(n: int, least: int | None) -> int:
    """The new high-water mark of a source that only grows; a smaller one is an incomplete copy and raises."""
    if least is not None and n < least:
        raise ValueError(f"{n} entries, {least} before: the source only grows")
    return max(n, least or 0)


# Fixed value: a postcode and its place, up to the next pair.
PAIR = r"([0-9]{4})\s+([^,;]+?)(?=\s*[,;]\s*[0-9]{4}|\s*$)"


def addresses(streets: DataFrame, name: str = "street_name", label: str = "zip_label", municipality: str = "municipality") -> DataFrame:
    """(name, plz, city, municipality): a row for each pair of postcode and place in a street's label, such as "4500 Solothurn,
    4528 Zuchwil"; a label without a pair gives one row as it stands. Streets without a name are left out."""
    text = F.coalesce(F.col(label), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)).alias("plz"), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)).alias("city"))
    town = F.trim(F.coalesce(F.col(municipality), F.lit("")))
    alone = F.array(F.struct(F.trim(text).alias("plz"), town.alias("city")))
    rows = streets.where(F.length(name) > 0).withColumn("_p", F.explode(F.when(F.size(pairs) > 0, pairs).otherwise(alone)))
    return rows.select(F.col(name).alias("name"), F.trim("_p.plz").alias("plz"), F.trim("_p.city").alias("city"), town.alias("municipality"))


def weighted_names(rows: DataFrame, name: str, weight: str, period: str | None = None) -> DataFrame:
    """(name, weight) of the newest period, or of all rows, summed; thousands marks are dropped and weights that aren't
    numbers count as 0."""
    own = rows
    if period:
        own = rows.join(F.broadcast(rows.agg(F.max(period).alias(period))), period, "left_semi")  # one row
    number = F.regexp_replace(F.col(weight).cast("string"), "['’\\u00a0 ]", "").try_cast("bigint")
    return own.withColumn("name", normal(F.col(name))).where(F.length("name") > 0).groupBy("name").agg(F.sum(F.coalesce(number, F.lit(0))).alias("weight"))


def combined(first: list[str], middle: list[str], last: list[str]) -> Column:
    """Invented names of every first, middle and last part, one number each; explode sequence(0, size - 1) to list them."""
    pick = lambda own, k: F.element_at(F.array(*[F.lit(x) for x in own]), (k + 1).cast("int"))

    def name(i: Column) -> Column:
        return F.concat_ws(" ", pick(first, F.floor(i / (len(middle) * len(last)))), pick(middle, F.pmod(F.floor(i / len(last)), F.lit(len(middle)))), pick(last, F.pmod(i, F.lit(len(last)))))

    return F.transform(F.sequence(F.lit(0), F.lit(len(first) * len(middle) * len(last) - 1)), name)


def shrunk(before: DataFrame, now: DataFrame) -> DataFrame:
    """(source, n, least) of sources whose size fell below their mark; both tables hold (source, n)."""
    return now.join(before.select("source", F.col("n").alias("least")), "source").where("n < least").select("source", "n", "least")
