from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.functions import checksums as C

VECTORS = [
    ("AHVN13", "756.9217.0769.85", True), ("AHVN13", "7569217076985", True), ("AHVN13", "756.9217.0769.86", False), ("AHVN13", "757.9217.0769.85", False),
    ("AHVN13", "756.9217.0769.8", False), ("UID", "CHE-116.281.710", True), ("UID", "CHE116281710", True), ("UID", "CHE-116.281.710 MWST", True),
    ("UID", "CHE-116.281.711", False), ("UID", "DEU-116.281.710", False), ("IBAN", "CH93 0076 2011 6238 5295 7", True), ("IBAN", "CH93 0076 2011 6238 5296 0", False),
    ("QR_REFERENCE", "21 00000 00003 13947 14300 09017", True), ("QR_REFERENCE", "21 00000 00003 13947 14300 09018", False), ("CREDITCARD", "4242 4242 4242 4242", True),
    ("CREDITCARD", "4242 4242 4242 4241", False), ("GLN", "7601000000002", True), ("GLN", "7601000000003", False), ("AHVN13", "", False), ("IBAN", "", False), ("UID", "", False), ("CREDITCARD", "", False),
]


@pytest.mark.parametrize("tag", sorted(C.VALIDATORS))
def test_vectors(spark, tag):
    own = [(v, ok) for t, v, ok in VECTORS if t == tag]
    rows = spark.createDataFrame(own, "v string, ok boolean").select("v", "ok", C.VALIDATORS[tag](F.col("v")).alias("got")).collect()
    assert [(r["v"], r["got"]) for r in rows] == [(r["v"], r["ok"]) for r in rows]


def test_null_gives_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(*[f(F.col("v")).alias(t) for t, f in C.VALIDATORS.items()]).first() == (None,) * len(C.VALIDATORS)


@pytest.mark.parametrize("tag", sorted(C.GENERATORS))
def test_made_numbers_hold_and_single_digits_break_them(spark, tag):
    made = spark.range(1, 2001).select("id", C.GENERATORS[tag](F.col("id")).alias("v"))
    place = F.length("v") - F.pmod(F.col("id"), F.lit(5))
    digit = F.substring(F.col("v"), place, F.lit(1))
    broken = F.when(digit.rlike("[0-9]"), F.concat(F.substring(F.col("v"), F.lit(1), place - 1), F.pmod(digit.cast("int") + 1 + F.pmod(F.col("id"), F.lit(9)), F.lit(10)).cast("string"), F.substring(F.col("v"), place + 1, F.lit(50))))
    valid = C.VALIDATORS[tag]
    r = made.withColumn("b", broken).select(F.count("*").alias("n"), F.count_if(valid(F.col("v"))).alias("ok"), F.countDistinct("v").alias("d"), F.count_if(F.col("b") != F.col("v")).alias("changed"), F.count_if((F.col("b") != F.col("v")) & valid(F.col("b"))).alias("bad")).first()
    assert (r["n"], r["ok"], r["d"], r["bad"]) == (2000, 2000, 2000, 0) and r["changed"] > 1000
