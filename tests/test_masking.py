from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import mask as M
from veilspark.operators import spans as S
from veilspark.operators.recognise import SPAN

TEXT = "Herr Hans Meier, Bern. Frau Anna Keller. Meier kam. Hans\nMeier ging. [X_9] Art. 5"
FOUND = [("FULLNAME", 5, 15, None, "model"), ("FULLNAME", 28, 39, None, "model"), ("CITY", 17, 21, None, "model"), ("CITY", 8, 12, None, "model"), ("CANTON", 72, 76, None, "model")]


def table(spark, rows):
    return spark.createDataFrame(rows, f"i int, text string, spans array<{SPAN}>, masked string")


def test_numbers_variants_and_exact_restore(spark):
    df = table(spark, [(1, TEXT, FOUND, "clash"), (2, None, None, None), (3, "", [], None), (4, "ohne", None, None)])
    out = M.mask_table(df, "text", "spans")
    rows = {r["i"]: r for r in out.withColumn("back", M.restore(F.col("masked"), F.col("dictionary"))).collect()}
    assert rows[1]["masked"] == "Herr [FULLNAME_1], [CITY_1]. Frau [FULLNAME_2]. [FULLNAME_1a] kam. [FULLNAME_1b] ging. [X_9] Art. 5"
    assert [rows[i]["back"] for i in (1, 2, 3, 4)] == [TEXT, None, "", "ohne"]
    with pytest.raises(Exception, match="X_9"):
        out.where("i = 1").select(M.restore(F.col("masked"), F.col("dictionary"), strict=True)).collect()


def test_without_dictionary_and_with_excluded_tags(spark):
    r = M.mask_table(table(spark, [(1, TEXT, FOUND, None)]), "text", "spans", excluded=("CITY",), keep_dictionary=False).first()
    assert "Bern" in r["masked"] and r["dictionary"] == {} and "[FULLNAME_2]" in r["masked"]


def test_resolve_against_brute_force(spark):
    rng = random.Random(3)
    tags = ["AHVN13", "PHONE", "FULLNAME", "CITY", "UNKNOWN"]
    stage = {"AHVN13": 1, "PHONE": 2, "FULLNAME": 3, "CITY": 3, "UNKNOWN": 9}
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 60)
            own.append((rng.choice(tags), a, a + rng.randint(1, 15), None, "regex"))
        rows.append((i, "", own, None))
    for r in table(spark, rows).select("i", S.resolve(F.col("spans")).alias("s")).collect():
        kept = []
        for s in sorted(rows[r["i"]][2], key=lambda s: (stage[s[0]], s[1] - s[2])):
            if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
                kept.append(s)
        assert sorted((s["tag"], s["start"], s["end"]) for s in r["s"]) == sorted(k[:3] for k in kept)


def test_merge_thresholds_and_check_digits(spark):
    text = "Ida Waldner lebt in Seefurt, 6298, mit der Brunnen Treuhand AG. Nummer 756.9217.0769.86"
    at = lambda value, n=None: (text.index(value), text.index(value) + (n or len(value)))
    scored = [("FULLNAME", *at("Waldner"), 0.35), ("CITY", *at("Seefurt"), 0.35), ("CITY", *at("Seefurt"), 0.55), ("ZIPCODE", *at("6298"), 0.55), ("AHVN13", *at("756.9217.0769.86"), 0.99), ("ORG", text.index("Brunnen") + 1, text.index("Brunnen") + 4, 0.9)]
    df = spark.createDataFrame([(text, scored, [])], f"text string, sc array<struct<tag:string,start:int,end:int,score:double>>, f array<{SPAN}>")
    m = df.select(S.merge(F.col("text"), F.col("sc"), F.col("f")).alias("m")).first()["m"]
    assert [(s["tag"], s["start"], s["end"]) for s in m["spans"]] == [("FULLNAME", *at("Waldner")), ("CITY", *at("Seefurt")), ("ORG", *at("Brunnen"))]
    assert {(x["tag"], x["reason"]) for x in m["dropped"]} == {("CITY", "unter Schwelle 0.50 (0.35)"), ("ZIPCODE", "unter Schwelle 0.70 (0.55)"), ("AHVN13", "Pruefsumme ungueltig")}
    assert m["widened"] == 1


def test_coalesce_and_markup(spark):
    df = spark.createDataFrame([([(5, 7), (1, 3), (3, 5), (9, 10)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(S.coalesce(F.col("s"))).first()[0]] == [(1, 7), (9, 10)]
    assert [tuple(x) for x in df.select(S.coalesce(F.col("s"), touching=False)).first()[0]] == [(1, 3), (3, 5), (5, 7), (9, 10)]
    marked = spark.createDataFrame([(1, "A [[FULLNAME:Hans]] b [[NOPE: ]] c"), (2, None)], "i int, m string")
    rows = {r["i"]: r for r in M.from_markup(marked, "m").collect()}
    assert rows[1]["text"] == "A Hans b   c" and tuple(rows[1]["spans"][0]) == ("FULLNAME", 2, 6) and len(rows[1]["findings"]) == 2 and rows[2]["text"] is None
