from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.operators import edits as D
from veilspark.operators import evaluate as E
from veilspark.operators import labels as L
from veilspark.operators import lists as X
from veilspark.operators import report as P
from veilspark.operators import scoring as S
from veilspark.operators import synthesis as Y
from veilspark.sources import readers


def test_leaks_count_every_sign_but_white_space_and_only_masking_tags():
    from veilspark.functions.contract import ACTIONS

    judge = lambda gold, pred, out=frozenset(): [r for r in E.verdicts(gold, pred, ACTIONS, out) if r[0] == "gold"]
    [r] = judge([("FULLNAME", 0, 10, "Hans Meier")], [("CANTON", 0, 10)])
    assert (r[5], r[6], r[7]) == ("missed", 9, 9)
    [r] = judge([("EMAIL", 0, 6, "a@b.ch")], [("PHONE", 0, 1), ("PHONE", 2, 3), ("PHONE", 4, 6)])
    assert (r[6], r[7], r[8]) == (6, 2, "@.")
    [r] = judge([("EMAIL", 0, 6, "a@b.ch")], [], frozenset(["EMAIL"]))
    assert r[7] == 0 and r[9] == 0.0
    over = [r[1] for r in E.verdicts([("CITY", 0, 4, "Bern")], [("CITY", 0, 3), ("CITY", 0, 4), ("ORG", 0, 4)], ACTIONS) if r[5] == "over"]
    assert over == ["CITY", "ORG"]


def test_matches_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        spans = lambda n: [(rng.choice(["CITY", "ORG"]), a := rng.randrange(20), a + rng.randrange(1, 6)) for _ in range(n)]
        gold, pred = [(*s, "x" * (s[2] - s[1])) for s in spans(rng.randint(0, 8))], spans(rng.randint(0, 8))
        got = E.verdicts(gold, pred, {"CITY": "mask", "ORG": "mask"})
        order, used, want = sorted(pred, key=lambda p: (p[1], p[2], p[0])), set(), []
        for tag, a, b, _ in sorted(gold, key=lambda g: (g[1], g[2], g[0])):
            i = next((i for i, p in enumerate(order) if i not in used and p == (tag, a, b)), None)
            kind = "exact"
            if i is None:
                i, kind = next((i for i, p in enumerate(order) if i not in used and p[0] == tag and p[1] < b and a < p[2]), None), "partial"
            if i is not None:
                used.add(i)
            want.append(kind if i is not None else "missed")
        assert [r[5] for r in got if r[0] == "gold"] == want
        cover = {x for p in pred for x in range(p[1], p[2])}
        assert [r[7] for r in got if r[0] == "gold"] == [sum(x not in cover for x in range(g[1], g[2])) for g in sorted(gold, key=lambda g: (g[1], g[2], g[0]))]


def test_alignment_by_place_with_blanks_and_tight_edges(spark):
    text = "Hans Meier, Bern x"
    toks = [(0, 4), (4, 10), (10, 11), (11, 16), (16, 17), (17, 18)]
    labels, over, missing = L.aligned(text, toks, [("CITY", 5, 15), ("FULLNAME", 0, 10)])
    assert labels[:2] == ["B-FULLNAME", "I-FULLNAME"] and missing == 0
    assert L.aligned("AB CD EF", [(0, 2), (3, 5), (6, 8)], [("CITY", 5, 15), ("FULLNAME", 0, 5)])[0] == ["B-FULLNAME", "I-FULLNAME", "B-CITY"]
    assert L.aligned("CHF 1", [(0, 3), (3, 4), (4, 5)], [("AMOUNT", 0, 5)])[0] == ["B-AMOUNT", "I-AMOUNT", "I-AMOUNT"]
    with pytest.raises(ValueError):
        L.aligned("ab", [(0, 2)], [("NOPE", 0, 2)])
    assert L.decoded([(0, 3), (3, 6)], ["B-CITY", "O"], "ab, xy") == [("CITY", 0, 2)] and L.decoded([(0, 2), (3, 5)], ["I-CITY", "I-ORG"]) == [("CITY", 0, 2), ("ORG", 3, 5)]
    df = spark.createDataFrame([("Herr Hans Meier, Bern", [("FULLNAME", 5, 15), ("CITY", 17, 21)]), ("ab", [("CITY", 0, 1)]), (None, None)], "t string, s array<struct<tag:string,start:int,end:int>>")
    df = df.withColumn("k", L.tokens(F.col("t")))
    assert [len(r[0]) for r in df.select(L.round_trip(F.col("t"), F.col("k"), F.col("s"))).collect()] == [0, 2, 0]


def test_edits(spark):
    assert D.repaired_text("NAME_1] und \\[X_1", {"[NAME_1]"}) == ("[NAME_1] und \\[X_1", ["[NAME_1]"]) and D.leftovers_of("[A_1] \\[B\\_2]") == ["\\[B\\_2]"]
    assert D.shifted("Anna und Anna, Bern", [("FULLNAME", 0, 4), ("CITY", 15, 19)], [("Anna", "Annamaria")])[:2] == ("Annamaria und Annamaria, Bern", [("FULLNAME", 0, 9), ("CITY", 25, 29)])
    with pytest.raises(ValueError, match="half"):
        D.shifted("Anna Keller", [("FULLNAME", 2, 8)], [("Anna", "X")])
    df = spark.createDataFrame([("a [A_1] b", {"[A_1]": "x", "[A_3]": "y"}), (None, None)], "t string, w map<string,string>")
    rows = df.select(D.unmasked(F.col("t"), F.col("w"), F.lit("[A_1]")).alias("u"), D.next_placeholder(F.col("w"), F.lit("A")).alias("n"), D.placeholder_of(F.col("w"), F.lit("A"), F.lit("y")).alias("p"), D.masked_value(F.col("t"), F.col("w"), F.lit("b"), F.lit("A")).alias("m")).collect()
    assert rows[0]["u"]["text"] == "a x b" and rows[0]["n"] == "[A_2]" and rows[0]["p"] == "[A_3]" and rows[0]["m"]["text"] == "a [A_1] [A_2]" and rows[1]["u"]["text"] is None and rows[1]["p"] is None


def test_texts_from_pages_and_mails(spark, tmp_path):
    assert T.html_text("<p>K&ouml;niz</p>\n") == "Köniz" and T.html_text("a<style>x</style>b<td>c") == "a b c"
    assert T.readable_part("Text. " * 20 + "\x0c" * 150) == (("Text. " * 20).rstrip(), 150)
    assert T.readable_part("ab\x01cd" + "x" * 300) == ("ab\x01cd" + "x" * 300, 0)
    head = "y" * 150 + "\x01" + "z" * 20 + "\x02" + "q" * 28
    assert T.readable_part(head + "\x03" * 200)[0] == "y" * 150
    (tmp_path / "m.eml").write_bytes(b"From: a@b.ch\nSubject: Hoi\nContent-Type: text/plain; charset=iso-8859-1\n\nText hier\n" + b"\x01\x02\x03" * 200)
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "o.xml").write_text('<r xmlns="u"><placeOfOrigin><placeOfOriginName>Aeugst</placeOfOriginName><cantonAbbreviation>ZH</cantonAbbreviation><validTo>1976</validTo></placeOfOrigin></r>')
    rows = {r["kennung"]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert rows["m.eml"]["text"].endswith("Text hier") and any(h["schluessel"] == "binaerrest" for h in rows["m.eml"]["hinweise"]) and rows["old.doc"]["text"] is None
    assert tuple(readers.read_places_of_origin(spark, str(tmp_path / "o.xml")).first()) == ("Aeugst", "ZH", "Aeugst ZH", True)
    df = spark.createDataFrame([("geboren am ",), ("geboren am 1.2. Ab ",), ("Geburtsdatum: ",)], "t string")
    assert [r[0] for r in df.select(T.announces_birth(F.col("t"))).collect()] == [True, False, True]
    assert spark.range(1).select(T.marked(F.lit("a {} b {}"), F.lit(1), F.lit("x"))).first()[0] == "a 1 b x"


def test_generator(spark):
    templates = spark.createDataFrame([("a", "Am {DATE} an {@person}, {@address}; {~amount}. {AHVN13} {ORG} {FULLNAME}", "de"), ("b", "Le {DATE}: {@contact} {IBAN}", "fr"), ("c", "{CITY} {CITY}", "de"), ("d", None, "de")], "template_id string, text string, lang string")
    values = Y.Values({"FULLNAME": [(f"Name{i}", i) for i in range(50)], "GIVENNAME": [("Anna", 4)], "ORG": [("X AG", 1)], "ORG@de": [("Amt", 1)]}, [("Gasse", "3000", "Bern")])
    got = Y.generate(spark, templates, values, 200, seed=3, noise=0.2).collect()
    again = Y.generate(spark, templates, values, 200, seed=3, noise=0.2).repartition(3).collect()
    assert len(got) == 200 and sorted(r["text"] for r in got) == sorted(r["text"] for r in again) and {r["template_id"] for r in got} == {"a", "b"}
    for r in got:
        assert all(r["text"][s["start"] : s["end"]].strip() for s in r["spans"]) and "{" not in r["text"]
        streets = [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["tag"] == "ZIPCODE"]
        assert streets in ([], ["3000"])
    held = Y.Values({"FULLNAME": [(f"Name{i}", 1) for i in range(400)]}, [], "held_out").lists["FULLNAME"][0]
    assert 10 < len(held) < 90 and all(Y.in_held_out_zone(n) for n in held)
    found = {(r["template_id"], r["finding"].split(":")[0]) for r in Y.check_templates(templates, ("IBAN",)).collect()}
    assert found == {("a", "missing IBAN"), ("c", "missing IBAN"), ("c", "equal slots side by side"), ("d", "no text")}
    df = spark.createDataFrame([("Bern, x", [("CITY", 0, 5), ("ORG", 4, 7), ("ORG", 6, 9)])], "t string, s array<struct<tag:string,start:int,end:int>>")
    assert set(df.select(Y.implausible(F.col("t"), F.col("s"))).first()[0]) == {"edge CITY", "overlap CITY", "overlap ORG", "place ORG"}


def test_scorers_lists_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Frau Anna Keller in Bern"), (2, None), (3, "")], "doc_id int, text string").withColumn("tag", F.lit("clash"))
    names = spark.createDataFrame([("Anna Keller", "FULLNAME", 0.9), ("Anna", "GIVENNAME", 0.8), ("Bern", "CITY", 0.7), (None, "CITY", 0.1)], "name string, tag string, score double")
    rows = {r["doc_id"]: [tuple(s) for s in r["scored"]] for r in S.GazetteerScorer(names).scored(docs, "text").collect()}
    assert rows == {1: [("FULLNAME", 5, 16, 0.9), ("CITY", 20, 24, 0.7)], 2: [], 3: []}
    table = spark.createDataFrame([(1, "CITY", 20, 24, 0.7), (9, "CITY", 0, 1, 0.7), (1, None, 0, 1, 0.7)], "doc_id int, tag string, start_pos int, end_pos int, score double")
    assert {r["doc_id"]: len(r["s"]) for r in S.TableScorer(table, "doc_id").scored(docs, "text", "s").collect()} == {1: 1, 2: 0, 3: 0}
    one, two = (X.fingerprint(spark.createDataFrame([(n,) for n in own], "name string")).first() for own in (["b", " a", "a"], ["a", "b", None]))
    assert one == two and one["n"] == 2 and X.checked_size(5, 4) == 5
    with pytest.raises(ValueError):
        X.checked_size(3, 4)
    assert len(set(spark.range(1).select(X.combined(["A", "B"], ["x", "y", "z"], ["1", "2"])).first()[0])) == 12
    P.write_report(docs.withColumn("value", F.lit("geheim")), str(tmp_path / "r"))
    assert "value" not in spark.read.json(str(tmp_path / "r")).columns
    X.write_list(spark.createDataFrame([("Zürich",), ("aarau",), ("Zürich",)], "name string"), str(tmp_path / "l"), "CITY")
    assert spark.read.json(str(tmp_path / "l/meta")).first()["n"] == 2
