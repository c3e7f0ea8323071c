from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.functions.plain import CHECKS
from veilspark.operators import kernel as K
from veilspark.operators import mask as M
from veilspark.operators import recognise as R
from veilspark.operators import rules as U
from veilspark.operators import suspicion as S


def test_plain_checks_equal_the_column_ones(spark):
    rng = random.Random(4)
    made = {tag: [r["v"] for r in spark.range(200).select(make(F.col("id")).alias("v")).collect()] for tag, make in C.GENERATORS.items()}
    cases = []
    for tag, values in made.items():
        for v in values:
            i = rng.randrange(len(v))
            cases += [(tag, v), (tag, v[:i] + rng.choice("0123456789AX ") + v[i + 1 :]), (tag, v + rng.choice("0 M")), (tag, "")]
        cases += [("UID", "CHE-116.281.710 MWST"), ("UID", "CHE-116.281.7A10"), ("UID", "CHE-116.281.710 MWSTTVA")]
    for tag, check in CHECKS.items():
        own = [v for t, v in cases if t == tag]
        rows = spark.createDataFrame([(v,) for v in own], "v string").select("v", C.VALIDATORS[tag](F.col("v")).alias("ok")).collect()
        assert [(r["v"], r["ok"]) for r in rows] == [(r["v"], check(r["v"])) for r in rows], tag


def test_quick_reading_equals_the_plain_one():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pydict()["text"]
    texts += ["Zivilstand: ledig Zivilstand ledig, sexe f sexe: m", "10.0.0.1 fe80::1 ::1 1.2.3 CHE-116.281.710", "ZH 12 ZH12 AZH 3 Heimatort Bern BE", "Bundesamt für Statistik, Sektion X und Y AG", "a" * 500 + "@b.ch"]
    quick, plain = R.Recogniser(R.RULES), R.Recogniser(R.RULES, quick=False)
    for t in texts:
        assert quick(t) == plain(t), t


def test_occupied_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        taken, own = [], R.Occupied()
        for _ in range(30):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 8)
            assert own.free(a, b) == all(b <= x or y <= a for x, y in taken)
            if rng.random() < 0.5:
                taken.append((a, b))
                own.take(a, b)


def followed_plainly(text, spans, tags):
    """Every seed's value, then the parts, wherever they stand free as whole words."""
    out = list(spans)

    def take(needle, tag, value):
        body = r"\s+".join(map(re.escape, needle.split()))
        for m in re.finditer(rf"(?<!\w){body}(?!\w)", text) if body else ():
            if all(m.end() <= s[1] or s[2] <= m.start() for s in out):
                out.append((tag, m.start(), m.end(), value, "propagation"))

    seeds = [(s[0], text[s[1] : s[2]]) for s in spans if s[0] in tags]
    for tag, value in seeds:
        take(value, tag, value)
    for tag, value in seeds:
        parts = [x for x in re.split(r"[\s\-]+", value) if len(x) >= 3]
        if tag in ("FULLNAME", "ORG", "HEALTHCARE_ORG") and len(parts) > 1:
            for x in parts:
                if x[0].isupper():
                    take(x, tag, value)
    return sorted(out, key=lambda s: s[1])


def test_following_against_brute_force():
    rng = random.Random(9)
    words = ["Anna", "Rot-Blau", "Rot", "Keller", "(Keller)", "und", "die", "AG", "& Co", "Meier\nMeier", "O'Brien", "Blau"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
        spans, at = [], 0
        for m in re.finditer(r"\S+(?: \S+)?", text):
            if rng.random() < 0.15:
                spans.append((rng.choice(["FULLNAME", "GIVENNAME", "CITY", "ORG"]), *m.span(), None, "model"))
        assert K.follow(text, spans) == followed_plainly(text, spans, K.PROPAGATED), text


def test_long_texts_are_done_in_time():
    text = "Anna Keller und Urs Meier. " * 4000
    spans = [("FULLNAME", m.start(), m.end(), None, "model") for m in re.finditer("Anna Keller", text)]
    out, entries, masked = K.masked(text, spans, K.Names())
    assert masked.count("[FULLNAME_1]") == 4000 and len(out) == 4000 == len(entries)


def test_user_rules_reach_the_placeholder(spark):
    own = U.load([{"id": "einsprache", "placeholder": "Rechtsmittel", "type": "words", "words": ["Einsprache"]}, {"id": "akte", "art": "etikett", "wertform": "ziffern", "etiketten": ["Akte"], "min": 2, "max": 6}])
    df = spark.createDataFrame([(1, "Die Einsprache von a@b.ch, Akte 4711."), (2, None), (3, "")], "i int, t string").withColumn("masked", F.lit("clash"))
    rows = {r["i"]: r for r in M.filter_texts(df, "t", rules=own).collect()}
    assert rows[1]["masked"] == "Die [Rechtsmittel_1] von [EMAIL_1], Akte [akte_1]." and rows[2]["masked"] is None and rows[3]["masked"] == "" and rows[2]["dictionary"] == {}
    assert M.filter_texts(df, "t", rules=own, excluded=("X_akte", "EMAIL")).where("i = 1").first()["masked"] == "Die [Rechtsmittel_1] von a@b.ch, Akte 4711."
    found = df.withColumn("s", F.concat(R.recognised("t"), U.apply(F.col("t"), own)))
    assert M.mask_table(found, "t", "s", rules=own).where("i = 1").first()["masked"] == rows[1]["masked"]
    with pytest.raises(ValueError, match="taken"):
        U.load([{"id": "aa", "placeholder": "Xy", "type": "words", "words": ["abc"]}, {"id": "bb", "placeholder": "Xy", "type": "words", "words": ["abd"]}])
    with pytest.raises(ValueError, match="too long"):
        U.checked(r"(\w+ ?)+!")
    notes: list[str] = []
    U.load([{"id": "aa", "platzhalter": "Xy", "art": "wortliste", "woerter": ["abc"], "stage": 1}], notes)
    assert "platzhalter -> placeholder" in notes and "stage has no effect" in notes


def test_suspicion_as_specified(spark):
    finds = lambda text, spans=(): [(k, v) for _, _, k, v in S.finds(text, list(spans))]
    assert finds("Sehr geehrte Frau M,\nMeier kommt") == [("Grossschreibung", "Meier")]
    assert finds("Er kam. Meier kommt") == [] and finds("Gestern kam Urs Meier.") == [("Grossschreibung", "Urs Meier")]
    assert finds("ruf 079 123 45 67 an", [(4, 10)]) == [("Ziffernfolge", "079 123 45 67")] and finds("ruf 079 123 45 67 an", [(4, 10), (10, 17)]) == []
    df = spark.createDataFrame([(None, []), ("mail an x@y", None)], "t string, s array<struct<start:int,end:int>>")
    assert [len(r[0]) for r in df.select(S.suspicious(F.col("t"), F.col("s"))).collect()] == [0, 1]
