from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from veilspark.llm import canonical as C
from veilspark.llm import language as L
from veilspark.llm import personal as P
from veilspark.llm import residue as R
from veilspark.llm import scans as S


def test_forms_that_look_the_same_are_one():
    t = C.transducer()
    base = "Die Grösse: fin AHV-Nummer 756, CHF 10."
    for other in ("Die Grösse: ﬁn ΑΗV‑Nummer 756, CHF 10.", "﻿Die　Grö​sse: fin AHV-Nummer ７５６, ＣＨＦ 10.", "Diе Grössе: fin AНV-Nummеr 756, СHF 10."):
        assert t(other) == t(base) == base
        plain, at = t.with_map(other)
        assert plain == base and len(at) == len(base) + 1
    for other in ("die Grösse", "Die Grosse", "Die Grösse!", "Die Grösse 2", "Die  Grösse"):
        assert t(other) != t("Die Grösse")
    assert t("x²") == "x²" and t("a\r\nb\rc") == "a\nb\nc" and t("") == "" and t(t("é́́")) == t("é́́")


def test_mapping_is_sound():
    table = C.mapping()
    assert all(unicodedata.normalize("NFC", v) == v for v in table.values()) and "ß" not in table and "æ" not in table


def test_pairs_of_same_look(spark):
    rows = [(1, "Abc"), (2, "Аbc"), (3, "Abc"), (4, None), (5, "abc"), (6, ""), (7, "​"), (8, "Abc­"), (9, None)]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("form", F.lit("clash")).withColumn("raw", F.lit(1))
    got = {tuple(r) for r in C.same_look(df, "id", "t").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8), (6, 7)}
    assert C.same_look(df.where("id < 0"), "id", "t").count() == 0


WORDS = {
    "de": "Die Verwaltung hat das Gesuch geprüft und wird den Antrag später behandeln, weil noch Unterlagen fehlen.",
    "fr": "La commission a examiné la demande et elle la traitera plus tard, car il manque encore des pièces au dossier.",
    "it": "La commissione ha esaminato la domanda e la tratterà più tardi, perché mancano ancora alcuni documenti.",
    "en": "The office has checked the request and will deal with it later, because some of the papers are still missing.",
    "es": "La oficina examinó la solicitud y la tratará más adelante, porque todavía faltan algunos documentos.",
}


def test_languages_and_passages(spark):
    model = L.train({k: [v + f" {i}." for i in range(30)] for k, v in WORDS.items()})
    rows = [(i, f"{WORDS[a]} {WORDS[b]}") for i, (a, b) in enumerate([("de", "fr"), ("it", "en"), ("es", "es")])] + [(8, None), (9, ""), (10, "123 456"), (11, WORDS["de"].upper())]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("lang_", F.lit("clash"))
    got = {}
    for r in L.segments(df, model, ["id"], "t").collect():
        got.setdefault(r["id"], []).append((r["start_pos"], r["lang"], r["full"]))
        assert 0 <= r["confidence"] <= 1
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == {0: ["de", "fr"], 1: ["it", "en"], 2: ["es"], 11: ["de"]}
    assert all(x[2] for v in got.values() for x in v)
    assert L.documents(L.segments(df, model, ["id"], "t"), ["id"]).count() == 4


PAGE = """Muster AG – betreffend Hundesteuer
Verfügung 1
Muster AG

Die Verwaltung hat das Gesuch geprüft und weiterge-
leitet. Die Rcchnung liegt der Ein- und Auszugsmeldung
bei, sie wird in einem Monat durch das Amt bezahlt und
   Seefurt · Postfach 3 – S. 1
\x0cMuster AG – betreffend Hundesteuer
danach abgelegt. Das AHV-
Formular fehlt.
S. 2"""


def test_scanned_pages_are_repaired(spark):
    other = " ".join(["Die Rechnung ist weitergeleitet."] * 20 + ["Das AHV-Formular ist da."])
    df = spark.createDataFrame([(1, PAGE), (2, other), (3, None), (4, ""), (5, "kurz\nText")], "id int, t string").withColumn("piece", F.lit("clash"))
    got = {(r["kind"], r["piece"]) for r in S.decisions(df, "id", "t").collect()}
    assert got == {("line", "Muster AG – betreffend Hundesteuer"), ("line", "Seefurt · Postfach 3 – S. 1"), ("line", "S. 2"), ("word", "weitergeleitet"), ("word", "AHV-Formular"), ("char", "Rechnung")}
    text = {r["id"]: r for r in S.repair(df, "id", "t").collect()}
    assert "geprüft und weitergeleitet. Die Rechnung liegt der Ein- und Auszugsmeldung bei" in text[1]["text"] and "bezahlt und danach abgelegt. Das AHV-Formular fehlt." in text[1]["text"]
    assert text[2]["text"] == other and text[3]["text"] is None and text[4]["text"] == "" and not text[5]["repaired"]
    assert S.decisions(df.where("id < 0"), "id", "t").count() == 0


def labelled():
    given, family = ["Anna", "Urs", "Carla", "Bruno", "Zita"], ["Waldacher", "Steihofer", "Goldacher", "Brunhofer", "Lütacher"]
    frames = ["Die Vollmacht liegt bei {n} ({m}).", "Frau {s} hat angerufen, Tel. {p}.", "Anwesend waren {n} und Herr {s}.", "{n} wohnt an der {st}, 3000 Obertal.", "Der Bericht von {o} ist da."]
    rows = []
    for i in range(1500):
        g, s = given[i % 5], family[(i // 5) % 5]
        values = {"n": ("FULLNAME", f"{g} {s}"), "s": ("FULLNAME", s), "m": ("EMAIL", f"{g.lower()}.{i}@amt.example"), "p": ("PHONE", f"031 555 {i % 90 + 10} {i % 80 + 10}"), "st": ("STREET", f"Bach{['strasse', 'weg', 'gasse'][i % 3]} {i % 90 + 1}"), "o": ("ORG", f"{s} Treuhand AG")}
        frame = frames[i % len(frames)] + " Das Amt prüft den Antrag am Montag."
        text, spans = "", []
        while "{" in frame:
            a, b = frame.index("{"), frame.index("}")
            tag, v = values[frame[a + 1 : b]]
            text += frame[:a]
            spans.append((tag, len(text), len(text) + len(v)))
            text += v
            frame = frame[b + 1 :]
        rows.append((text + frame, spans))
    return rows, {P.fold(x) for x in given}, {P.fold(x) for x in family[:4]}


def test_details_are_found_on_new_rows(spark):
    rows, given, family = labelled()
    finder = P.learn(rows, given, family)
    texts = ["Die Vollmacht liegt bei Carla Lütacher (carla [at] amt [punkt] example).", "Frau Goldacher kam. Waldacher Treuhand AG auch. AHV 756.9217.0769.85 und 756.9217.0769.86, Konto CH93 0076 2011 6238 5295 7.", "Urs Steihofer wohnt an der Bachgasse 12b, 3000 Obertal, und Herr Brun​hofer nicht.", None, "", "x" * 100_000]
    got = finder.batch(texts)
    values = [{(t, texts[i][a:b]) for t, a, b, _ in f} for i, f in enumerate(got)]
    assert ("FULLNAME", "Carla Lütacher") in values[0] and ("EMAIL", "carla [at] amt [punkt] example") in values[0]
    assert {x for x in values[1] if x[0] != "FULLNAME"} <= {("AHVN13", "756.9217.0769.85"), ("IBAN", "CH93 0076 2011 6238 5295 7")} and ("FULLNAME", "Goldacher") in values[1]
    assert ("FULLNAME", "Urs Steihofer") in values[2] and got[3] == got[4] == [] == got[5]
    assert P.replaced("a b a", [("FULLNAME", 0, 1, 1.0), ("FULLNAME", 4, 5, 1.0)]) == "[FULLNAME_1] b [FULLNAME_1]"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("tag", F.lit("clash"))
    assert P.details(df, finder, ["id"], "t").count() == sum(map(len, got))
    assert P.masked(df, finder, ["id"], "t").where("id = 4 or id = 3").orderBy("id").collect()[0]["text"] is None


def test_residue_of_templates_and_pages(spark):
    content = ["Die Verwaltung hat das Gesuch von {FULLNAME} geprüft.", "Am Telefon ({PHONE}) meldete sich niemand.", "Die Rechnung ist seit dem {DATE} offen."]
    real = [f"Die Verwaltung hat das Gesuch von Urs Muster{i} geprüft. Die Rechnung ist seit dem {i % 28 + 1}.1.2020 offen." for i in range(300)]
    decoys = [f"Die Verwaltung hat das Gesuch von Ida B{i} geprüft. Im Browser stand nur «404 Not Found», der Vorgang {i} liess sich nicht speichern." for i in range(60)]
    pages = [f"404 – Seite nicht gefunden\nZurück zur Startseite\nVorgang {i}" for i in range(20)] + [f"Bitte aktivieren Sie JavaScript in Ihrem Browser. ({i})" for i in range(20)]
    slots = [f"Am Telefon (${{PHONE}}) meldete sich niemand. Die Rechnung {i} ist offen." for i in range(20)] + ["Die Rechnung ist seit dem [[datum:]] offen."]
    odd = [None, "", "   ", 'Antwort {"status": 500}, danach [x] Zuzug [ ] Wegzug. Die Verwaltung hat das Gesuch geprüft.']
    texts = real + decoys + pages + slots + odd
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("odds", F.lit("clash"))
    templates = spark.createDataFrame([(c,) for c in content], "text string")
    got = {r["id"] for r in R.mark_residue(df, templates, "id", "t").collect() if r["residue"]}
    assert got == set(range(len(real) + len(decoys), len(real) + len(decoys) + len(pages) + len(slots)))


def test_classes_without_pairs_and_words_of_one_script(spark):
    rows = [(1, "Abc"), (2, "Аbc"), (3, "Abc"), (4, None), (5, "abc"), (8, "Abc­")]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("class_id", F.lit("clash"))
    got = {r["id"]: (r["class_id"], r["strings"], r["links"]) for r in C.classes(df, "id", "t").collect()}
    assert got == {1: (1, 3, 2), 3: (1, 3, 2), 2: (1, 3, 3), 8: (1, 3, 3), 5: (5, 1, 0)}
    t = C.transducer()
    assert t("Москва") == t("Mосква") == "Москва" and t("Ελλάδα") == t("Eλλάδα") == "Ελλάδα" and t("АВС") == "ABC"
    assert t("ｶﾞ") == "ガ" == t(t("ｶﾞ")) and t.with_map("Mосква")[0] == "Москва"


def test_clusters_equal_the_standard_form():
    import random

    t, rng = C.transducer(), random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x34F)]
    for _ in range(5000):
        s = rng.choice("aeiouncsAEOüé") + "".join(rng.choice(marks) for _ in range(rng.randint(0, 4)))
        assert t(s) == unicodedata.normalize("NFC", s.replace("͏", "")), ascii(s)


def test_samples_are_whole_distinct_and_bounded(spark):
    from veilspark.llm.common import text_sample

    df = spark.createDataFrame([("x" * 50, "a")] * 500 + [(f"text {i} " * 20, "ab"[i % 2]) for i in range(400)] + [(None, "a"), ("", "b")], "t string, k string")
    got = text_sample(df, "t", 50, 10**6, "k")
    assert set(got) == {"a", "b"} and all(40 <= len(v) <= 50 and len(set(v)) == len(v) for v in got.values())
    assert all(x == "x" * 50 or x.endswith(" ") for v in got.values() for x in v)
    assert sum(map(len, text_sample(df, "t", 50, 1000)[""])) <= 1000 and text_sample(df.where("k = 'z'"), "t", 5, 5) == {}
