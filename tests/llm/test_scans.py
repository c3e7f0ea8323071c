from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.llm import scans as S


def test_misread_words_behind_an_apostrophe_are_corrected(spark):
    scan = "La commune demande que vous lui indiquiez\nsans tarder L'adrcsse de la personne et les\ncoordonnées de l'aut0risation pour que Gescha'ft\net jusqu'au 3 mai soient inscrits."
    other = " ".join(["Voici l'adresse, une autorisation et un Geschäft jusqu'au soir."] * 20)
    df = spark.createDataFrame([(1, scan), (2, other)], "id int, t string")
    assert {(r["kind"], r["piece"]) for r in S.decisions(df, "id", "t").collect()} == {("char", "adresse"), ("char", "autorisation"), ("char", "Geschäft")}
    text = {r["id"]: r["text"] for r in S.repair(df, "id", "t").collect()}
    assert "L'adresse de la" in text[1] and "de l'autorisation pour que Geschäft et jusqu'au" in text[1]


def test_short_letters_that_wrap_before_capitals_are_scans():
    letter = "Muster AG – zur Hundesteuer\nSehr geehrte Frau Muster\n\nDie Rechnung ist seit Monaten offen und das\nAmt hat sie zweimal angemahnt. Gemäss dem\nGesetz zahlen Sie dafür eine Pauschale von\n40 Franken.\n"
    assert S.is_scan(letter + "1/2\nMuster AG – zur Hundesteuer\nGrüsse")
    assert S.is_scan(letter.replace("und das\nAmt", "und\ndas Amt")) and not S.is_scan(letter)
    table = "Register\n\nUrs Muster; Bachgasse 12; 031 555 66 30\nIda Muster; Bachgasse 14; 031 555 66 31\nEva Muster; Bachgasse 16; 031 555 66 32\n1/2"
    assert not S.is_scan(table) and not S.is_scan(table.replace(";", "\t"))
    assert not S.is_scan("Die Rechnung ist seit Monaten offen und das\nAmt hat sie zweimal angemahnt. " + "Gemäss dem Gesetz zahlen Sie. " * 9 + "\n1/2")


def test_any_number_of_misreadings_is_undone(spark):
    assert S.swaps("rcchnung", "rechnung") == 1 and S.swaps("vcrwa1tung", "verwaltung") == 2 and S.swaps("rechnung", "rechnung") == 0
    assert S.swaps("rechnunq", "rechnung") is None and S.swaps("staclt", "stadt") == 1 and S.swaps("cinc", "eine") == 2 and S.swaps("", "a") is None
    pairs = [("rcchnung", "rechnung"), ("gescha'ft", "geschäft"), ("staclt", "stadt"), ("vvohnung", "wohnung"), ("iibermitteln", "übermitteln"), ("6egen", "gegen"), ("intem", "intern"), ("clcnd", "elend")]
    bones = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for p in pairs for w in p], "w string").select("w", S.skeleton_col(F.col("w")).alias("s")).collect()}
    assert all(bones[a] == bones[b] and S.swaps(a, b) for a, b in pairs)
    for key, tos in S.MISREAD.items():
        for to in tos:
            got = spark.createDataFrame([(key,), (to,)], "w string").select(S.skeleton_col(F.col("w")).alias("s")).collect()
            assert got[0] == got[1], (key, to)
    scan = "Die Gcmeindevcrwa1tung prüft seit Wochen den Antrag und\nbittet um Geduld, weil noch weitere Unterlagen fehlen und\nniemand da ist."
    df = spark.createDataFrame([(1, scan), (2, "Die Gemeindeverwaltung prüft. " * 10), (3, "c" * 3000)], "id int, t string")
    assert ("char", "Gemeindeverwaltung") in {(r["kind"], r["piece"]) for r in S.decisions(df, "id", "t").collect()}
