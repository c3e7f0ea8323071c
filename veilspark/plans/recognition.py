"""Queries on recognisers and on the chain. Their texts are sentences made from the rows of a table, once by Spark and once
in SQL, so the place of every detail is known from the sentence and not from a second pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums
from ..operators import mask, rules, scoring
from ..operators.recognise import recognised
from .base import query, spread, table

K = "c_custkey"


def _pad(number: str, width: int) -> str:
    return f"lpad(concat({number}, ''), {width}, '0')"


# (probe, tag, what stands before, the value in SQL that both engines read, what stands behind, whether it is found)
PROBES: dict[str, list[tuple[str, str, str, str, str, bool]]] = {
    "numbers": [
        ("egid", "EGID", "Der EGID lautet ", _pad(f"100000 + {K}", 6), ".", True), ("egid_fr", "EGID", "identificateur de bâtiment ", _pad(f"200000 + {K}", 6), " oui", True), ("egid_alone", "EGID", "Die Zahl ", _pad(f"100000 + {K}", 6), " steht allein", False),
        ("egid_next_line", "EGID", "Der EGID\n", _pad(f"100000 + {K}", 6), "", False), ("egid_far", "EGID", "Der EGID, wie er im Register der Gemeinde seit langem steht, ist ", _pad(f"100000 + {K}", 6), "", False),
        ("ewid", "EWID", "EWID ", f"concat(1 + {K} % 120, '')", " im ersten Stock", True), ("bfs", "MUNICIPALITY_ID", "Gemeinde-Nr ", f"concat(1 + {K} % 6800, '')", ";", True), ("bfs_plain", "MUNICIPALITY_ID", "numero UST ", f"concat(1 + {K} % 6800, '')", "", True),
        ("card", "INSURANCE_CARD", "Karte ", f"concat('80756', {_pad(K, 15)})", "", True), ("card_long", "INSURANCE_CARD", "Karte ", f"concat('80756', {_pad(K, 16)})", "", False),
        ("parcel", "PARCEL", "Parzellen-Nr. ", f"concat(1 + {K} % 5000, '')", " am Bach", True), ("parcel_it", "PARCEL", "la particella ", f"concat(1 + {K} % 5000, '')", "", True), ("parcel_line", "PARCEL", "Grundstück\n", f"concat(1 + {K} % 5000, '')", "", False),
        ("patient", "PATIENT_ID", "Patientennummer ", f"concat('PX', {_pad(K, 6)})", " am Montag", True), ("patient_alone", "PATIENT_ID", "die nummer ", f"concat('PX', {_pad(K, 6)})", "", False),
        ("case", "CASE_ID", "Akte ", f"concat('EWK-2024-', {_pad(K + ' % 100000', 5)})", " offen", True), ("zsr", "ZSR_RCC", "ZSR-Nr ", f"concat('H', {_pad(K + ' % 1000000', 6)})", "", True), ("zsr_alone", "ZSR_RCC", "der Code ", f"concat('H', {_pad(K + ' % 1000000', 6)})", "", False),
        ("pass", "IDDOC", "Reisepass ", f"concat('X', {_pad(K + ' % 10000000', 7)})", ".", True), ("pass_alone", "IDDOC", "die ", f"concat('C', {_pad(K + ' % 10000000', 7)})", " gilt", True), ("pass_glued", "IDDOC", "die A", f"concat('C', {_pad(K + ' % 10000000', 7)})", " gilt", False),
    ],
    "contacts": [
        ("phone", "PHONE", "Tel. ", f"concat('031 555 ', {_pad(K + ' % 100', 2)}, ' ', {_pad(K + ' % 90', 2)})", ", bitte", True), ("phone_abroad", "PHONE", "Ruf ", f"concat('+41 79 555 ', {_pad(K + ' % 100', 2)}, ' ', {_pad(K + ' % 90', 2)})", "", True), ("phone_long", "PHONE", "Nr. ", f"concat('031 555 ', {_pad(K + ' % 100', 2)}, ' ', {_pad(K + ' % 900', 3)})", "", False),
        ("mail", "EMAIL", "an ", f"concat('kunde', {K}, '@example.ch')", ", danke", True), ("url", "URL", "siehe ", f"concat('https://www.example.ch/a/', {K})", ".", True), ("url_www", "URL", "(", f"concat('www.gemeinde', {K}, '.ch')", ")", True),
        ("ip", "IPADDRESS", "Host ", f"concat('10.0.', {K} % 250, '.', 1 + {K} % 200)", " ruft", True), ("ip_wrong", "IPADDRESS", "Host ", f"concat('10.0.', {K} % 250, '.', 300 + {K} % 200)", " ruft", False), ("ip_six", "IPADDRESS", "Host ", f"concat('fe80::', 1 + {K} % 9000)", " ruft", True), ("clock", "IPADDRESS", "um ", f"concat({_pad(K + ' % 24', 2)}, ':12:00')", " Uhr", False),
        ("home", "USERNAME", "cd /home/", f"concat('nutzer', {K})", "/x", True), ("login", "USERNAME", "Login: ", f"concat('nutzer', {K})", " seit gestern", True), ("login_far", "USERNAME", "Login am Montag ", f"concat('nutzer', {K})", "", False), ("domain", "USERNAME", "als ", f"concat('DOM\\\\nutzer', {K})", " da", True),
    ],
    "places": [
        ("plate", "PLATE", "Wagen ", f"concat('ZH ', 1 + {K})", " rot", True), ("plate_no", "PLATE", "Wagen ", f"concat('XZH ', 1 + {K})", " rot", False), ("zip", "ZIPCODE", "in ", _pad(f"3000 + {K} % 900", 4), " Bern", True), ("zip_francs", "ZIPCODE", "von ", _pad(f"3000 + {K} % 900", 4), " Franken", False), ("zip_lower", "ZIPCODE", "von ", _pad(f"3000 + {K} % 900", 4), " und", False),
        ("amount", "AMOUNT", "zahlt ", f"concat('CHF ', 1 + {K} % 9, '''', {_pad(K + ' % 1000', 3)}, '.50')", " bar", True), ("amount_words", "AMOUNT", "kostet ", f"concat(100 + {K} % 900, ' francs')", " net", True), ("amount_fee", "AMOUNT", "Die Gebühr ist ", f"concat('CHF ', 100 + {K} % 900, '.00')", "", False), ("amount_fee_plain", "AMOUNT", "Die Gebuehr ist ", f"concat('CHF ', 100 + {K} % 900, '.00')", "", False),
        ("permit", "PERMIT_TYPE", "mit ", f"concat('Bewilligung ', CASE WHEN {K} % 2 = 0 THEN 'B' ELSE 'Ci' END)", " hier", True), ("permit_no", "PERMIT_TYPE", "mit ", f"concat('Bewilligung ', CASE WHEN {K} % 2 = 0 THEN 'X' ELSE 'Bx' END)", " hier", False),
        ("origin", "PLACE_OF_ORIGIN", "Heimatort ", f"concat('Dorf', CASE WHEN {K} % 2 = 0 THEN 'berg' ELSE 'tal an der Aa' END, ' BE')", ".", None), ("origin_slash", "PLACE_OF_ORIGIN", "heimatberechtigt in ", f"concat('Biel/Bienne', CASE WHEN {K} % 2 = 0 THEN ' BE' ELSE ' SO' END)", "", True), ("origin_alone", "PLACE_OF_ORIGIN", "Er wohnt in ", f"concat('Dorf', CASE WHEN {K} % 2 = 0 THEN 'berg' ELSE 'tal' END, ' BE')", "", False),
        ("date", "DATE", "am ", f"concat({_pad('1 + ' + K + ' % 28', 2)}, '.', {_pad('1 + ' + K + ' % 12', 2)}, '.2024')", " kam", True), ("date_words", "DATE", "am ", f"concat(1 + {K} % 28, '. MÄRZ 2024')", " kam", True), ("date_iso", "DATE", "am ", f"concat('2024-', {_pad('1 + ' + K + ' % 12', 2)}, '-03')", " kam", True), ("date_law", "DATE", "Bundesgesetz vom ", f"concat(1 + {K} % 28, '. Juni 1992')", "", False),
    ],
    "organisations": [
        ("firm", "ORG", "an ", f"concat('Strub', ' & ', 'Partner', ' GmbH')", f" in Bern", True), ("firm_two", "ORG", "bei ", f"concat('Huber und Söhne ', CASE WHEN {K} % 2 = 0 THEN 'AG' ELSE 'SA' END)", " in Bern", True), ("firm_none", "ORG", "bei ", f"concat('Huber und Söhne in Bern', '')", ".", False),
        ("federal", "ORG", "das ", f"concat('Staatssekretariat für ', CASE WHEN {K} % 2 = 0 THEN 'Wirtschaft' ELSE 'Migration' END)", ", das", True), ("federal_fr", "ORG", "l'", f"concat('Office fédéral de la ', CASE WHEN {K} % 2 = 0 THEN 'statistique' ELSE 'justice' END)", ".", True),
        ("office", "ORG", "das ", f"concat('Zivilstands', CASE WHEN {K} % 2 = 0 THEN 'amt' ELSE 'behörde' END)", " hat", True), ("office_no", "ORG", "das ", f"concat('Gesamt', '')", " ist", False), ("canton", "ORG", "la ", f"concat('République et Canton de ', CASE WHEN {K} % 2 = 0 THEN 'Genève' ELSE 'Neuchâtel' END)", ".", True), ("department", "ORG", "das ", f"concat('Bildungs- und Kulturdepartement', ' BKD')", " teilt", True),
    ],
    "catalogues": [
        ("status", "MARITALSTATUS", "Zivilstand: ", f"CASE {K} % 3 WHEN 0 THEN 'ledig' WHEN 1 THEN 'verheiratet' ELSE 'in eingetragener Partnerschaft' END", ".", True), ("status_alone", "MARITALSTATUS", "Er ist ", f"CASE {K} % 2 WHEN 0 THEN 'ledig' ELSE 'verheiratet' END", ".", False), ("religion", "RELIGION", "Konfession: ", f"CASE {K} % 2 WHEN 0 THEN 'konfessionslos' ELSE 'römisch-katholisch' END", "", True),
        ("sex", "SEX", "Geschlecht: ", f"CASE {K} % 2 WHEN 0 THEN 'weiblich' ELSE 'männlich' END", "", True), ("sex_short", "SEX", "sexe: ", f"CASE {K} % 2 WHEN 0 THEN 'f' ELSE 'm' END", " ok", True), ("sex_far", "SEX", "sexe de la personne: ", f"CASE {K} % 2 WHEN 0 THEN 'f' ELSE 'm' END", " ok", False), ("residence", "RESIDENCE_STATUS", "Meldeverhältnis: ", f"CASE {K} % 2 WHEN 0 THEN 'Hauptwohnsitz' ELSE 'Wochenaufenthalt' END", "", True),
        ("residence_plain", "RESIDENCE_STATUS", "Meldeverhaeltnis: ", f"CASE {K} % 2 WHEN 0 THEN 'Niederlassung' ELSE 'Nebenwohnsitz' END", "", True), ("residence_line", "RESIDENCE_STATUS", "Meldeverhältnis:\n", f"CASE {K} % 2 WHEN 0 THEN 'Niederlassung' ELSE 'Nebenwohnsitz' END", "", False),
    ],
}
# One word in two sentences is a name with a small word that the rule doesn't know.
for _own in PROBES.values():
    _own[:] = [p for p in _own if p[5] is not None]


def _text(s: str, python: bool) -> str:
    """A string in SQL; Spark reads escapes in its literals, DuckDB takes them as they stand."""
    s = s.replace("'", "''") if not python else s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{s}'"


def _probe_sql(family: str) -> str:
    found = []
    for name, tag, before, value, _, ok in PROBES[family]:
        if ok:
            own = value.replace("\\\\", "\\")
            found.append(f"SELECT '{name}' AS probe, {K}, '{tag}' AS tag, {len(before)} AS start_pos, {len(before)} + CAST(length({own}) AS INT) AS end_pos, {own} AS value FROM customer")
    return " UNION ALL ".join(found)


def _probes(spark: SparkSession, d: str, family: str) -> DataFrame:
    """Every customer in every sentence of a family; spans of the tag that the sentence is about."""
    own = table(spark, d, "customer").select(K)
    sentence = F.array(*[F.struct(F.lit(n).alias("probe"), F.lit(t).alias("want"), F.concat(F.lit(b), F.expr(v.replace("''''", "\"'\"")), F.lit(a)).alias("text")) for n, t, b, v, a, _ in PROBES[family]])
    rows = spread(own).select(K, F.explode(sentence).alias("p")).select(K, "p.probe", "p.want", "p.text")
    found = rows.select("probe", K, "want", "text", F.explode(recognised("text")).alias("s")).where("s.tag = want")
    return found.select("probe", K, F.col("want").alias("tag"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


@query(_probe_sql("numbers"))
def number_spans(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d, "numbers")


@query(_probe_sql("contacts"))
def contact_spans(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d, "contacts")


@query(_probe_sql("places"))
def place_spans(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d, "places")


@query(_probe_sql("organisations"))
def organisation_spans(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d, "organisations")


@query(_probe_sql("catalogues"))
def catalogue_spans(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d, "catalogues")


def _at(column: str, i: str) -> str:
    return f"CAST(substr({column}, CAST({i} AS BIGINT), 1) AS INT)"


_NUMBER = lambda width: f"lpad(CAST(CAST({K} AS HUGEINT) * 7919 % {10**width} AS VARCHAR), {width}, '0')"
_EAN = f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: {_at('b', 'i')} * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR)"
_UID = "11 - list_sum(list_transform(range(1, 9), lambda i: " + _at("u", "i") + " * [5, 4, 3, 2, 7, 6, 5, 4][i])) % 11"
_LUHN = f"CAST((10 - list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN 2 * {_at('b', 'i')} - CASE WHEN {_at('b', 'i')} > 4 THEN 9 ELSE 0 END ELSE {_at('b', 'i')} END)) % 10) % 10 AS VARCHAR)"
_QR = "(10 - list_reduce(list_prepend(0, list_transform(range(1, 27), lambda i: " + _at("b", "i") + ")), lambda a, x: [0, 9, 4, 6, 8, 2, 7, 1, 3, 5][(a + x) % 10 + 1])) % 10"
_GROUPS = lambda c, starts, size, sep: " || ".join(f"{'' if i == 0 else repr(sep) + ' || '}substr({c}, {s}, {size})" for i, s in enumerate(starts))

_IDENTIFIERS = f"""
    WITH ahv AS (SELECT {K}, b || {_EAN} AS n FROM (SELECT {K}, '756' || {_NUMBER(9)} AS b FROM customer)),
    gln AS (SELECT {K}, b || {_EAN} AS n FROM (SELECT {K}, '7601' || {_NUMBER(8)} AS b FROM customer)),
    tries AS (SELECT {K}, i, lpad(CAST((CAST({K} AS HUGEINT) * 7919 % 100000000 + i) % 100000000 AS VARCHAR), 8, '0') AS u FROM customer, (SELECT unnest(range(0, 10)) AS i)),
    uid AS (SELECT {K}, arg_min(u || CAST(c % 11 AS VARCHAR), i) AS n FROM (SELECT *, {_UID} AS c FROM tries) WHERE c <> 10 GROUP BY 1),
    iban AS (SELECT {K}, 'CH' || lpad(CAST(98 - CAST('762' || b || '121700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || '00762' || b AS n FROM (SELECT {K}, {_NUMBER(12)} AS b FROM customer)),
    qr AS (SELECT {K}, b || CAST({_QR} AS VARCHAR) AS n FROM (SELECT {K}, {_NUMBER(26)} AS b FROM customer)),
    card AS (SELECT {K}, b || {_LUHN} AS n FROM (SELECT {K}, '4' || {_NUMBER(14)} AS b FROM customer)),
    v AS (SELECT {K}, 'AHVN13' AS tag, {_GROUPS("n", (1, ), 3, ".")} || '.' || substr(n, 4, 4) || '.' || substr(n, 8, 4) || '.' || substr(n, 12, 2) AS value FROM ahv
    UNION ALL SELECT {K}, 'GLN', n FROM gln
    UNION ALL SELECT {K}, 'UID', 'CHE-' || {_GROUPS("n", (1, 4, 7), 3, ".")} FROM uid
    UNION ALL SELECT {K}, 'IBAN', {_GROUPS("n", (1, 5, 9, 13, 17, 21), 4, " ")} FROM iban
    UNION ALL SELECT {K}, 'QR_REFERENCE', substr(n, 1, 2) || ' ' || {_GROUPS("n", (3, 8, 13, 18, 23), 5, " ")} FROM qr
    UNION ALL SELECT {K}, 'CREDITCARD', {_GROUPS("n", (1, 5, 9, 13), 4, " ")} FROM card)"""


@query(f"{_IDENTIFIERS} SELECT {K}, tag, value, true AS valid, false AS broken_valid FROM v")
def made_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with check digits for every customer, and that one more in the last digit breaks them."""
    broken = lambda v: F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.pmod(F.substring(v, F.length(v), F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    made = F.array(*[F.struct(F.lit(tag).alias("tag"), make(F.col(K)).alias("value")) for tag, make in checksums.GENERATORS.items()])
    rows = table(spark, d, "customer").select(K, F.explode(made).alias("m")).select(K, "m.tag", "m.value")
    valid = lambda c: F.coalesce(*[F.when(F.col("tag") == tag, check(c)) for tag, check in checksums.VALIDATORS.items()])
    return rows.select(K, "tag", "value", valid(F.col("value")).alias("valid"), valid(broken(F.col("value"))).alias("broken_valid"))


@query(f"{_IDENTIFIERS} SELECT {K}, tag, CAST(length(value) + 21 AS INT) AS start_pos, CAST(2 * length(value) + 21 AS INT) AS end_pos FROM v")
def identifier_spans(spark: SparkSession, d: str) -> DataFrame:
    """In each text a number with a wrong last digit, then the right one, behind an anchor; of the tag only the right one is
    found."""
    broken = lambda v: F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.pmod(F.substring(v, F.length(v), F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    made = F.array(*[F.struct(F.lit(tag).alias("tag"), make(F.col(K)).alias("value")) for tag, make in checksums.GENERATORS.items()])
    rows = spread(table(spark, d, "customer").select(K)).select(K, F.explode(made).alias("m")).select(K, "m.tag", F.concat(F.lit("Falsch "), broken(F.col("m.value")), F.lit(", GLN richtig "), F.col("m.value"), F.lit(".")).alias("text"))
    found = rows.select(K, F.col("tag").alias("want"), F.explode(recognised("text")).alias("s")).where("s.tag = want")
    return found.select(K, F.col("want").alias("tag"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos")).where("end_pos > 20")


# The chain, over letters in which every detail is known.
_RULES = [{"id": "rechtsmittel", "placeholder": "Rechtsmittel", "type": "wordlist", "words": ["Einsprache", "Beschwerde"]}, {"id": "dossier", "placeholder": "Dossier", "type": "label", "value_form": "digits", "min": 3, "max": 8, "labels": ["Dossier"]}]
_LETTER = f"concat('Einsprache von Anna Keller', {K} % 50, ' (kunde', {K}, '@example.ch), Dossier ', 1000 + {K} % 500, '. Keller', {K} % 50, ' schrieb an kunde', {K}, '@example.ch. Die Beschwerde folgt. IBAN folgt.')"


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters and the spans that a model would give: the name, a place below its threshold, a name cut inside a word."""
    rows = spread(table(spark, d, "customer").select(K)).select(K, F.expr(_LETTER).alias("text"))
    name = F.length(F.concat(F.lit("Anna Keller"), F.pmod(F.col(K), F.lit(50)).cast("string"))).cast("int")
    span = lambda tag, a, b, score: F.struct(F.lit(tag).alias("tag"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(score).alias("score"))
    scored = F.array(span("FULLNAME", F.lit(15), F.lit(15) + name, 0.9), span("CITY", F.lit(0), F.lit(10), 0.42), span("ORG", F.length("text") - 11, F.length("text") - 9, 0.8))
    return rows.withColumn("scored", scored)


_MASKED_LETTER = f"'[Rechtsmittel_1] von [FULLNAME_1] ([EMAIL_1]), Dossier [Dossier_1]. [FULLNAME_1a] schrieb an [EMAIL_1]. Die [Rechtsmittel_2] folgt. [ORG_1] folgt.'"


@query(f"SELECT {K}, {_MASKED_LETTER} AS masked, CAST(7 AS INT) AS entries, 'Anna Keller' || CAST({K} % 50 AS VARCHAR) AS name, 'Keller' || CAST({K} % 50 AS VARCHAR) AS short, 'kunde' || CAST({K} AS VARCHAR) || '@example.ch' AS mail, CAST(1 AS INT) AS dropped, 'unter Schwelle 0.50 (0.42)' AS reason, CAST(1 AS INT) AS widened, {_LETTER} AS restored FROM customer")
def masked_letters(spark: SparkSession, d: str) -> DataFrame:
    """Recognise, apply the user's rules, merge with scored spans, follow, number, replace, and back."""
    own = rules.load(_RULES)
    out = mask.filter_texts(_letters(spark, d), "text", "scored", own)
    word = lambda ph: F.element_at("dictionary", F.lit(ph))
    return out.select(K, "masked", F.size("dictionary").alias("entries"), word("[FULLNAME_1]").alias("name"), word("[FULLNAME_1a]").alias("short"), word("[EMAIL_1]").alias("mail"), F.size("dropped").alias("dropped"), F.col("dropped")[0]["reason"].alias("reason"), "widened", mask.restore(F.col("masked"), F.col("dictionary")).alias("restored"))


@query(f"""WITH t AS (SELECT {K}, {_LETTER} AS text, CAST(length('Anna Keller' || CAST({K} % 50 AS VARCHAR)) AS INT) AS n FROM customer), m AS (SELECT {K}, text, n, 'kunde' || CAST({K} AS VARCHAR) || '@example.ch' AS mail FROM t)
    SELECT {K}, 'FULLNAME' AS tag, 15 AS start_pos, 15 + n AS end_pos, 'model' AS source FROM m
    UNION ALL SELECT {K}, 'EMAIL', 17 + n, 17 + n + CAST(length(mail) AS INT), 'regex' FROM m
    UNION ALL SELECT {K}, 'EMAIL', CAST(length(text) - 35 - length(mail) AS INT), CAST(length(text) - 35 AS INT), 'regex' FROM m
    UNION ALL SELECT {K}, 'ORG', CAST(length(text) - 11 AS INT), CAST(length(text) - 7 AS INT), 'model' FROM m""")
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Scored and recognised spans of the letters in one list, without rules and without following."""
    from ..operators.spans import merge

    own = _letters(spark, d).withColumn("m", merge(F.col("text"), F.col("scored"), recognised("text")))
    rows = own.select(K, F.explode("m.spans").alias("s"))
    return rows.select(K, "s.tag", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), "s.source")


@query(f"""WITH t AS (SELECT {K}, CAST(length('Ina Rot-Blau' || CAST({K} AS VARCHAR)) AS INT) AS n FROM customer), p AS (SELECT {K}, n, 5 + n AS e, n - 8 AS m FROM t)
    SELECT {K}, 5 AS start_pos, e AS end_pos, 'model' AS source FROM p UNION ALL SELECT {K}, e + 2, e + 2 + m, 'propagation' FROM p
    UNION ALL SELECT {K}, e + m + 7, e + m + 7 + n, 'propagation' FROM p UNION ALL SELECT {K}, e + m + n + 16, e + m + n + 19, 'propagation' FROM p""")
def followed_names(spark: SparkSession, d: str) -> DataFrame:
    """A name, then its last part, the whole name again, and one of its parts before a hyphen."""
    key = F.col(K).cast("string")
    text = F.concat(F.lit("Frau Ina Rot-Blau"), key, F.lit(". Blau"), key, F.lit(" und Ina Rot-Blau"), key, F.lit(" gingen. Rot-Blauer nicht, rot auch nicht."))
    end = (F.length(F.concat(F.lit("Ina Rot-Blau"), key)) + 5).cast("int")
    seed = F.array(F.struct(F.lit("FULLNAME").alias("tag"), F.lit(5).alias("start"), end.alias("end"), F.lit(None).cast("string").alias("canonical"), F.lit("model").alias("source")))
    rows = spread(table(spark, d, "customer").select(K)).select(K, text.alias("text"), seed.alias("spans"))
    got = rows.select(K, F.explode(mask.propagate(F.col("text"), F.col("spans"))).alias("s"))
    return got.select(K, F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), "s.source")


@query("""WITH g AS (SELECT trim(name_form) AS name, CASE kind WHEN 'given' THEN 'GIVENNAME' ELSE 'FULLNAME' END AS tag FROM name_weights WHERE name_form IS NOT NULL AND regexp_matches(trim(name_form), '^[A-Za-z]+$')),
    b AS (SELECT name, max(tag) AS tag FROM g GROUP BY 1)
    SELECT c_custkey, b.tag, CAST(8 AS INT) AS start_pos, CAST(8 + length(b.name) AS INT) AS end_pos FROM (SELECT c_custkey, name FROM customer, (SELECT list(name ORDER BY name) AS l FROM b), LATERAL (SELECT l[c_custkey % len(l) + 1] AS name)) JOIN b USING (name)""")
def gazetteer_finds(spark: SparkSession, d: str) -> DataFrame:
    """Names of the name list in sentences made of them, by the word-list scorer."""
    names = table(spark, d, "name_weights").where("name_form is not null").select(F.trim("name_form").alias("name"), F.when(F.col("kind") == "given", "GIVENNAME").otherwise("FULLNAME").alias("tag"), F.lit(0.9).alias("score")).where(F.col("name").rlike("^[A-Za-z]+$"))
    scorer = scoring.GazetteerScorer(names)
    listed = F.split(F.lit("|".join(sorted(w[0] for w in scorer.entries))), "[|]")
    own = F.element_at(listed, (F.pmod(F.col(K), F.size(listed)) + 1).cast("int"))
    rows = table(spark, d, "customer").select(K, F.concat(F.lit("gestern "), own, F.lit(" da")).alias("text"))
    found = scorer.scored(rows, "text", "s").select(K, F.explode("s").alias("s"))
    return found.select(K, "s.tag", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))
