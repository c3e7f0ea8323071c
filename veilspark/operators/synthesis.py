"""Synthetic labelled texts from templates: values drawn from lists, coupled addresses, running dates, macros, decoys, noise.

Every row is made from its own id and the seed, so a data set is the same whatever the number of partitions.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from math import isqrt
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import CARRY, UID_WEIGHTS
from ..functions.contract import STAGES
from ..functions.text import BIRTH, MONTHS

SLOT = re.compile(r"\{([~@]?)([A-Za-z0-9_]+)\}")
#: Values of a list at most, as the lists go to every worker.
MOST_VALUES = 2_000_000

# Tags whose values may be noisy and have a held-out tenth, the share of a language's own list where a
# general one stands beside it, letters that old systems write otherwise, and area codes in use.
NOISY = frozenset(("FULLNAME", "GIVENNAME", "STREET", "CITY", "ORG", "PLACE_OF_ORIGIN"))
HELD_OUT = 10
SHARED = {"ORG": 0.5}
PLAIN = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "à": "a", "é": "e", "è": "e", "ê": "e", "î": "i", "ô": "o", "û": "u", "ç": "c"}
AREAS = ("21", "22", "24", "26", "27", "31", "32", "33", "34", "41", "43", "44", "51", "52", "55", "56", "58", "61", "62", "71", "76", "77", "78", "79", "81", "91")
CANTONS = "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD VS ZG ZH".split()

# Parts of a macro by language ("" for all), with their weight; upper case names a slot.
MACROS: dict[str, list[tuple[str, int, tuple[str, ...]]]] = {
    "address": [("", 1, ("STREET", " ", "BUILDINGNUM", ", ", "ZIPCODE", " ", "CITY")), ("", 1, ("STREET", " ", "BUILDINGNUM", "\n", "ZIPCODE", " ", "CITY")), ("", 1, ("STREET", " ", "BUILDINGNUM")), ("", 1, ("ZIPCODE", " ", "CITY"))],
    "plz_ort": [("", 1, ("ZIPCODE", " ", "CITY"))],
    "person": [
        ("", 4, ("GIVENNAME", " ", "FULLNAME")), ("", 4, ("FULLNAME", " ", "GIVENNAME")), ("", 2, ("FULLNAME",)),
        ("de", 2, ("GIVENNAME", " ", "FULLNAME", ", geboren am ", "DATE")), ("fr", 2, ("GIVENNAME", " ", "FULLNAME", ", né le ", "DATE")), ("it", 2, ("GIVENNAME", " ", "FULLNAME", ", nato il ", "DATE")), ("en", 2, ("GIVENNAME", " ", "FULLNAME", ", born on ", "DATE")),
    ],
    "person_feld": [("", 1, ("FULLNAME", ", ", "GIVENNAME"))],
    "origin": [("", 1, ("PLACE_OF_ORIGIN",))],
    "contact": [
        ("de", 1, ("Telefon ", "PHONE", ", ", "EMAIL")), ("fr", 1, ("téléphone ", "PHONE", ", ", "EMAIL")), ("it", 1, ("telefono ", "PHONE", ", ", "EMAIL")), ("en", 1, ("phone ", "PHONE", ", ", "EMAIL")), ("", 1, ("PHONE",)), ("", 1, ("EMAIL",)),
    ],
}

# Phrases that look like a detail and are none, by kind and language.
DECOYS: dict[str, dict[str, tuple[str, ...]]] = {
    "amount": {
        "de": ("der Vermoegensfreibetrag von 4000 Franken", "die Gebuehr von CHF 50.00", "der Grundbedarf von CHF 1'200.00", "eine Pauschale von CHF 300.00"),
        "fr": ("la franchise de 300 francs", "l'émolument de CHF 50.00", "le montant maximal de CHF 1'200.00", "un forfait de CHF 300.00"),
        "it": ("la franchigia di 300 franchi", "la tassa di CHF 50.00", "l'importo massimo di CHF 1'200.00", "un forfait di CHF 300.00"),
        "en": ("the tax-free allowance of CHF 4,000", "the fee of CHF 50.00", "a flat rate of CHF 300.00"),
    },
    "legal": {
        "de": ("Art. 6 Abs. 1 Bst. i RHG (SR 431.02)", "Art. 12 Abs. 3 DSG (SR 235.1)", "gestuetzt auf Art. 5 ZGB"),
        "fr": ("art. 6 al. 1 let. i LHR (RS 431.02)", "art. 12 al. 3 LPD (RS 235.1)", "fondé sur l'art. 5 CC"),
        "it": ("art. 6 cpv. 1 lett. i LArRa (RS 431.02)", "art. 12 cpv. 3 LPD (RS 235.1)", "fondato sull'art. 5 CC"),
        "en": ("Art. 6 para. 1 let. i RHA (SR 431.02)", "Art. 12 para. 3 FADP (SR 235.1)"),
    },
    "deadline": {
        "de": ("innert 30 Tagen", "binnen 10 Arbeitstagen", "innerhalb von 3 Monaten"),
        "fr": ("dans un délai de 30 jours", "sous 10 jours ouvrables", "dans les 3 mois"),
        "it": ("entro 30 giorni", "entro 10 giorni lavorativi", "entro 3 mesi"),
        "en": ("within 30 days", "within 10 working days", "within 3 months"),
    },
    "number": {
        "de": ("Version 2.1", "Seite 3 von 12", "Formular 1150", "Raum 204", "Postfach 3001"),
        "fr": ("version 2.1", "page 3 sur 12", "formulaire 1150", "bureau 204", "case postale 3001"),
        "it": ("versione 2.1", "pagina 3 di 12", "modulo 1150", "ufficio 204", "casella postale 3001"),
        "en": ("version 2.1", "page 3 of 12", "form 1150", "room 204", "P.O. Box 3001"),
    },
    "technical": {
        "de": ("Exit-Code 137", "Port 5432", "HTTP 502 Bad Gateway", "Build 2024.3.1-rc2", "PID 18442", "Commit a3f91c", "Speicherbedarf 4096 MB", "Timeout nach 30000 ms"),
        "fr": ("code de sortie 137", "port 5432", "HTTP 502 Bad Gateway", "build 2024.3.1-rc2", "PID 18442", "commit a3f91c", "délai dépassé après 30000 ms"),
        "it": ("codice di uscita 137", "porta 5432", "HTTP 502 Bad Gateway", "build 2024.3.1-rc2", "PID 18442", "commit a3f91c", "timeout dopo 30000 ms"),
        "en": ("exit code 137", "port 5432", "HTTP 502 Bad Gateway", "build 2024.3.1-rc2", "PID 18442", "commit a3f91c", "timed out after 30000 ms"),
    },
    "trace": {
        "de": ("at ch.example.registry.PersonService.load(PersonService.java:214)", "NullPointerException in Zeile 88", "java.sql.SQLException: ORA-01722: invalid number", "Stack: 0x00007ffce4a1b230"),
        "fr": ("at ch.example.registry.PersonService.load(PersonService.java:214)", "NullPointerException à la ligne 88", "java.sql.SQLException: ORA-01722: invalid number"),
        "it": ("at ch.example.registry.PersonService.load(PersonService.java:214)", "NullPointerException alla riga 88", "java.sql.SQLException: ORA-01722: invalid number"),
        "en": ("at ch.example.registry.PersonService.load(PersonService.java:214)", "NullPointerException at line 88", "java.sql.SQLException: ORA-01722: invalid number"),
    },
    "place": {
        "de": ("im Sinne von Art. 2", "gemaess Ziffer 4.2"),
        "fr": ("au sens de l'art. 2", "selon le chiffre 4.2"),
        "it": ("ai sensi dell'art. 2", "secondo la cifra 4.2"),
        "en": ("within the meaning of Art. 2", "under section 4.2"),
    },
}
# Kinds that templates of other collections use.
DECOYS["statute"] = DECOYS["legal"]
DECOYS["ahv"] = {"de": ("Beleg-Nr. 756.1234.5678.90",), "fr": ("pièce no 756.1234.5678.90",), "it": ("ricevuta n. 756.1234.5678.90",), "en": ("receipt no. 756.1234.5678.90",)}
_BIRTH = re.compile(r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in BIRTH) + r")\b")
_UNFILLED = re.compile(r"<[A-Z][A-Z0-9_]{2,}>")


def in_held_out_zone(name: str) -> bool:
    return int(sha256(name.encode()).hexdigest()[:8], 16) % HELD_OUT == 0


class Values:
    """Lists of values by tag (or tag@language) with running sums of dampened weights, and addresses of one record each."""

    def __init__(self, lists: dict[str, list[tuple[str, int]]], addresses: list[tuple[str, str, str]], zone: str | None = None):
        if zone not in (None, "training", "held_out"):
            raise ValueError(f"zone {zone!r}")
        self.addresses = addresses
        self.lists: dict[str, tuple[list[str], list[int]]] = {}
        for tag, rows in lists.items():
            own = rows
            if zone and tag.split("@")[0] in NOISY:
                # A list without a value in the zone stays whole.
                own = [r for r in rows if in_held_out_zone(r[0]) == (zone == "held_out")] or rows
            if own:
                self.lists[tag] = ([n for n, _ in own], list(accumulate(max(1, isqrt(max(0, w))) for _, w in own)))

    def draw(self, tag: str, lang: str, rng: Random) -> str | None:
        """A value by weight: from the language's own list where there is one, unless it shares with the general one."""
        own = f"{tag}@{lang}"
        if own not in self.lists or tag in SHARED and tag in self.lists and rng.random() >= SHARED[tag]:
            own = tag
        if own not in self.lists:
            return None
        names, sums = self.lists[own]
        return names[bisect_right(sums, rng.randrange(sums[-1]))]


def _ean(body: str) -> str:
    return body + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(body)) % 10)


def _number(tag: str, rng: Random) -> str | None:
    """Valid numbers with check digits, in their usual spelling."""
    if tag == "AHVN13":
        n = _ean(f"756{rng.randrange(10**9):09d}")
        return f"{n[:3]}.{n[3:7]}.{n[7:11]}.{n[11:]}"
    if tag == "GLN":
        return _ean(f"7601{rng.randrange(10**8):08d}")
    if tag == "UID":
        while True:
            n = f"{rng.randrange(10**8):08d}"
            check = -sum(int(c) * w for c, w in zip(n, UID_WEIGHTS)) % 11
            if check < 10:
                return f"CHE-{n[:3]}.{n[3:6]}.{n[6:]}{check}"
    if tag == "IBAN":
        account = f"00762{rng.randrange(10**12):012d}"
        n = f"CH{98 - int(account + '121700') % 97:02d}{account}"
        return " ".join(n[i : i + 4] for i in range(0, len(n), 4))
    if tag == "QR_REFERENCE":
        n, carry = f"{rng.randrange(10**26):026d}", 0
        for c in n:
            carry = CARRY[(carry + int(c)) % 10]
        n += str(-carry % 10)
        return " ".join([n[:2], *(n[i : i + 5] for i in range(2, 27, 5))])
    if tag == "CREDITCARD":
        n = f"4{rng.randrange(10**14):014d}"
        check = -sum(sum(divmod(int(c) * (1 if i % 2 else 2), 10)) for i, c in enumerate(n)) % 10
        n += str(check)
        return " ".join(n[i : i + 4] for i in range(0, 16, 4))
    return None


# The shapes of values that no list holds. {a-b} is a number, of the width of a if that starts with 0, {x|y}
# one of several, {AREA} an area code and {CANTON} a canton.
SHAPES = {
    "TIME": "{07-18}:{00|15|30|45}",
    "PHONE": "{+41 |0}{AREA} {100-999} {10-99} {10-99}",
    "EMAIL": "{info|kontakt|a.muster|m.beispiel}@{example.ch|muster.ch|gemeinde.ch}",
    "AGE": "{18-92}",
    "AMOUNT": "CHF {1-9}'{000-999}.{00|50|--}",
    "EGID": "{100000-9999999}",
    "EWID": "{1-120}",
    "MUNICIPALITY_ID": "{1-6810}",
    "PLATE": "{CANTON} {1-999999}",
    "CANTON": "{CANTON}",
    "CASE_ID": "{EWK|SOZ|BAU|STA}-{2015-2026}-{00001-99999}",
    "IDDOC": "{X|S|F|C|A}{1000000-9999999}",
    "PARCEL": "{1-4999}",
    "BUILDINGNUM": "{1-120}{|||a|b}",
    "ZIPCODE": "{1000-9657}",
    "URL": "https://www.{example|muster|gemeinde}.ch/{formular|dienste|a/b}",
    "ZSR_RCC": "{A|B|C|D|E|F|G|H|K|L|M|N|P|R|S|T|V|W|Z}{100000-999999}",
    "INSURANCE_CARD": "80756{000000000000000-999999999999999}",
    "IPADDRESS": "{1-254}.{1-254}.{1-254}.{1-254}",
}
_HOLE, _RANGE = re.compile(r"\{([^{}]*)\}"), re.compile(r"(\d+)-(\d+)")


def made(tag: str, rng: Random) -> str:
    """A value of the tag's shape; <TAG> for tags that have neither list nor shape."""

    def fill(hole: re.Match) -> str:
        if bounds := _RANGE.fullmatch(hole[1]):
            number = str(rng.randint(int(bounds[1]), int(bounds[2])))
            return number.zfill(len(bounds[1])) if bounds[1][0] == "0" else number
        return rng.choice({"AREA": AREAS, "CANTON": CANTONS}.get(hole[1]) or hole[1].split("|"))

    return _HOLE.sub(fill, SHAPES.get(tag, f"<{tag}>"))


def noisy_value(value: str, rng: Random) -> str:
    """One error that people or old systems make: letters swapped, dropped, doubled, written without marks, or upper case.
    Values below four letters stay, and so does the first letter."""
    if len(value) < 4:
        return value
    kind, i = rng.randrange(5), rng.randrange(1, len(value) - 1)
    if kind == 0:
        return "".join(PLAIN.get(c, c) for c in value)
    if kind == 1:
        return value.upper()
    head, c, tail = value[:i], value[i], value[i + 1 :]
    return head + (tail[0] + c + tail[1:] if kind == 2 else tail if kind == 3 else c + c + tail)


def announces_birth_text(before: str) -> bool:
    near = re.split(r"[.\n;]", before)[-1][-40:].lower()
    return bool(_BIRTH.search(re.sub(r"[^\w\s]", " ", near)))


def shown(day: datetime.date, lang: str, rng: Random) -> str:
    names = MONTHS.get(lang, MONTHS["de"])
    written = f"{day.day}{' ' if lang in ('fr', 'it', 'en') else '. '}{names[day.month - 1]} {day.year}"
    dotted = f"{day:%d.%m.%Y}"
    return rng.choice((dotted, written, f"{day:%Y-%m-%d}" if lang == "en" else dotted))


Made = tuple[str, list[tuple[str, int, int, str | None]], list[tuple[int, int, str]]]
#: A piece of a template: what it is ("" literal, "tag", "decoy"), its text or name, and the macro it belongs to.
Piece = tuple[str, str, str | None]


def pieces(template: str, lang: str, rng: Random) -> list[Piece] | None:
    """A template in pieces, its macros replaced by one of their variants for the language; None if a macro or a decoy is
    unknown."""
    literals = SLOT.split(template)
    out: list[Piece] = [("", literals[0], None)]
    for k, (mark, name, literal) in enumerate(zip(literals[1::3], literals[2::3], literals[3::3])):
        if mark == "@":
            variants = [v for v in MACROS.get(name, ()) if v[0] in ("", lang)]
            if not variants:
                return None
            [(_, _, parts)] = rng.choices(variants, [v[1] for v in variants])
            out += [("tag" if x.isupper() and x.isidentifier() else "", x, f"@{name}:{k}") for x in parts]
        elif mark == "~" and name not in DECOYS:
            return None
        else:
            out.append(("decoy" if mark else "tag", name, None))
        out.append(("", literal, None))
    return out


class Letter:
    """The values of one text: its own date and those that follow it, an address for each macro, and what lists and shapes
    give."""

    def __init__(self, lang: str, values: Values, rng: Random, noise: float):
        self.lang, self.values, self.rng, self.noise = lang, values, rng, noise
        self.day = datetime.date(2019, 1, 1) + datetime.timedelta(days=rng.randrange(2600))
        self.days = self._days()
        self.addresses: dict[str, dict[str, str]] = {}

    def _days(self) -> Iterator[datetime.date]:
        day = self.day
        while True:
            yield day
            day += datetime.timedelta(days=self.rng.randrange(1, 400))

    def date(self, before: str) -> str:
        if announces_birth_text(before):
            return shown(self.day - datetime.timedelta(days=self.rng.randrange(6570, 32850)), self.lang, self.rng)
        return shown(next(self.days), self.lang, self.rng)

    def value(self, tag: str, macro: str | None, before: str) -> str:
        if tag == "DATE":
            return self.date(before)
        if macro and tag in ("STREET", "ZIPCODE", "CITY") and self.values.addresses:
            if macro not in self.addresses:
                self.addresses[macro] = dict(zip(("STREET", "ZIPCODE", "CITY"), self.rng.choice(self.values.addresses)))
            return self.addresses[macro][tag]
        value = _number(tag, self.rng) or self.values.draw(tag, self.lang, self.rng) or made(tag, self.rng)
        return noisy_value(value, self.rng) if tag in NOISY and self.rng.random() < self.noise else value


def filled(template: str, lang: str, values: Values, rng: Random, noise: float = 0.0) -> Made | None:
    """(text, spans as (tag, start, end, macro), decoys as (start, end, kind)) of a template, or None if a slot has no value.

    {TAG} draws a value, {@macro} a variant for the language whose address belongs together, {~kind} a decoy. The first
    date is the document's own, the others follow it by up to 400 days, and an announced date of birth lies decades before.
    """
    own = pieces(template, lang, rng)
    if own is None:
        return None
    letter, text = Letter(lang, values, rng, noise), ""
    spans: list[tuple[str, int, int, str | None]] = []
    decoys: list[tuple[int, int, str]] = []
    for kind, name, macro in own:
        at = len(text)
        if kind == "tag":
            text += letter.value(name, macro, text[-80:])
            spans.append((name, at, len(text), macro))
        elif kind == "decoy":
            text += rng.choice(DECOYS[name].get(lang) or DECOYS[name]["de"])
            decoys.append((at, len(text), name))
        else:
            text += name
    if _UNFILLED.search(text) or any(not text[a:b].strip() for _, a, b, _ in spans):
        return None
    return text, spans, decoys


def values_from(lists: DataFrame, addresses: DataFrame | None = None, zone: str | None = None, most: int = MOST_VALUES) -> Values:
    """Values from tables (tag, name, weight) and (name, plz, city); nulls are left out, equal names summed. More than most
    rows raise, as the values go to every worker."""
    rows = lists.where("tag is not null and name is not null").groupBy("tag", "name").agg(F.sum(F.coalesce("weight", F.lit(1))).cast("bigint").alias("weight")).orderBy("tag", "name").limit(most + 1).collect()
    own: dict[str, list[tuple[str, int]]] = {}
    for r in rows:
        own.setdefault(r["tag"], []).append((r["name"], r["weight"]))
    places = [] if addresses is None else [(r["name"], r["plz"], r["city"]) for r in addresses.where("name is not null and plz is not null and city is not null").select("name", "plz", "city").distinct().orderBy("name", "plz", "city").limit(most + 1).collect()]
    if len(rows) > most or len(places) > most:
        raise ValueError(f"more than {most} values")
    return Values(own, places, zone)


MADE = "text string, spans array<struct<tag:string,start:int,end:int,canonical:string>>, decoys array<struct<start:int,end:int,kind:string>>"


def inject_table(rows: DataFrame, id_col: str, template_col: str, lang_col: str, values: Values, seed: int = 7, noise: float = 0.0) -> DataFrame:
    """(id, template, lang, text, spans, decoys): each template filled by its id and the seed. A null template, and one with a
    slot that has no value, gives no row."""
    shared = rows.sparkSession.sparkContext.broadcast(values)
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            out = []
            for key, template, lang in part.itertuples(index=False):
                if template is None:
                    continue
                got = filled(template, lang or "de", own, Random(f"{seed}:{key}"), noise)
                if got is not None:
                    text, spans, decoys = got
                    out.append((key, template, lang, text, [{"tag": t, "start": a, "end": b, "canonical": g} for t, a, b, g in spans], [{"start": a, "end": b, "kind": k} for a, b, k in decoys]))
            yield pd.DataFrame(out, columns=["id", "template", "lang", "text", "spans", "decoys"])

    own = rows.select(F.col(id_col).alias("id"), F.col(template_col).alias("template"), F.col(lang_col).alias("lang"))
    return own.mapInPandas(run, f"id {kinds[id_col]}, template string, lang string, {MADE}")


def generate(spark: SparkSession, templates: DataFrame, values: Values, n: int, seed: int = 0, lang: str | None = None, noise: float = 0.0) -> DataFrame:
    """n examples (fewer if most templates cannot be filled): id, template_id, lang, text, spans, decoys. Each id draws up to
    ten templates until one can be filled. Templates come to every worker; more than MOST_VALUES raise."""
    if "eval_only" in templates.columns and not templates.where("eval_only").isEmpty():
        raise ValueError("templates that are kept for evaluation make no training data")
    own = templates.where("text is not null and template_id is not null")
    own = own if lang is None else own.where(F.col("lang") == lang)
    pool = [(r["template_id"], r["text"], r["lang"] or "de") for r in own.select("template_id", "text", "lang").orderBy("template_id", "text").limit(MOST_VALUES + 1).collect() if not findings_of(r["text"])]
    if not pool or len(pool) > MOST_VALUES:
        raise ValueError("no templates, or too many")
    shared = spark.sparkContext.broadcast((pool, values))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, own = shared.value
        for part in parts:
            out = []
            for key in part["id"]:
                rng = Random(f"{seed}:{key}")
                for _ in range(10):
                    name, template, language = rng.choice(pool)
                    got = filled(template, language, own, rng, noise)
                    if got is not None:
                        text, spans, decoys = got
                        out.append((key, name, language, text, [{"tag": t, "start": a, "end": b, "canonical": g} for t, a, b, g in spans], [{"start": a, "end": b, "kind": k} for a, b, k in decoys]))
                        break
            yield pd.DataFrame(out, columns=["id", "template_id", "lang", "text", "spans", "decoys"])

    return spark.range(n).mapInPandas(run, f"id bigint, template_id string, lang string, {MADE}")


_ADJACENT, _ESCAPE = re.compile(r"\{([~@]?\w+)\}[ \t]*(?=\{\1\})"), re.compile(r"\\[nrt]")
# Labels before which a decoy of an amount, which is a phrase, makes no sentence.
_LABELLED = re.compile(r"(?i)\b(?:Geb(?:ü|ue)hr(?:enrahmen)?|Betrag|Kosten|Preis|Summe|Ansatz|(?:é|e)molument|taxe|frais|montant|tassa|importo|spese|fee|amount)\s*:?\s*\{~amount\}")


def findings_of(template: str) -> list[str]:
    """What is wrong with a template: equal slots side by side, escapes in place of their signs, a label before a phrase."""
    out = [f"equal slots side by side: {m[1]}" for m in _ADJACENT.finditer(template)]
    out += [f"escape {m[0]}" for m in _ESCAPE.finditer(template)]
    return out + [f"label before a phrase: {m[0]}" for m in _LABELLED.finditer(template)]


def check_templates(templates: DataFrame, needed: tuple[str, ...] = (), lines: tuple[int, int] = (1, 10_000)) -> DataFrame:
    """(template_id, finding): equal slots side by side, escapes, labels before phrases, unknown slots, macros and decoys,
    tags that are needed and missing, and a number of lines out of bounds. Null texts have one finding."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, text in part.itertuples(index=False):
                if text is None:
                    out.append((key, "no text"))
                    continue
                found = findings_of(text)
                slots = SLOT.findall(text)
                known = {"": STAGES, "@": MACROS, "~": DECOYS}
                found += [f"unknown slot {mark}{name}" for mark, name in dict.fromkeys(slots) if name not in known[mark]]
                found += [f"missing {t}" for t in needed if ("", t) not in slots]
                if not lines[0] <= text.count("\n") + 1 <= lines[1]:
                    found.append("number of lines")
                out += [(key, f) for f in found]
            yield pd.DataFrame(out, columns=["template_id", "finding"])

    return templates.select("template_id", "text").mapInPandas(run, "template_id string, finding string")


def implausible(text: Column, spans: Column) -> Column:
    """array<string> of findings on a text's spans: places out of bounds, blanks or marks at an edge, several values in one,
    two postcodes in one place, and overlaps with the next span."""
    value = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"))))

    def found(s: Column, i: Column) -> Column:
        following = F.get(ordered, i + 1)
        v = value(s)
        return F.array(
            F.when((s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(text)), F.concat(F.lit("place "), s["tag"])),
            F.when(v.rlike(r"^\s|\s$|[,;:]$"), F.concat(F.lit("edge "), s["tag"])),
            F.when(v.rlike(r"[;|]\s") & ~s["tag"].isin("ORG"), F.concat(F.lit("several "), s["tag"])),
            F.when((s["tag"] == "CITY") & v.rlike(r"\d{4}"), F.concat(F.lit("postcode in "), s["tag"])),
            F.when(following["start"] < s["end"], F.concat(F.lit("overlap "), s["tag"])),
        )

    return F.filter(F.flatten(F.transform(ordered, found)), lambda x: x.isNotNull())
