"""What is left readable and may still be personal: coarse patterns over the text that no span covers."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .recognise import lists_array

# Kinds of suspicion and their patterns, and words that are harmless at the start of a find.
PATTERNS = {
    "Ziffernfolge": r"\b\d[\d'.\- ]{3,}\d\b",
    "Grossschreibung": r"\b[A-ZÄÖÜÀ-Þ][a-zäöüà-ÿ'’\-]{2,}(?: +[A-ZÄÖÜÀ-Þ][a-zäöüà-ÿ'’\-]{2,}){0,2}\b",
    "Adresszeichen": r"\S+@\S+|https?://\S+|\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "Pfad": r"(?:[A-Z]:\\|/)(?:[\w.\-]+[/\\]){1,}[\w.\-]*",
}
HARMLESS = (
    "Der", "Die", "Das", "Ein", "Eine", "Sehr", "Mit", "Bei", "Von", "Für", "Herr", "Frau", "Guten", "Freundliche", "Grüsse", "Betreff",
    "Datum", "Le", "La", "Les", "Un", "Une", "Monsieur", "Madame", "Objet", "Il", "Lo", "Gli", "Signor", "Signora", "Oggetto", "The", "This",
    "Dear", "Vielen", "Viele", "Herzlichen", "Besten", "Ihr", "Ihre", "Ihrer", "Ihren", "Ihrem", "Unser", "Unsere", "Unserer", "Diese",
    "Dieser", "Dieses", "Sobald", "Falls", "Damit", "Dabei", "Zudem", "Ausserdem", "Weitere", "Liebe", "Lieber", "Geschätzte", "Hallo", "Beste",
    "Merci", "Votre", "Vos", "Notre", "Nos", "Cette", "Cordialement", "Veuillez", "Vostro", "Vostra", "Nostro", "Nostra", "Questa", "Questo",
    "Gentile", "Your", "Our", "These", "Kind", "Best", "Please", "Thank", "Thanks", "Beim", "Nach", "Vor", "Seit", "Aus", "Auf", "Ohne",
    "Gegen", "Wegen", "Aufgrund", "Gestützt", "Betreffend", "Zur", "Zum", "Als", "Sollte", "Sofern", "Nachdem", "Bevor", "Anbei", "Gerne",
    "Leider", "Subject", "Regards", "Ciao", "Caro", "Cara", "Cari", "Salve", "Buongiorno", "Bonjour", "Chère", "Cher", "Meilleures", "Cordiali",
    "Caso", "Come", "Spero", "Herzliche", "Schöne", "Sonnige", "Werte", "Freundlicher", "Warme", "Liebste", "Bester", "Lieben", "Herzlichst",
    "Haben", "Können", "Möchten", "Wollen", "Sollten", "Dürfen", "Müssen", "Sind", "Ist", "Wird", "Werden", "Wurde", "Wurden", "Brauchen",
    "Benötigen", "Melden", "Kontaktieren", "Antworten", "Klicken",
)
FOUND = "array<struct<start:int,end:int,kind:string,value:string>>"
_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_HARMLESS = frozenset(HARMLESS)


def united(places: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of united places; those that touch are one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(x for x in places if x[0] < x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _opens(text: str, at: int) -> bool:
    """Whether a sentence begins at a place: nothing but white space, or a mark that ends one, stands before it."""
    while at and text[at - 1].isspace():
        at -= 1
    return at == 0 or text[at - 1] in ".!?:"


def finds(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    starts, ends = united(places)
    found = []
    for rank, (kind, pattern) in enumerate(_COMPILED.items()):
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect_right(starts, a) - 1
            if k >= 0 and ends[k] >= b:
                continue
            if kind == "Grossschreibung":
                words = m[0].split()
                if words[0] in _HARMLESS or len(words) == 1 and _opens(text, a):
                    continue
            found.append((a, rank, b, kind, m[0]))
    out: list[tuple[int, int, str, str]] = []
    for a, _, b, kind, value in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind, value))
    return out


def suspicious(text: Column, spans: Column, most: int | None = None) -> Column:
    """array<struct<start, end, kind, value>>, by start; of finds that overlap the first stays, and of those with one start
    that of the earlier kind. Finds that spans cover whole are left out, as are those that begin with a harmless word and
    single capitalised words at the start of a sentence. most limits the list of a text. Null texts have none."""

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = [finds(t or "", [(s["start"], s["end"]) for s in row or () if s is not None])[:most] for t, row in zip(texts.to_pylist(), own.to_pylist())]
        return lists_array(rows, ["start", "end", "kind", "value"], [pa.int32(), pa.int32(), pa.string(), pa.string()])

    return found(text, spans.cast("array<struct<start:int,end:int>>"))
