"""Problem 4: personal details in free text, found and replaced by typed placeholders.

High-recall generators propose overlapping spans; boosted trees score them by format and context; thresholds calibrated
on held-out rows select. Check digits of AHV numbers and IBANs are then tested exactly.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .canonical import transducer
from .common import hash_sample

TAGS = ("FULLNAME", "PHONE", "EMAIL", "AHVN13", "IBAN", "IDDOC", "STREET")
#: Labelled rows that fit the trees, at most, by hash order.
TRAIN_ROWS = 6_000
KEPT_WORDS = 200_000
#: Words of a name that may stand anywhere in a run of name-like words.
SHORT_NAME = 4
#: Forms of the name list at most; it goes to every worker.
MOST_NAMES = 2_000_000

# Forms of address and what follows the name of an organisation, in five languages.
TITLES = frozenset("herr herrn frau fräulein monsieur madame mademoiselle m mme mlle mr mrs ms miss signor signora signore signorina sig señor señora señorita sr sra dr prof".split())
ORGANISED = frozenset("ag gmbh sa sàrl sarl sagl ltd llc inc sl srl stiftung genossenschaft versicherung versicherungen treuhand immobilien fondation assurances immobilier fiduciaire fondazione assicurazioni immobiliare fiduciaria foundation insurance estates trust fundación seguros inmobiliaria gestoría verein amt partner fils figli sons hijos & co cie kg".split())
# Words that begin or end the name of a street.
STREET_FIRST = frozenset("rue rte route chemin ch avenue av quai place pl ruelle boulevard bd allée impasse via viale piazza vicolo corso largo calle c/ avenida avda plaza paseo camino am im an in auf zum zur beim unter ober untere oberer obere unterer hinter vorder neue alte".split())
STREET_LAST = ("strasse", "straße", "str", "weg", "gasse", "platz", "rain", "matte", "halde", "hof", "allee", "ring", "steig", "ufer", "quai", "gässli", "wegli", "acker", "feld", "graben", "promenade", "terrasse")
STREET_ENGLISH = frozenset("street st road rd lane ln close avenue ave drive dr court ct place way terrace crescent square row hill gardens grove mews walk".split())
IBAN_LENGTHS = {"CH": 21, "LI": 21, "DE": 22, "AT": 20, "FR": 27, "IT": 27, "ES": 24, "GB": 22, "NL": 18, "BE": 16, "LU": 20, "PT": 25, "IE": 22, "DK": 18, "SE": 24, "NO": 15, "FI": 18, "PL": 28, "CZ": 24, "HU": 28}

AT = r"(?: ?@ ?| ?[\[({] ?(?:at|ät|arroba|chiocciola|arobase) ?[\])}] ?)"
DOT = r"(?:\.| ?[\[({] ?(?:punkt|dot|point|punto|\.) ?[\])}] ?)"
# Each pattern starts with a plain character class, so that a text is searched at native speed.
SIGN = re.compile(rf"{AT}[\w-]+(?:{DOT}[\w-]+)*{DOT}[A-Za-z]{{2,10}}\b", re.I)
AT_SIGN = re.compile(r"[@\[({]")
LOCAL = re.compile(rf"[\w+-]+(?:{DOT}[\w+-]+)*$", re.I)
SPELT_SIGNS = (" at ", " arroba ", " chiocciola ", " arobase ")
SPELT = re.compile(r"[\w+.-]+ (?:at|arroba|chiocciola|arobase) [\w-]+(?: (?:punkt|dot|point|punto) [\w-]+)+", re.I)
PHONE = re.compile(r"[+(0](?<![\w+.][+(0])(?:(?:(?<=\+)|(?<=0)0)41[ ./-]?(?:\(0\) ?)?|(?<=\()0(?=\d\d\))|(?<=0))\d\d\)?[ ./-]?\d{3}[ ./-]?\d\d[ ./-]?\d\d(?!\d)")
AHVN = re.compile(r"756(?<![\w.]756)[ .-]?\d{4}[ .-]?\d{4}[ .-]?\d\d(?!\d)")
ACCOUNT = re.compile(r"\d\d(?<=[A-Za-z]{2}\d\d)(?:[ -]?\d)(?:[ -]?[\dA-Z]){10,30}")
PASSPORT = re.compile(r"[A-Z] ?\d{7}(?!\w)")
HOUSE = re.compile(r"\d(?<![\w.,'’/+-]\d)\d{0,2}[A-Za-z]?(?![\w'’/]|[.,:]\d|-\d| \d(?!\d{3} [A-ZÀ-Þ]))")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w]*(?:[-'’][^\W\d_]+)*")
# A word of a street, read backwards from its end.
WORD_BACK = re.compile(r",?[./]?[^\W\d_]++(?:[-'’./][^\W\d_]++)*+")
ENGLISH = re.compile(r"(?: [A-ZÄÖÜ][\w'’-]+){2,}\.?|(?: [A-Z]+){2,}\b\.?")
#: Words before a house number that may begin a street wherever they are capitalised.
SHORT_STREET = 5
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def ean13(digits: str) -> bool:
    return len(digits) == 13 and sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(digits)) % 10 == 0


def iban(value: str) -> bool:
    s = re.sub(r"[^A-Z0-9]", "", value.upper())
    return IBAN_LENGTHS.get(s[:2]) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Signs of a line that may be a wrapped one. Longer lines hold whole paragraphs: they end where the paragraph ends, and
#: they tell nothing of the width at which the other lines are wrapped.
WRAPPED = 110
#: Texts are not wrapped at less than this.
NARROWEST = 40


def unwrapped(text: str) -> tuple[str, list[int] | None]:
    """Canonical text with wrapped lines put together: cut words joined, and a line end as a blank where the next word
    would not have fitted the width of the text. Shorter lines stay apart, as in lists and tables; lines that hold a
    whole paragraph are joined to nothing but don't change how the others are judged. With it the positions in the text,
    if any moved."""
    if "\n" not in text:
        return transducer().with_map(text)
    lines = text.split("\n")
    sizes = sorted(map(len, lines))
    sizes = sizes[: bisect_right(sizes, WRAPPED)]
    # Headings and footers may be longer than the lines of the text.
    width = max(NARROWEST, sizes[int(0.9 * (len(sizes) - 1))]) if sizes else NARROWEST
    out, at, last, start = [], [], 0, 0
    following = 0
    for k in range(len(lines) - 1):
        line, after = lines[k], lines[k + 1]
        start, following = following, following + len(line) + 1
        body, rest = line.rstrip("\r \t"), after.lstrip(" \t")
        if not body or not rest or rest[0].isspace():
            continue
        begin = start + len(line) - len(line.lstrip(" \t")) if k else 0
        sign = body[-1] if body[-1] in "-¬\u00ad‐" else ""
        a = start + len(body) - len(sign)
        if sign:
            if a - begin < 18:
                continue
        elif not 25 <= a - begin <= WRAPPED or body[-1] in ":;!?>" or body[-1] == "." and not (body[-2:-1].isupper() and body[-3:-2] == " ") or a - begin + 1 + len(rest.split(None, 1)[0]) < width - 1 or "\t" in body:
            continue
        b = following + len(after) - len(rest)
        cut = sign and text[a - 1].isalnum() and rest[0].isalnum()
        keep = cut and sign == "-" and (rest[0].isupper() and not text[a - 1].isupper() or rest[0].isdigit())
        out.append(text[last:a] + ("-" if keep else "" if cut else sign + " "))
        at.extend(range(last, a + (bool(keep) if cut else len(sign) + 1)))
        last = b
    if not out:
        return transducer().with_map(text)
    out.append(text[last:])
    at.extend(range(last, len(text) + 1))
    plain, places = transducer().with_map("".join(out))
    return plain, [at[i] for i in places] if places else at


def fold(word: str) -> str:
    """Lower case without accents, and umlauts alike in all spellings."""
    low = word.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return low.replace("ae", "a").replace("oe", "o").replace("ue", "u")


class Lexicon:
    """What is known of words: log odds of being a given name, a surname, and of standing before a name."""

    def __init__(self, given: set[str], family: set[str], ends: dict[str, float], before: dict[str, float], used: dict[str, tuple[float, float]]):
        self.given, self.family, self.ends, self.before, self.used = given, family, ends, before, used
        self.memo: dict[str, tuple] = {}

    def word(self, token: str) -> tuple:
        """(kind: 0 other, 1 given, 2 family, 3 maybe, family score, given use, family use, initial)."""
        got = self.memo.get(token)
        if got is None:
            low = fold(token)
            parts = [p for p in re.split(r"[-'’]", low) if p]
            score = min((self.ends.get(p[-5:], self.ends.get(p[-4:], self.ends.get(p[-3:], -1.0))) for p in parts), default=-3.0)
            g, f = self.used.get(low, (0.0, 0.0))
            if len(token) == 1:
                kind = 4
            elif low in self.given or len(parts) > 1 and all(p in self.given for p in parts):
                kind = 1
            elif low in self.family or len(parts) > 1 and all(p in self.family for p in parts):
                kind = 2
            else:
                kind = 1 if g > f and g > 1 else 2 if f > 1 or score > 1.0 else 3 if score > -0.5 or f > 0 else 0
            got = (kind, score, g, f)
            if len(self.memo) >= KEPT_WORDS:
                self.memo.clear()
            self.memo[token] = got
        return got


WIDTH = 26


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, int, tuple]]:
    """(tag number, start, end, features) of every span that may be a detail."""
    out: list[tuple[int, int, int, tuple]] = []
    taken: list[tuple[int, int]] = []

    def numeric(number: int, a: int, b: int) -> None:
        v = text[a:b]
        before = text[max(0, a - 14) : a].lower().split()
        out.append((number, a, b, feature(number, (len(v), sum(map(str.isdigit, v)), v[0] == "+", v[0] == "(", " " in v, "-" in v, "." in v, "/" in v, lexicon.before.get(before[-1].strip(":.,("), 0.0) if before else 0.0, text[b : b + 1].isalnum(), v[:2] == "00", number == 3 and ean13(re.sub(r"\D", "", v)) or number == 4 and iban(v)))))
        taken.append((a, b))

    def mail(a: int, b: int) -> None:
        v = text[a:b]
        out.append((2, a, b, feature(2, (len(v), v.count("."), "@" in v, " " in v, "[" in v or "(" in v, " at " in v, sum(map(str.isdigit, v))))))
        taken.append((a, b))

    end = 0
    for sign in AT_SIGN.finditer(text):
        # From the sign, or the blank before it.
        a = sign.start()
        m = SIGN.match(text, a - 1 if a > end and text[a - 1] == " " else a) if a >= end else None
        if m:
            end, back = m.end(), 80
            # A name that reaches the start of the window goes on before it.
            while (local := LOCAL.search(text, max(0, m.start() - back), m.start())) and 0 < local.start() == m.start() - back:
                back *= 4
            if local:
                mail(local.start(), m.end())
    low = text.lower()
    if any(x in low for x in SPELT_SIGNS):
        for m in SPELT.finditer(text):
            mail(*m.span())
    for m in PHONE.finditer(text):
        numeric(1, *m.span())
    for m in AHVN.finditer(text):
        numeric(3, *m.span())
    for m in ACCOUNT.finditer(text):
        a = m.start() - 2
        length = IBAN_LENGTHS.get(text[a : a + 2].upper())
        if length is None or a and text[a - 1].isalnum():
            continue
        seen = 2
        for i in range(m.start(), m.end()):
            seen += text[i].isalnum()
            if seen == length:
                numeric(4, a, i + 1)
                break
    for m in PASSPORT.finditer(text):
        a = m.start()
        if not (a and (text[a - 1].isalnum() or text[a - 1] in ".-")):
            numeric(5, a, m.end())
    for m in HOUSE.finditer(text):
        _streets(text, *m.span(), out)
    taken.sort()
    _names(text, lexicon, out, taken)
    return out


def feature(tag: int, own: tuple) -> tuple:
    """Features of all tags share one table: the tag, then its own, filled up."""
    return (tag, *own, *(0.0,) * (WIDTH - 1 - len(own)))


def _streets(text: str, a: int, b: int, out: list) -> None:
    if text[a - 1 : a] == " " and a > 1:
        _before_number(text, a, b, out)
    if text[b : b + 1] == " " and text[b + 1 : b + 2].isupper():
        _after_number(text, a, b, out)


class StreetWord(NamedTuple):
    """The word that ends a run of signs without blanks: its length, and whether it is all of them."""

    size: int
    whole: bool
    capital: bool
    comma: bool
    low: str
    first: bool
    last: bool
    tail: bool


@lru_cache(maxsize=KEPT_WORDS)
def _street_word(signs: str) -> StreetWord | None:
    m = WORD_BACK.match(signs[::-1])
    if not m:
        return None
    word = m[0][::-1]
    low = word.rstrip(",").lower().rstrip(".")
    return StreetWord(len(word), len(word) == len(signs), word[0].isupper(), word[-1] == ",", low, low in STREET_FIRST, low.endswith(STREET_LAST), low.rsplit("-", 1)[-1] in STREET_LAST)


def _before_number(text: str, a: int, b: int, out: list) -> None:
    """Spans of words right before the number, in one line and without a comma inside: any that start with a capital, up
    to SHORT_STREET words back, and beyond that any that start with a word that begins streets."""
    stop, run = a - 1, []
    line = max(text.rfind("\n", 0, a), text.rfind("\t", 0, a)) + 1
    while stop > line:
        start = max(text.rfind(" ", line, stop) + 1, line)
        word = _street_word(text[start:stop])
        if word is None or run and word.comma:
            break
        run.append((stop - word.size, word))
        if not word.whole:
            break
        stop = start - 1
    if not run:
        return
    end = run[0][1]
    follows, letter = text[b : b + 2] == ", ", text[b - 1].isalpha()
    ordinal = text[b : b + 1] == "." and text[b + 1 : b + 3].strip()[:1].islower()
    capitals = 0
    for k, (at, word) in enumerate(run):
        capitals += word.capital
        if word.capital and (k < SHORT_STREET or word.first):
            before = run[k + 1][1] if k + 1 < len(run) else None
            out.append((6, at, b, feature(6, (1, k + 1, word.first, end.last, end.tail, capitals, len(end.low), end.comma, before is not None and before.first, before is not None and before.capital, follows, letter, word.size, ordinal))))


def _after_number(text: str, a: int, b: int, out: list) -> None:
    m = ENGLISH.match(text, b)
    if m:
        words = m[0].split()
        end = b
        for k, word in enumerate(words, 1):
            end += 1 + len(word)
            if k < 2:
                continue
            last = word.lower().rstrip(".")
            stop = end - 1 if word.endswith(".") else end
            out.append((6, a, stop, feature(6, (2, k, last in STREET_ENGLISH, 0, 0, k, len(last), 0, 0, 0, text[stop : stop + 2] == ", ", text[b - 1].isalpha()))))


TITLE_ENDS = frozenset(t[-2:] for t in TITLES if len(t) > 1)


def titled(text: str, a: int) -> bool:
    """Whether the word before a place is a form of address."""
    if a < 2 or text[a - 1] not in " \n":
        return False
    c = text[a - 2]
    if c.isalpha() and c not in "mM" and text[a - 3 : a - 1].lower() not in TITLE_ENDS:
        return False
    words = text[max(0, a - 14) : a - 1].rsplit(None, 1)
    return bool(words) and _is_title(words[-1])


@lru_cache(maxsize=KEPT_WORDS)
def _is_title(word: str) -> bool:
    word = word.strip(".,:;(-")
    return word.lower() in TITLES and word != "m"


def _ends(run: list[int], x: int, stops: set[int]) -> Iterator[int]:
    """Where a name that starts at a place of a run may end: up to SHORT_NAME words, and beyond that at the end of its
    part between commas, or anywhere if it starts where such a part starts. So their number is linear in the run."""
    yield from range(x, min(x + SHORT_NAME, len(run)))
    opens = x == 0 or x - 1 in stops
    for y in range(x + SHORT_NAME, len(run)):
        if opens or y in stops:
            yield y
        if y in stops:
            break


def _names(text: str, lexicon: Lexicon, out: list, taken: list[tuple[int, int]]) -> None:
    memo, word = lexicon.memo, lexicon.word
    tokens = [(m.start(), m.end(), m[0]) for m in CAPITAL.finditer(text)]
    infos = [memo.get(t[2]) or word(t[2]) for t in tokens]
    kinds_of = [x[0] for x in infos]
    n, i, k, size = len(tokens), 0, 0, len(taken)
    while i < n:
        kind = kinds_of[i]
        a = tokens[i][0]
        title = kind in (0, 3) and titled(text, a)
        if kind == 0 and not title or kind == 4 and not (i + 1 < n and kinds_of[i + 1] and tokens[i + 1][0] - tokens[i][1] == 2) or a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            i += 1
            continue
        # A run of name-like words: blanks, initials with a stop, at most one comma at a time.
        run, j, stops = [i], i, set()
        while j + 1 < n:
            gap = text[tokens[j][1] : tokens[j + 1][0]]
            kind = kinds_of[j + 1]
            if kind and (gap == " " or gap == ". " and kinds_of[j] == 4 or gap == ", " and kinds_of[j] in (2, 3) and kind in (1, 3)):
                if gap == ", ":
                    stops.add(len(run) - 1)
                run.append(j + 1)
                j += 1
            else:
                break
        stops.add(len(run) - 1)
        for x in range(len(run)):
            first = run[x]
            start = tokens[first][0]
            before = ""
            for y in _ends(run, x, stops):
                last = run[y]
                kinds = kinds_of[first : last + 1]
                end = tokens[last][1]
                if y == x:
                    if kinds[0] == 4 or not (title if x == 0 and kinds[0] in (0, 3) else titled(text, start)):
                        continue
                elif not (2 in kinds or 3 in kinds) and 1 not in kinds:
                    continue
                inner = text[start:end]
                commas = inner.count(",")
                if commas > 1:
                    break
                while k + 1 < size and taken[k][1] <= start and taken[k + 1][1] <= start:
                    k += 1
                if size and any(s < end and start < e for s, e in taken[max(0, k - 1) : k + 4]):
                    continue
                if kinds[-1] == 4:
                    if text[end : end + 1] != ".":
                        continue
                    end += 1
                if not before:
                    before = (text[max(0, start - 24) : start].lower().split() or ["^"])[-1].strip(".,:;(<-[|") or "^"
                    title_before, odds_before, organised_before = before in TITLES, lexicon.before.get(before, 0.0), before in ORGANISED
                    back = kinds_of[first - 1] if first and 0 < start - tokens[first - 1][1] <= 2 else -1
                after = text[end : end + 24]
                words = after.split(None, 2) or [""]
                following = words[1] if words[0] == "&" and len(words) > 1 else words[0]
                near = last + 1 < n and 0 < tokens[last + 1][0] - tokens[last][1] <= 2
                info = infos[last]
                ones, initials = kinds.count(1), kinds.count(4)
                out.append((0, start, end, feature(0, (
                    len(kinds), kinds[0], kinds[-1], kinds[1] if len(kinds) > 1 else -1, ones, kinds.count(2) + kinds.count(3), initials,
                    commas, (kinds[0] in (2, 3)) if commas else -1, min([t[1] for t in infos[first : last + 1]]), info[1], info[3], infos[first][2],
                    title_before, odds_before, x, len(run) - 1 - y,
                    after[:1] == " " and following.lower().strip(".,;:") in ORGANISED, after[:2] == " &" or after[:3] == " + ",
                    kinds_of[last + 1] if near else -1, back,
                    after[:1] == " " and words[0][:1].isdigit(), organised_before, inner.isupper(), text[end : end + 2] == ", " and near and kinds_of[last + 1] == 1,
                ))))
        i = j + 1


def select(found: list[tuple[int, int, int]], scores: list[float], limits: list[float], text: str) -> list[tuple[int, int, int, float]]:
    """Non-overlapping spans above their tag's threshold, best first; numbers with wrong check digits are left out."""
    order = sorted((i for i, (t, _, _) in enumerate(found) if scores[i] >= limits[t]), key=lambda i: (-round(scores[i], 3), found[i][1] - found[i][2]))
    kept: list[tuple[int, int, int, float]] = []
    for i in order:
        t, a, b = found[i]
        # Kept spans are apart and in order, so only the neighbours can overlap.
        k = bisect_right(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
            kept.insert(k, (a, b, t, scores[i]))
    return [(t, a, b, score) for a, b, t, score in kept if not (t == 3 and not ean13(re.sub(r"\D", "", text[a:b])) or t == 4 and not iban(text[a:b]))]


class Finder:
    def __init__(self, lexicon: Lexicon, model: Boosted, limits: list[float]):
        self.lexicon, self.model, self.limits = lexicon, model, limits

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """(tag, start, end, score) of the details of each text, in its own positions; null and empty texts have none."""
        plains, owners, spans, rows = [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                plains.append(("", None))
                continue
            plain, at = unwrapped(text)
            plains.append((plain, at))
            for tag, a, b, f in candidates(plain, self.lexicon):
                owners.append(i)
                spans.append((tag, a, b))
                rows.append(f)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if not rows:
            return out
        scores = self.model.predict(np.array(rows, dtype=np.float32)).tolist()
        lo = 0
        while lo < len(owners):
            i, hi = owners[lo], lo
            while hi < len(owners) and owners[hi] == i:
                hi += 1
            plain, at = plains[i]
            for tag, a, b, score in select(spans[lo:hi], scores[lo:hi], self.limits, plain):
                if at:
                    a, b = at[a], at[b - 1] + 1
                out[i].append((TAGS[tag], a, b, score))
            lo = hi
        return out


def learn(rows: list[tuple[str, list[tuple[str, int, int]]]], given: set[str], family: set[str]) -> Finder:
    """Lexicon, trees and thresholds from labelled texts; labels may err. A fifth of the rows is held out to calibrate."""
    used_g, used_f, seen, ends_in, ends_out, before_in, before_all = (Counter() for _ in range(7))
    cut = len(rows) - len(rows) // 5
    plains = []
    for text, labels in rows:
        plain, at = unwrapped(text)
        if at:
            back = {p: i for i, p in reversed(list(enumerate(at)))}
            labels = [(t, back.get(a, -1), back.get(b, -1)) for t, a, b in labels]
        plains.append((plain, {(t, a, b) for t, a, b in labels if 0 <= a < b <= len(plain)}))
    for plain, labels in plains[:cut]:
        inside = [(a, b) for t, a, b in labels if t == "FULLNAME"]
        for m in TOKEN.finditer(plain):
            w = m[0]
            if not w[0].isupper() or len(w) < 3:
                continue
            low = fold(w)
            seen[low] += 1
            home = next(((a, b) for a, b in inside if a <= m.start() and m.end() <= b), None)
            if home:
                (used_g if low in given or low not in family and m.end() < home[1] and "," not in plain[home[0] : home[1]] and home[0] == m.start() else used_f)[low] += 1
            into = ends_in if home and low not in given else ends_out if not home else None
            if into is not None:
                for k in (3, 4, 5):
                    into[low[-k:]] += 1
        starts = {a for a, _ in inside}
        last = ""
        for m in TOKEN.finditer(plain):
            if m[0][0].isupper():
                before_all[last] += 1
                before_in[last] += m.start() in starts
            last = m[0].lower()
    ends = {k: math.log((ends_in[k] + 0.3) / (ends_out[k] + 0.3)) for k in ends_in.keys() | ends_out.keys() if ends_in[k] + ends_out[k] >= 3}
    before = {k: math.log((before_in[k] + 0.5) / (before_all[k] - before_in[k] + 0.5)) for k in before_all if before_all[k] >= 5}
    used = {w: (math.log((used_g[w] + 0.3) / (seen[w] - used_g[w] + 0.6)), math.log((used_f[w] + 0.3) / (seen[w] - used_f[w] + 0.6))) for w in used_g.keys() | used_f.keys() if seen[w] >= 3}
    lexicon = Lexicon(given, family, ends, before, used)
    parts: list[list] = [[], []]
    for k, (plain, labels) in enumerate(plains):
        for tag, a, b, f in candidates(plain, lexicon):
            parts[k >= cut].append((f, (TAGS[tag], a, b) in labels, tag))
    if not parts[0]:
        return Finder(lexicon, Boosted(trees=0).fit(np.zeros((1, WIDTH)), np.zeros(1)), [1.1] * len(TAGS))
    x, y = np.array([p[0] for p in parts[0]], dtype=np.float32), np.array([p[1] for p in parts[0]], dtype=float)
    model = Boosted().fit(x, y)
    limits = [0.5] * len(TAGS)
    if parts[1]:
        scores = model.predict(np.array([p[0] for p in parts[1]], dtype=np.float32))
        truth, tags = np.array([p[1] for p in parts[1]]), np.array([p[2] for p in parts[1]])
        for t in range(len(TAGS)):
            own = tags == t
            best = 0.0
            for limit in np.arange(0.1, 0.75, 0.05):
                hit = (scores >= limit) & own
                f1 = 2 * (hit & truth).sum() / max(1, hit.sum() + (truth & own).sum())
                if f1 > best + 1e-3:
                    best, limits[t] = f1, float(limit)
    return Finder(lexicon, model, limits)


def fit(examples: DataFrame, names: DataFrame, rows: int = TRAIN_ROWS) -> Finder:
    """Fit on the driver on at most rows labelled texts (text, spans) and the name list; every row is searched later."""
    own = examples.where((F.length("text") > 0) & (F.size("spans") > 0)).select("text", "spans")
    # Texts are counted once, as one may be delivered any number of times.
    sample = hash_sample(own, "text", rows, own.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]).collect()
    lists: dict[str, set[str]] = defaultdict(set)
    forms = names.where("name_form is not null and kind is not null").select("name_form", "kind").distinct()
    if forms.count() > MOST_NAMES:
        raise ValueError(f"the name list has more than {MOST_NAMES} forms")
    for r in forms.collect():
        lists[r["kind"]].update(p for p in [fold(r["name_form"].strip())] if len(p) > 1)
    labelled = [(r["text"], [(s["tag"], s["start_pos"], s["end_pos"]) for s in r["spans"] if s is not None and s["start_pos"] is not None and s["end_pos"] is not None]) for r in sample]
    return learn(labelled, lists["given"], lists["family"])


def details(df: DataFrame, finder: Finder, keys: list[str], text_col: str) -> DataFrame:
    """(keys, tag, start_pos, end_pos, score): one row for each detail; null and empty texts have none. Equal texts have
    equal details, and repeated rows repeat them."""
    shared = df.sparkSession.sparkContext.broadcast((finder.lexicon.given, finder.lexicon.family, finder.lexicon.ends, finder.lexicon.before, finder.lexicon.used, finder.model, finder.limits))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tag string, start_pos int, end_pos int, score double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *words, model, limits = shared.value
        own = Finder(Lexicon(*words), model, limits)
        for part in parts:
            for lo in range(0, len(part), 1000):
                some = part.iloc[lo : lo + 1000]
                at, rows = [], []
                for i, found in enumerate(own.batch(some["_text"].tolist())):
                    for row in found:
                        at.append(i)
                        rows.append(row)
                out = some[keys].iloc[at].reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame(rows, columns=["tag", "start_pos", "end_pos", "score"])], axis=1)

    return df.select(*keys, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def masked(df: DataFrame, finder: Finder, keys: list[str], text_col: str) -> DataFrame:
    """(keys, text): each detail replaced by [TAG_n], equal values of a tag by the same number; all else unchanged."""
    shared = df.sparkSession.sparkContext.broadcast((finder.lexicon.given, finder.lexicon.family, finder.lexicon.ends, finder.lexicon.before, finder.lexicon.used, finder.model, finder.limits))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *words, model, limits = shared.value
        own = Finder(Lexicon(*words), model, limits)
        for part in parts:
            for lo in range(0, len(part), 1000):
                some = part.iloc[lo : lo + 1000].reset_index(drop=True)
                texts = some["_text"].tolist()
                yield some[keys].assign(text=[replaced(t, f) for t, f in zip(texts, own.batch(texts))])

    return df.select(*keys, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def replaced(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    if not text:
        return text
    numbers: dict[str, dict[str, int]] = defaultdict(dict)
    out, last = [], 0
    for tag, a, b, _ in found:
        own = numbers[tag]
        out += [text[last:a], f"[{tag}_{own.setdefault(' '.join(text[a:b].split()), len(own) + 1)}]"]
        last = b
    return "".join(out) + text[last:]
