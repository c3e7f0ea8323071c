"""Problem 3: scanned pages back to continuous paragraphs.

Lines are labelled by a hidden Markov model over layout features as body, break, header or footer. Paragraphs are put
together from the body lines: words cut at line ends are joined, misread characters corrected against the words of the
whole collection, and the lines that belong to the page left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_sample

#: Scanned texts that refine the line model, at most, by hash order, and characters of them; the model has few numbers.
TRAIN_TEXTS, TRAIN_CHARS = 400, 10_000_000
STATES = ("body", "break", "header", "footer")
#: A correction must be so many times as frequent as the word that stands there, and as frequent as this at least.
RATIO, LEAST = 8, 3
#: Signs of a line that may be a wrapped one.
WRAPPED = 110

# Readings of a scanner and what may have stood there.
MISREAD = {
    "c": ("e",), "f": ("t",), "1": ("i", "l"), "0": ("o",), "5": ("s",), "b": ("h",), "rn": ("m",), "cl": ("d",), "9": ("g",),
    "vv": ("w",), "ii": ("ü", "u", "n"), "6": ("é", "b", "g"), "m": ("rn",), "8": ("b",), "a'": ("ä", "à"), "o'": ("ö", "ò"), "u'": ("ü", "ù"), "e'": ("é", "è"),
    "3": ("e",), "2": ("z",), "4": ("a",), "7": ("t",), "|": ("l",),
}
# Letters that some reading makes one, and letters that stand for several. By this map, letter by letter, a
# reading and whatever may have stood there are the same, so a word keeps its skeleton under any number of misreadings.
ONE = {"e": "c3éè6bgh89", "t": "f7", "i": "l1|", "o": "0öò", "s": "5", "z": "2", "a": "4äà", "u": "üù"}
SEVERAL = {"m": "rii", "u": "ii", "n": "ii", "d": "ei", "w": "vv"}
# Letters whose accent may be read as an apostrophe behind them.
ACCENTED = frozenset(c for key in MISREAD if key.endswith("'") for c in (key[0], key[0].upper()))
# Words after which, or before which, a hyphen hangs at a shortened word instead of cutting one.
HANGING = frozenset("und oder bzw sowie bis et ou e ed o od and or y u noch als auch".split())
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
PAGE_WORD = r"(?:seite|page|pagina|página|pag|s|p|blatt|foglio|feuille)"
NUMBER = rf"(?:{PAGE_WORD}\.?\s*\d{{1,4}}(?:\s*(?:von|sur|di|of|de|/)\s*\d{{1,4}})?|[-–—]\s?\d{{1,4}}\s?[-–—]|[\[(]\s?\d{{1,4}}\s?[\])]|\d{{1,4}}\s?/\s?\d{{1,4}}|\d{{1,4}})"
BARE = re.compile(rf"{NUMBER}", re.I)
WORDED = re.compile(rf"{PAGE_WORD}\b\.?\s*\d{{1,4}}.*", re.I)
TAIL = re.compile(rf".*\w.*?(?:\s{{2,}}|\t|\s[–—|·]\s+){NUMBER}", re.I)
LINE = re.compile(r"[^\n\f]*")
CUT = re.compile(r"([^\W_]+(?:-[^\W_]+)*)[-¬­‐]\s*$")
HYPHENS = ("-", "¬", "­", "‐")
TABLE = re.compile(r"[\t;|]| / ")
HEAD = re.compile(r"\s*([^\W_]+(?:-[^\W_]+)*)")


def lines_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of each line; line ends and form feeds separate."""
    out = []
    a = 0
    for m in re.finditer(r"\r?\n|\r|\f", text):
        out.append((a, m.start()))
        a = m.end()
    out.append((a, len(text)))
    return out


def is_scan(text: str | None) -> bool:
    """Wrapped lines: at least two long lines without a sentence end that go on in lower case, whatever any notice says.
    In texts without lines of more than WRAPPED signs, those that go on with a capital or a digit count as well where the
    next word would not have fitted, beside one that goes on in lower case or a line with a page number."""
    if not text or "\n" not in text:
        return False
    n, before = 0, ""
    lines = [line.strip(" \r\f\t") for line in text.split("\n")]
    for s in lines:
        if s:
            if len(before) >= 30 and before[-1] not in ".:;!?>" and (s[0].islower() or before[-1] in "-¬­‐"):
                n += 1
                if n >= 2:
                    return True
            before = s
    sizes = sorted(len(s) for s in lines if s)
    if not sizes or sizes[-1] > WRAPPED or not n and not any(BARE.fullmatch(s) for s in lines):
        return False
    width = sizes[int(len(sizes) * 0.8)]
    for before, s in zip(lines, lines[1:]):
        if len(before) >= 30 and s and before[-1] not in ".:;!?>-¬­‐" and (s[0].isupper() or s[0].isdigit()) and not TABLE.search(before):
            n += len(before) + 1 + len(s.split(None, 1)[0]) > width
    return n >= 2


def ends_as_number(line: str) -> bool:
    """Whether a line ends as lines with a page number do; others need no closer look."""
    return line[-1:].isdigit() or line[-1:] in (")", "]", "-", "–", "—")


def skeleton(line: str) -> str:
    """What is left of a line when scanning errors and page numbers are set aside."""
    s = re.sub(r"rn", "m", line.lower().translate(_ALIKE).replace("cl", "d").replace("vv", "w"))
    return re.sub(r"[\W\d_]+", "", s)


_ALIKE = str.maketrans({"c": "e", "f": "t", "1": "i", "l": "i", "0": "o", "5": "s", "b": "h", "9": "g", "6": "é"})


def observe(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, ...] | None]:
    """Layout features of each line; None for blank ones."""
    stripped = [text[a:b].strip() for a, b in spans]
    bones = [skeleton(s) for s in stripped]
    again = Counter(x for x in bones if len(x) >= 6)
    full = [i for i, s in enumerate(stripped) if s]
    may = [ends_as_number(s) for s in stripped]
    bare = [m and BARE.fullmatch(s) is not None for m, s in zip(may, stripped)]
    width = sorted(len(stripped[i]) for i in full)[int(len(full) * 0.8)] if full else 0
    out: list[tuple[int, ...] | None] = []
    order = {i: k for k, i in enumerate(full)}
    for i, s in enumerate(stripped):
        if not s:
            out.append(None)
            continue
        k = order[i]
        before = next((stripped[j] for j in reversed(full[max(0, k - 2) : k]) if not bare[j]), "")
        after = next((stripped[j] for j in full[k + 1 : k + 3] if not bare[j]), "")
        dot = " · " in s or " | " in s and len(s) < 50 and text[spans[i][0] : spans[i][0] + 3].isspace()
        number = (2 if WORDED.fullmatch(s) else 1) if bare[i] else 3 if may[i] and TAIL.fullmatch(s) else 4 if dot else 0
        dash = " – " in s and s[-1] not in ".,;:" and len(s) < 100 and not s[0].islower()
        same = len(bones[i]) >= 6 and again[bones[i]] > 1
        a, b = spans[i]
        out.append((
            number,
            (3 if same or dash else 0) if k == 0 else 2 if same and bones[i] == bones[full[0]] else int(same),
            int(text[a : a + 3].isspace()),
            int(bool(before) and before[-1] not in ".:;!?," and bool(after) and after[0].islower() and not s[0].islower()),
            2 if k == 0 else int(k == len(full) - 1 or "\f" in text[max(0, a - 2) : a] or "\f" in text[b : b + 2]),
            int(s[-1] in ".:;!?,"),
            0 if len(s) >= 0.8 * width else 1 if len(s) >= 0.35 * width else 2,
            int(dash),
        ))
    return out


# Starting rates of each feature's values, refined on the texts.
START = {
    "body": ((0.985, 0.003, 0.001, 0.01, 0.001), (0.92, 0.07, 0.002, 0.008), (0.9, 0.1), (0.97, 0.03), (0.9, 0.05, 0.05), (0.6, 0.4), (0.6, 0.25, 0.15), (0.98, 0.02)),
    "header": ((0.96, 0.005, 0.005, 0.02, 0.01), (0.02, 0.08, 0.5, 0.4), (0.5, 0.5), (0.5, 0.5), (0.3, 0.35, 0.35), (0.99, 0.01), (0.5, 0.4, 0.1), (0.05, 0.95)),
    "footer": ((0.004, 0.35, 0.25, 0.2, 0.196), (0.85, 0.14, 0.005, 0.005), (0.4, 0.6), (0.5, 0.5), (0.5, 0.49, 0.01), (0.95, 0.05), (0.05, 0.35, 0.6), (0.95, 0.05)),
}
# Rows and columns in the order of STATES.
MOVES = ((0.75, 0.18, 0.02, 0.05), (0.8, 0.1, 0.05, 0.05), (0.9, 0.05, 0.01, 0.04), (0.45, 0.15, 0.3, 0.1))
FIRST = (0.6, 0.05, 0.33, 0.02)


class Lines:
    def __init__(self):
        self.rates = {s: [list(x) for x in START[s]] for s in START}
        self.moves = [list(x) for x in MOVES]
        self._logs()

    def _logs(self) -> None:
        self.log_rates = {s: [[math.log(p) for p in row] for row in rows] for s, rows in self.rates.items()}
        self.log_moves = [[math.log(p) for p in row] for row in self.moves]
        self.emitted: dict[tuple[int, ...], list[float]] = {}  # features have few values, so there are few of them

    def emit(self, seen: tuple[int, ...] | None) -> list[float]:
        if seen is None:
            return [-60.0, 0.0, -60.0, -60.0]
        got = self.emitted.get(seen)
        if got is None:
            got = self.emitted[seen] = [-60.0 if s == "break" else sum(row[v] for row, v in zip(self.log_rates[s], seen)) for s in STATES]
        return got

    def label(self, seen: list[tuple[int, ...] | None]) -> list[int]:
        """The likeliest states (Viterbi)."""
        if not seen:
            return []
        n = range(len(STATES))
        score = [math.log(p) + e for p, e in zip(FIRST, self.emit(seen[0]))]
        back = []
        for x in seen[1:]:
            e, step, new = self.emit(x), [], []
            for k in n:
                j = max(n, key=lambda j: score[j] + self.log_moves[j][k])
                step.append(j)
                new.append(score[j] + self.log_moves[j][k] + e[k])
            back.append(step)
            score = new
        k = max(n, key=score.__getitem__)
        out = [k]
        for step in reversed(back):
            k = step[k]
            out.append(k)
        return out[::-1]

    def fit(self, texts: list[str], rounds: int = 3, weight: float = 200.0) -> Lines:
        """Viterbi training; the starting rates count as so many lines, so that the states keep their meaning."""
        seen = [observe(t, lines_of(t)) for t in texts]
        for _ in range(rounds if seen else 0):
            counts = {s: [[weight * p for p in row] for row in START[s]] for s in START}
            moves = [[weight * p for p in row] for row in MOVES]
            for rows in seen:
                states = self.label(rows)
                for a, b in zip(states, states[1:]):
                    moves[a][b] += 1
                for x, k in zip(rows, states):
                    if x is not None:
                        for row, v in zip(counts[STATES[k]], x):
                            row[v] += 1
            self.rates = {s: [[v / sum(row) for v in row] for row in rows] for s, rows in counts.items()}
            self.moves = [[v / sum(row) for v in row] for row in moves]
            self._logs()
        return self


def parse(text: str, model: Lines) -> tuple[list[tuple[int, int, int]], list[tuple[str, str, str, int]]]:
    """(lines as (start, end, state); cuts as (left, right, mark, index of the left line))."""
    spans = lines_of(text)
    states = model.label(observe(text, spans))
    rows = [(a, b, k) for (a, b), k in zip(spans, states)]
    body = [i for i, (_, _, k) in enumerate(rows) if k == 0]
    cuts = []
    for i, j in zip(body, body[1:]):
        between = rows[i + 1 : j]
        if all(k == 1 for _, _, k in between) and len(between) > 1:
            continue  # a new paragraph of the same page
        line = text[rows[i][0] : rows[i][1]]
        left, right = CUT.search(line) if line.rstrip()[-1:] in HYPHENS else None, HEAD.match(text[rows[j][0] : rows[j][1]])
        if left and right:
            cuts.append((left[1], right[1], left[0].rstrip()[-1], i))
    return rows, cuts


def skeleton_col(word: Column) -> Column:
    """The skeleton of a word in lower case; apostrophes, which may be accents, are left out."""
    x = F.translate(word, "".join(ONE.values()) + "'", "".join(k * len(v) for k, v in ONE.items()))
    for letter, several in SEVERAL.items():
        x = F.replace(x, F.lit(letter), F.lit(several))
    return x


_READ: dict[str, list[tuple[str, str]]] = {}
for _key, _tos in MISREAD.items():
    _READ.setdefault(_key[0], []).extend((_key, to) for to in _tos)


def swaps(word: str, form: str) -> int | None:
    """How many readings of a word must be undone to get a form; None if that can't be done."""
    reach: dict[int, dict[int, int]] = {0: {0: 0}}
    for i, c in enumerate(word):
        for j, n in reach.pop(i, {}).items():
            steps = [(1, 1, n)] if form[j : j + 1] == c else []
            steps += [(len(key), len(to), n + 1) for key, to in _READ.get(c, ()) if word.startswith(key, i) and form.startswith(to, j)]
            for a, b, m in steps:
                at = reach.setdefault(i + a, {})
                at[j + b] = min(m, at.get(j + b, m))
    return reach.get(len(word), {}).get(len(form))


def readings(token: str) -> list[str]:
    """The words that a token of WORD may hold: its parts between apostrophes, and runs of parts whose apostrophes may
    each be the accent of a letter."""
    parts = token.split("'")
    out = list(parts)
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            if parts[j - 1][-1] not in ACCENTED:
                break
            out.append("'".join(parts[i : j + 1]))
    return out


def respelled(token: str, fix: dict[str, str]) -> str:
    """A token of WORD with its misread words corrected; the longest reading goes first."""
    if "'" not in token:
        return fix.get(token, token)
    parts, out, i = token.split("'"), [], 0
    while i < len(parts):
        j = next((j for j in range(len(parts), i + 1, -1) if "'".join(parts[i:j]) in fix), i + 1)
        word = "'".join(parts[i:j])
        out.append(fix.get(word, word))
        i = j
    return "'".join(out)


def recase(raw: str, lower: str, capital: bool) -> str:
    """The corrected word in the case of what stood there."""
    letters = [c for c in raw if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return lower.upper()
    if raw[:1].isupper() or not raw[:1].isalpha() and capital:
        return lower[:1].upper() + lower[1:]
    return lower


_EVIDENCE = "_id {0}, kind string, raw string, other string, mark string"


def evidence(docs: DataFrame, model: Lines) -> DataFrame:
    """(_id, kind, raw, other, mark): page lines, cuts and words of the scanned texts among (_id, _text). The mark of a word
    is the token with apostrophes that it is part of, if any."""
    shared = docs.sparkSession.sparkContext.broadcast((model.rates, model.moves))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lines()
        own.rates, own.moves = shared.value
        own._logs()
        for part in parts:
            out = []
            for key, text in part.itertuples(index=False):
                if not is_scan(text):
                    continue
                rows, cuts = parse(text, own)
                found = {("line", text[a:b].strip(), "", "") for a, b, k in rows if k > 1}
                at = {i: (left, right) for left, right, _, i in cuts}
                found |= {("word", left, right, mark) for left, right, mark, _ in cuts}
                skip = ""
                for i, (a, b, k) in enumerate(rows):
                    if k:
                        continue
                    line = text[a:b]
                    if skip:
                        line = line.lstrip()[len(skip) :]
                        skip = ""
                    if i in at:
                        line = line.rstrip()[: -len(at[i][0]) - 1]
                        skip = at[i][1]
                    words = [(w, "") for w in WORD.findall(line)]
                    if "'" in line:
                        words = [(part, w if "'" in w else "") for w, _ in words for part in readings(w)]
                    found |= {("char", w, "", mark) for w, mark in words if len(w) > 2 and sum(map(str.isalpha, w)) * 2 > len(w)}
                out += [(key, *x) for x in found]
            yield pd.DataFrame(out, columns=["_id", "kind", "raw", "other", "mark"])

    return docs.mapInPandas(run, _EVIDENCE.format(dict(docs.dtypes)["_id"]))


def vocabulary(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n, capital): every word of all texts in lower case, and how often it starts with a capital. Words keep
    their inner hyphens. Counted on the JVM, combined before the shuffle."""
    token = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0)))
    return texts.select(token.alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.substring("w", 1, 1) != F.lower(F.substring("w", 1, 1))).alias("capital"))


def decisions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, raw, other, piece): what to repair in the scanned texts.

    line: a page's line as it stands. word: raw and other are the parts of a cut word, piece the whole; a word whose
    hyphen is its own keeps it, and a hyphen that hangs before "und" and the like is no cut. char: raw is a misread
    word, piece the right one; in "l'adrcsse" the word is behind the apostrophe. Null, empty and unwrapped texts have no rows; repeated rows count once per id.
    """
    scans, model = fitted(docs, id_col, text_col)
    return _decided(docs, scans, model, id_col, text_col)


def scanned(text: Column) -> Column:
    """is_scan as a column; false for null texts."""

    @F.pandas_udf("boolean")
    def judged(part: pd.Series) -> pd.Series:
        return pd.Series([is_scan(x) for x in part], dtype="bool")

    return judged(text)


def fitted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Lines]:
    """The scanned texts as (_id, _text), and the model of their lines."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    scans = cut(base.where(scanned(F.col("_text"))))
    return scans, Lines().fit(text_sample(scans, "_text", TRAIN_TEXTS, TRAIN_CHARS).get("", []))


def _decided(docs: DataFrame, scans: DataFrame, model: Lines, id_col: str, text_col: str) -> DataFrame:
    found = cut(evidence(scans, model))
    words = cut(vocabulary(docs.where(F.length(text_col) > 0), text_col))
    cuts = found.where("kind = 'word'").withColumn("low", F.lower(F.concat("raw", "other"))).withColumn("hyphened", F.lower(F.concat("raw", F.lit("-"), "other")))
    tokens = found.where("kind = 'char'").select(F.lower("raw").alias("low")).unionByName(cuts.select("low")).distinct()
    asked = tokens.withColumn("form", F.col("low")).unionByName(cuts.select("low", F.col("hyphened").alias("form")).distinct())
    known = cut(asked.join(words, F.col("form") == F.col("word")).select("low", "form", "n", "capital"))

    @F.pandas_udf("boolean")
    def readable(word: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([swaps(w, f) is not None for w, f in zip(word, form)], dtype="bool")

    # Only words that are frequent enough to correct others are compared, with those of their skeleton.
    frequent = words.where((F.col("n") >= LEAST) & ~F.col("word").contains("-")).withColumn("bones", skeleton_col(F.col("word")))
    alike = tokens.withColumn("bones", skeleton_col(F.col("low"))).join(frequent, "bones").where("low <> word")
    better = alike.where(readable("low", "word")).select("low", F.col("word").alias("form"), "n", "capital")
    itself = known.where("low = form").select("low", F.col("n").alias("own"))
    best = better.groupBy("low").agg(F.max_by(F.struct("form", "n", "capital"), F.struct("n", "form")).alias("b"))
    fixes = cut(best.join(itself, "low", "left").where((F.col("b.n") >= LEAST) & (F.col("b.n") >= RATIO * F.coalesce("own", F.lit(0)))).select("low", F.col("b.form").alias("form"), (F.col("b.capital") * 2 > F.col("b.n")).alias("cap")))

    @F.pandas_udf("string")
    def cased(raw: pd.Series, low: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series([recase(r, x, bool(c)) for r, x, c in zip(raw, low, cap)], dtype="object")

    chars = found.where("kind = 'char'").withColumn("low", F.lower("raw")).join(fixes, "low").select("_id", "kind", "raw", "other", "mark", cased("raw", "form", "cap").alias("piece"))
    # Where an apostrophe is an accent, what stands at its sides are no words.
    longer = chars.where(F.col("raw").contains("'")).select(F.col("_id").alias("_in"), F.col("mark").alias("_mark"), F.col("raw").alias("_raw"))
    inside = (F.col("_id") == F.col("_in")) & (F.col("mark") == F.col("_mark")) & (F.length("_raw") > F.length("raw")) & F.col("_raw").contains(F.col("raw"))
    chars = chars.join(longer, inside, "left_anti").drop("mark").distinct()
    whole = known.where("low = form").select("low", F.col("n").alias("n_whole"))
    apart = known.where(F.col("form").contains("-")).select("low", F.col("form").alias("hyphened"), F.col("n").alias("n_apart"))
    judged = cuts.join(whole, "low", "left").join(apart, ["low", "hyphened"], "left").join(fixes, "low", "left").na.fill(0, ["n_whole", "n_apart"])
    hangs = F.lower("other").isin(*sorted(HANGING)) & (F.col("n_whole") == 0)
    own = (F.col("mark") == "-") & ((F.col("n_apart") > F.col("n_whole")) | ((F.col("n_apart") + F.col("n_whole") == 0) & F.col("form").isNull() & F.col("other").rlike(r"^\p{Lu}.*\p{Ll}|^\p{Lu}") & ~F.col("raw").rlike(r"^[\p{Lu}'-]+$")))
    joined = F.when(own, F.concat("raw", F.lit("-"), "other")).when(F.col("form").isNotNull(), cased(F.concat("raw", "other"), F.coalesce("form", "low"), F.coalesce("cap", F.lit(False)))).otherwise(F.concat("raw", "other"))
    # Digits that no word explains are no part of the piece: a name in a mail address is followed by a number, say.
    letters = F.concat(F.regexp_extract("raw", r"[\p{L}-]*$", 0), F.regexp_extract("other", r"^[\p{L}-]*", 0))
    piece = F.when(joined.rlike(r"\p{N}"), letters).otherwise(joined)
    whole_words = judged.where(~hangs & (F.length(piece) > 0)).select("_id", "kind", "raw", "other", piece.alias("piece"))
    # A cut word with misread characters is a case of both kinds.
    both = judged.where(~hangs & ~own & F.col("form").isNotNull()).select("_id", F.lit("char").alias("kind"), F.concat("raw", "other").alias("raw"), F.lit("").alias("other"), joined.alias("piece"))
    lines = found.where("kind = 'line'").select("_id", "kind", "raw", "other", F.col("raw").alias("piece"))
    return lines.unionByName(chars).unionByName(whole_words).unionByName(both).withColumnRenamed("_id", id_col)


def repair(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, repaired): continuous paragraphs; texts that are no scans, null and empty ones come back unchanged.

    Only scanned texts are joined with what to repair in them; all others are passed through where they are.
    """
    scans, model = fitted(docs, id_col, text_col)
    todo = _decided(docs, scans, model, id_col, text_col).groupBy(id_col).agg(F.collect_set(F.struct("kind", "raw", "other", "piece")).alias("_todo"))
    id_type = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.rates, model.moves))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lines()
        own.rates, own.moves = shared.value
        own._logs()
        for part in parts:
            rows = [(key, rebuilt(text, todo, own)) for key, text, todo in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["_id", "text"])

    joined = scans.join(todo.withColumnRenamed(id_col, "_id"), "_id", "left").select("_id", "_text", "_todo")
    mended = joined.mapInPandas(run, f"_id {id_type}, text string").select(F.col("_id").alias(id_col), "text", F.lit(True).alias("repaired"))
    rest = docs.select(id_col, F.col(text_col).alias("text")).where(~scanned(F.col("text")))
    return mended.unionByName(rest.withColumn("repaired", F.lit(False)))


def rebuilt(text: str, todo, model: Lines) -> str:
    """The body lines of a scanned text put together: the states of the lines say what is left out and where paragraphs
    may end, and an unfinished sentence goes on over such a place."""
    todo = [x.asDict() if hasattr(x, "asDict") else dict(x) for x in (todo if todo is not None else [])]
    fix = {x["raw"]: x["piece"] for x in todo if x["kind"] == "char"}
    join = {(x["raw"], x["other"]): x["piece"] for x in todo if x["kind"] == "word"}
    rows, _ = parse(text, model)
    paragraphs, current, width = [], "", max(b - a for a, b, _ in rows)
    swap = lambda s: WORD.sub(lambda m: respelled(m[0], fix), s)
    ended = False
    for a, b, state in rows:
        if state == 1:
            ended = bool(current)
        if state:
            continue
        line = text[a:b].strip()
        left, right = CUT.search(current, current.rfind(" ") + 1) if current[-1:] in HYPHENS else None, HEAD.match(line)
        if left and right and (left[1], right[1]) in join:
            whole = join[left[1], right[1]]
            current = current[: left.start()] + (whole if len(whole) >= len(left[1] + right[1]) - 2 else left[1] + right[1]) + swap(line[right.end() :])
        elif current and current[-1] not in ".:!?-¬­‐" and line[0].islower():
            current += f" {swap(line)}"  # an unfinished sentence goes on, also over a page
        elif current and (ended or len(current.rsplit("\n", 1)[-1]) < 0.5 * width and current[-1] in ".:!?,>"):
            paragraphs.append(current)
            current = swap(line)
        elif current and (left and current[-1] in "-‐"):
            current += (" " if right and right[1].lower() in HANGING else "") + swap(line)
        else:
            current = f"{current} {swap(line)}" if current else swap(line)
        ended = False
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)
