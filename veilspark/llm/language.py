"""Problem 2: the language of each text and of each passage in it, by prediction by partial matching.

One byte context tree per language. A byte's code length comes from the longest context that has seen it, after paying
the escape of every longer one (method C). Contexts start at the blank before a word, so the code length of a word is
exact, whatever stands before it, and each distinct word is coded once. The statistics are frozen after training.

Two things are added to the method, as their absence costs rows (figures in the README): the counts that the trees are
built from are dampened, so that sentences repeated many times don't crowd out the others, and after coding the
differences of capitalised words, which may be names, count in part.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import transducer
from .common import LANGS, label_col, text_sample

ORDER = 5
#: Labelled texts that train one language: at most so many distinct whole texts by hash order, and so many characters.
TRAIN_ROWS, TRAIN_CHARS = 1_500, 10_000_000
#: Bits that a change of language between neighbouring sentences must save.
SWITCH_BITS = 16.0
#: A sentence counts as written in a language from so many words, bits of lead, and bits per byte at most.
WORDS, LEAD_BITS, MOST_BITS = 3, 10.0, 4.6
#: Share of a word's labels that a language needs for the first trees, and how often the word must occur: the labels of
#: rare words may all be wrong. Weight of words that may be names.
CLEAR, OFTEN, NAME_WEIGHT = 0.6, 15, 0.2
#: Words whose code lengths a worker keeps.
KEPT_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+(?:[-¬­‐]\s*\n\s*[^\W\d_]+)*")
JOINT = re.compile(r"[^\w]+")
END = re.compile(r"[.!?…\n\f](?:(?<=[.!?…])(?<!\b[^\W\d_]\.)[.!?…]*[\"'»”’)\]]*(?=\s|$)|(?<=\n)[ \t\r]*\n\s*|(?<=\f))")
# Months that may follow a number with a stop, and words that make such a number an ordinal.
MONTHS = frozenset("januar jänner jan februar feber feb märz maerz mär april apr mai juni jun juli jul august aug september sept sep oktober okt november nov dezember dez janvier février mars avril juin juillet août septembre octobre novembre décembre gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre enero febrero abril mayo junio julio septiembre octubre noviembre diciembre".split())
ORDINAL = frozenset("der die das den dem im vom zum zur beim".split())
NEXT = re.compile(r"\s*[^\w\s]*([^\W\d_]+|\d)?([-¬­‐])?")


def numbers(text: str, at: int, end: int) -> bool:
    """Whether the stop at a place makes an ordinal of the one or two digits before it and ends no sentence: before a
    month, a small letter or a digit, behind an article, and where a line begins with the number. A line that begins
    inside a sentence, or inside a longer number, doesn't count."""
    a = at
    while a and at - a < 3 and text[a - 1].isdigit():
        a -= 1
    if not 1 <= at - a <= 2 or end > at + 1 or a and (text[a - 1].isalnum() or text[a - 1] == "_"):
        return False
    line = max(text.rfind("\n", 0, a), text.rfind("\f", 0, a)) + 1
    if not text[line:a].strip():
        above = text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)].strip()
        if not above or len(above) < 30 and not above[-1].isdigit() or above[-1] in ".:;!?>" or text[line - 1] == "\f":
            return True
    m = NEXT.match(text, end)
    word = m[1]
    if word is None:
        return False
    if word.isdigit():
        return not re.search(r"\n\s*\n|\f", text[end : m.start(1)])
    low = word.lower()
    if word[0].islower() or low in MONTHS or m[2] and len(low) > 1 and any(x.startswith(low) for x in MONTHS):
        return True
    before = text[max(0, a - 8) : a].split()
    return bool(before) and text[a - 1].isspace() and before[-1].lower() in ORDINAL


def without_mail(text: str) -> str:
    """Mail addresses blanked in place: they are in no language."""
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        text = text[:a] + " " * (b - a) + text[b:]
        at = text.find("@", b)
    return text


def coded(word: str) -> bytes:
    return b" " + word.lower().encode("utf-8", "replace") + b" "


class Tree:
    """Costs in bits: of a byte after a context, and (under None) of escaping from that context."""

    def __init__(self, words: Counter):
        counts: dict[bytes, Counter] = defaultdict(Counter)
        for word, n in words.items():
            n = math.isqrt(math.ceil(4 * n))
            text = coded(word)
            for i in range(1, len(text)):
                for k in range(0, min(ORDER, i) + 1):
                    counts[text[i - k : i]][text[i]] += n
        self.costs: dict[bytes, dict] = {}
        for context, seen in counts.items():
            total = math.log2(sum(seen.values()) + 2 * len(seen))
            costs = {byte: total - math.log2(n) for byte, n in seen.items()}
            costs[None] = total - math.log2(2 * len(seen))
            self.costs[context] = costs

    def bits(self, word: str) -> float:
        text, costs, total = coded(word), self.costs, 0.0
        for i in range(1, len(text)):
            byte = text[i]
            for k in range(min(ORDER, i), -1, -1):
                seen = costs.get(text[i - k : i])
                if seen is not None:
                    cost = seen.get(byte)
                    if cost is not None:
                        total += cost
                        break
                    total += seen[None]
            else:
                total += 8.0
        return total


class Words(dict):
    """Word to its row in a table of bits per language and bytes; rows are computed when a word is first asked for."""

    def __init__(self, trees: list[Tree]):
        super().__init__()
        self.trees = trees
        self.rows = np.zeros((1024, len(LANGS) + 1))

    def __missing__(self, token: str) -> int:
        plain = token if token.isalpha() else JOINT.sub("", token)  # a word cut at a line end is coded as one
        bits = [t.bits(plain) for t in self.trees]
        if token[0].isupper() and not token.isupper():
            # A capitalised word may be a name, which tells little of the language: its differences count in part.
            low = min(bits)
            bits = [low + NAME_WEIGHT * (b - low) for b in bits]
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = (*bits, len(plain.encode("utf-8", "replace")) + 1)
        self[token] = k
        return k


class Model:
    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.words = Words(trees)

    def sentences(self, text: str) -> list[tuple[int, int, bool, int, list[float]]]:
        """(start, end, ends as a sentence, words, bits per language and bytes)."""
        if len(self.words) > KEPT_WORDS:
            self.words = Words(self.trees)
        row, at, starts, out, a = self.words.__getitem__, [], [], [], 0
        for m in END.finditer(text):
            b = m.end()
            if text[m.start()] == "." and m.start() and text[m.start() - 1].isdigit() and numbers(text, m.start(), b):
                continue
            if tokens := WORD.findall(text, a, m.start()):
                starts.append(len(at))
                at.extend(map(row, tokens))
                out.append((a, b, text[m.start()] not in "\n\f", len(tokens)))
            a = b
        if tokens := WORD.findall(text, a):
            starts.append(len(at))
            at.extend(map(row, tokens))
            out.append((a, len(text), False, len(tokens)))
        if not out:
            return []
        sums = np.add.reduceat(self.words.rows[at], starts, axis=0).tolist()
        return [(*x, s) for x, s in zip(out, sums)]

    def passages(self, text: str) -> list[tuple[int, int, str | None, float, bool]]:
        """(start, end, language, confidence, holds a full sentence in it) of each run of sentences in one language.

        Sentences are labelled by the cheapest sequence under SWITCH_BITS for each change. A run that no tree codes well
        is in none of the languages. The confidence is the posterior of the language over a run, tempered per word.
        """
        text = without_mail(text)
        rows = self.sentences(text)
        if not rows:
            return []
        n = len(LANGS)
        best = [min(range(n), key=r[4].__getitem__) for r in rows]
        if any(x != best[0] for x in best):
            total, back = list(rows[0][4][:n]), []
            for r in rows[1:]:
                low = min(range(n), key=total.__getitem__)
                cap = total[low] + SWITCH_BITS
                back.append([k if total[k] <= cap else low for k in range(n)])
                total = [min(total[k], cap) + r[4][k] for k in range(n)]
            k = min(range(n), key=total.__getitem__)
            best = [k]
            for step in reversed(back):
                k = step[k]
                best.append(k)
            best.reverse()
        out, i = [], 0
        while i < len(rows):
            j, k = i, best[i]
            sums, words, full = [0.0] * (n + 1), 0, False
            while j < len(rows) and best[j] == k:
                _, _, ended, count, cost = rows[j]
                sums = [a + b for a, b in zip(sums, cost)]
                words += count
                if not full and ended and count >= WORDS and cost[k] <= MOST_BITS * cost[n] and min(c for x, c in enumerate(cost[:n]) if x != k) - cost[k] >= LEAD_BITS:
                    own = WORD.findall(text, rows[j][0], rows[j][1])
                    full = sum(w[0].islower() for w in own) >= 2 or not any(w[-1].islower() for w in own)
                j += 1
            low = sums[k]
            weights = [2.0 ** max(-60.0, (low - s) / max(1.0, words / 2)) for s in sums[:n]]
            known = low <= MOST_BITS * sums[n]
            out.append((rows[i][0], rows[j - 1][1], LANGS[k] if known else None, weights[k] / sum(weights), full and known))
            i = j
        return out


def _vote(own: list[Counter], share: float, often: int) -> list[Counter]:
    """Counts of each word weighted by the square of the language's share of it; below the least share, and words that
    occur less than often, are left out.

    Where most labels of a word are right, the wrong ones weigh next to nothing. Words without a clear language (filler
    or notices under any label, and words of several languages) are then coded by the trees' shorter contexts.
    """
    sizes = [max(1, sum(c.values())) for c in own]
    out = [Counter() for _ in own]
    for word in set().union(*own):
        if sum(c[word] for c in own) < often:
            continue
        rates = [c[word] / n for c, n in zip(own, sizes)]
        whole = sum(rates)
        for counts, rate, into in zip(own, rates, out):
            if rate >= share * whole and (n := counts[word] * (rate / whole) ** 2) >= 0.2:
                into[word] = n
    return out


def _words(texts: list[str]) -> Counter:
    form = transducer()
    out: Counter = Counter()
    for text in texts:
        for token in WORD.findall(without_mail(form(text))):
            out[token.lower() if token.isalpha() else JOINT.sub("", token).lower()] += 1
    return out


def train(texts: dict[str, list[str]], rounds: int = 3) -> Model:
    """Trees from labelled texts. Labels err and texts mix languages, so sentences are relabelled by the first trees
    and kept where they code well, before the trees are built again."""
    model = Model([Tree(c) for c in _vote([_words(texts.get(lang, [])) for lang in LANGS], CLEAR, OFTEN)])
    form = transducer()
    for _ in range(rounds - 1):
        kept: dict[str, list[str]] = {lang: [] for lang in LANGS}
        for own in texts.values():
            for text in own:
                plain = form(text)
                for a, b, lang, confidence, _ in model.passages(plain):
                    if lang is not None and confidence > 0.6:
                        kept[lang].append(plain[a:b])
        model = Model([Tree(c) for c in _vote([_words(kept[lang]) for lang in LANGS], 0.0, 1)])
    return model


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on the driver on at most rows distinct whole texts of each language from columns (text, lang)."""
    known = labelled.select("text", label_col(F.col("lang")).alias("lang")).where("lang is not null")
    return train(text_sample(known, "text", rows, chars, "lang"))


def segments(df: DataFrame, model: Model, keys: list[str], text_col: str) -> DataFrame:
    """(keys, segment, start_pos, end_pos, lang, confidence, full): the passages of each text, in its own positions.

    Null, empty and wordless texts have no row. A passage in none of the languages (filler, other languages) has a null
    lang. Ties between languages fall to the first of de, fr, it, en, es. Repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast([t.costs for t in model.trees])
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", segment int, start_pos int, end_pos int, lang string, confidence double, `full` boolean"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Tree.__new__(Tree) for _ in shared.value]
        for tree, costs in zip(trees, shared.value):
            tree.costs = costs
        own, form = Model(trees), transducer()
        for part in parts:
            at, rows = [], []
            for i, text in enumerate(part["_text"]):
                if not text:
                    continue
                plain, places = form.with_map(text)
                for n, (a, b, lang, confidence, full) in enumerate(own.passages(plain)):
                    at.append(i)
                    rows.append((n, places[a] if places else a, places[b] if places else b, lang, confidence, full))
            out = part[keys].iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["segment", "start_pos", "end_pos", "lang", "confidence", "full"])], axis=1)

    return df.select(*keys, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def documents(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lang, confidence, share): the language of most characters of each text, from segments()."""
    size = F.col("end_pos") - F.col("start_pos")
    per = found.where("lang is not null").groupBy(*keys, "lang").agg(F.sum(size).alias("chars"), F.max("confidence").alias("confidence"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("lang", "confidence", "chars"), F.struct("chars", "confidence", "lang")).alias("b"), F.sum("chars").alias("all"))
    return best.select(*keys, "b.lang", "b.confidence", F.try_divide(F.col("b.chars"), F.col("all")).alias("share"))
