"""Problem 6: template residue, filler, error pages and script notices.

Positive-unlabelled naive Bayes: trusted records teach the residue class, expectation-maximization over a bounded sample
of all other records finds more of it, and the fitted word weights score every passage of every record.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_sample

#: Records that fit the classifier: at most so many distinct ones by hash order, of which so many others than the trusted
#: ones take part in the rounds; templates; and characters of each sample.
SAMPLE_ROWS, OTHER_ROWS, TEMPLATE_ROWS, SAMPLE_CHARS = 24_000, 16_000, 20_000, 60_000_000
ROUNDS = 8
#: A record is residue if the slot marks of one passage, or a run of passages, weigh more than these.
PASSAGE_ODDS, RUN_ODDS = 3.0, 8.0

PASSAGE = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+(?=[^\s\d])|\n+")
WORD = re.compile(r"[^\W\d_]+|\d+|\{\{?[^{}\n]{1,40}\}?\}|<<[^<>\n]{1,40}>>|\[\[[^\[\]\n]{1,40}\]\]|\[[^\[\]\n]{0,40}\]|<%?=?[^<>\n]{1,40}>|%[A-Za-z_~@]{2,40}%|\$[A-Za-z_]{2,40}\b|__+[A-Za-z_]*|\.{4,}|«[A-ZÄÖÜ_ ]{3,40}»|#[A-Za-z_~@]{2,40}#")
# Words of the classic filler text, and of trusted notices that stand alone.
FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat".split())
# Words that stand in brackets for a sign of a mail address.
SPELLED = frozenset("at dot punkt point punto chiocciola arroba arobase klammeraffe ät".split())
CODE = re.compile(r"\W*(?:HTTP\W*|Error\W*|Fehler\W*|Erreur\W*|Errore\W*)?[45]\d\d\b\W*\D{0,60}$", re.I)
NOTICE = re.compile(
    r"java\s?script|\bcookies?\b|\bbrowser|blindtext|platzhaltertext"
    r"|placeholder text|dummy text|texte de remplissage|testo (?:segnaposto|riempitivo)|texto de relleno|bad gateway|forbidden|internal server error|service unavailable"
    r"|access denied|timed out|zugriff verweigert|accès refusé|accesso negato|acceso denegado|zurück zur startseite|retour à l'accueil|torna alla pagina iniziale|volver al inicio|^\W*go back\W*$",
    re.I,
)
# Signs of which a notice that is no code holds one.
NOTICE_SIGNS = ("script", "cookie", "browser", "blindtext", "platzhaltertext", "placeholder", "dummy", "remplissage", "segnaposto", "riempitivo", "relleno", "gateway", "forbidden", "server error", "unavailable", "denied", "timed out", "verweigert", "refusé", "negato", "denegado", "startseite", "accueil", "pagina iniziale", "inicio", "go back")


def mark(token: str) -> str:
    """A bracketed token by its brackets and the kind of what they hold, so that unseen slot names count as seen."""
    body = token.strip("{}<>[]%$«»=_.#: ")
    lead = body[:1] if body[:1] in "@~#/" else ""
    body = body[len(lead) :]
    if not body:
        kind = "none"
    elif any(re.fullmatch(r"[A-ZÄÖÜ][A-ZÄÖÜ0-9_]{2,}|[a-zäöü]+(?:_[a-zäöü]+)+", x) for x in body.split()):
        kind = "name"
    elif re.fullmatch(r"[^\W\d]+(?: [^\W\d]+)+", body):
        kind = "words"
    elif len(body) > 1 and body.isalpha() and body.lower() not in SPELLED and token[:1] != "«":
        kind = "word"
    else:
        kind = "sign" if len(body) == 1 else "lead" if lead else "other"
    edge = "".join(ch for ch in token[:2] if ch in "{<[%$«_.#")
    return f"#{edge}{lead}{kind}"


def is_slot(feature: str) -> bool:
    return feature[:1] == "#" and feature.endswith(("name", "lead", "words", "word"))


def kind_of(feature: str) -> str:
    """A slot's feature without its brackets, for bracket forms that were never seen."""
    return f"*{next(k for k in ('name', 'lead', 'words', 'word') if feature.endswith(k))}"


def features(passage: str) -> list[str]:
    words = []
    for token in WORD.findall(passage):
        words.append("0" * min(len(token), 4) if token.isdigit() else token.lower() if token[0].isalpha() else mark(token))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])] + [kind_of(w) for w in words if is_slot(w)]


def passages(text: str) -> list[str]:
    return [x for x in PASSAGE.split(text) if x and not x.isspace()]


# Signs that any slot holds; texts without them need no closer look.
SLOT_SIGNS = re.compile(r"[{<\[%$«#]|__|\.{4}")
LETTERS = re.compile(r"[^\W\d_]+")


def trusted(text: str, content: frozenset[str] | set[str]) -> bool:
    """Residue beyond doubt: a slot with a name, mostly filler words, or a notice in a record without known content."""
    if SLOT_SIGNS.search(text) and any(is_slot(w) for x in passages(text) for w in features(x)):
        return True
    low = text.lower()
    words = LETTERS.findall(low)
    if len(words) >= 6 and sum(w in FILLER for w in words) >= 0.7 * len(words):
        return True
    parts = passages(text)
    if not any(map(CODE.match, parts)) and not (any(x in low for x in NOTICE_SIGNS) and any(map(NOTICE.search, parts))):
        return False
    # Three words in a row that stand in a template are content.
    for part in map(features, parts):
        pairs = [w in content for w in part if " " in w]
        if any(a and b for a, b in zip(pairs, pairs[1:])):
            return False
    return True


class Bayes:
    """Multinomial naive Bayes of residue against content; weights are log ratios of smoothed feature rates."""

    def __init__(self, content_texts: list[str], trusted_texts: list[str], other_texts: list[str], rounds: int = ROUNDS):
        content = Counter(f for text in content_texts for x in passages(re.sub(r"\{[^{}]*\}", " ", text)) for f in features(x))
        sure = [[features(x) for x in passages(t)] for t in trusted_texts]
        # Of a record with slots only the passages with slots are residue; the rest is content.
        positive, negative = Counter(), Counter(content)
        for parts in sure:
            slots = [any(is_slot(f) for f in part) for part in parts]
            for part, slot in zip(parts, slots):
                if slot:
                    positive.update(f for f in part if f[:1] in "#*")
                elif any(slots):
                    negative.update(part)
                else:
                    positive.update(part)
        # The others as rows of (record, feature, count), over which each round is a few sums.
        index: dict[str, int] = {f: i for i, f in enumerate(positive.keys() | negative.keys())}
        records, own, times = [], [], []
        for k, text in enumerate(other_texts):
            for f, n in Counter(f for x in passages(text) for f in features(x)).items():
                records.append(k)
                own.append(index.setdefault(f, len(index)))
                times.append(n)
        rows, cols, counts = np.array(records, dtype=np.int64), np.array(own, dtype=np.int64), np.array(times, dtype=float)
        size, total = len(index), len(other_texts)
        start_p, start_n = np.zeros(size), np.zeros(size)
        for into, given in ((start_p, positive), (start_n, negative)):
            for f, n in given.items():
                into[index[f]] = n
        posterior = np.zeros(total)
        weights = np.zeros(size)
        self.unseen = self.prior = 0.0
        seen = np.zeros(size, dtype=bool)
        for _ in range(rounds):
            q = posterior[rows]
            p = start_p + np.bincount(cols, np.where(q > 0.01, q, 0.0) * counts, size)
            n = start_n + np.bincount(cols, np.where(q < 0.99, 1 - q, 0.0) * counts, size)
            seen = (p > 0) | (n > 0)
            smooth, kinds = 0.05, max(1, int(seen.sum()))
            base_p, base_n = math.log(p.sum() + smooth * kinds), math.log(n.sum() + smooth * kinds)
            self.unseen = base_n - base_p
            weights = np.log(p + smooth) - np.log(n + smooth) + self.unseen
            mass = float(posterior.sum()) + len(sure)
            self.prior = math.log((mass + 1) / (total + len(sure) - mass + 1))
            odds = self.prior + 0.5 * np.bincount(rows, weights[cols] * counts, total)
            new = 1 / (1 + np.exp(-np.clip(odds, -50.0, 50.0)))
            moved = float(np.abs(new - posterior).sum())
            posterior = new
            if moved < 0.5:
                break
        self.weights: dict[str, float] = {f: float(weights[i]) for f, i in index.items() if seen[i]}

    def score(self, text: str) -> list[tuple[float, bool]]:
        """(log odds, has a slot) of each passage. Single words and pairs overlap, so their sum counts half."""
        out = []
        for x in passages(text):
            fs = features(x)
            slot = [f for f in fs if is_slot(f)]
            odds = 0.5 * sum(self.weights.get(f, 0.0) for f in fs)
            # A bracket form that was never seen counts as its kind, and one of an unseen kind as any unseen feature.
            out.append((max(self.weights.get(f, self.weights.get(kind_of(f), self.unseen)) for f in slot) if slot else odds, bool(slot)))
        return out

    def residue(self, text: str | None) -> tuple[bool, float]:
        """The decision on a record and its log odds; null and blank texts are no residue.

        A record is residue if a passage has a slot of a known kind, or if its strongest run of passages is: pages and
        notices may stand alone or be stuck to real text, while real text that reports on them is one passage of many.
        """
        scored = self.score(text) if text else []
        if not scored:
            return False, 0.0
        best = max((s - PASSAGE_ODDS for s, slot in scored if slot), default=-math.inf)
        run = -math.inf
        for s, slot in scored:
            if not slot:
                run = s + max(0.0, run)
                best = max(best, self.prior + run - RUN_ODDS)
        return best > 0, best


def fit(records: DataFrame, templates: DataFrame, text_col: str, rows: int = SAMPLE_ROWS, other_rows: int = OTHER_ROWS) -> Bayes:
    """Fit on the driver on a bounded sample by hash order; every record is scored later, whatever the sample held."""
    content = text_sample(templates, "text", TEMPLATE_ROWS, SAMPLE_CHARS).get("", [])
    known = {f for t in content for x in passages(re.sub(r"\{[^{}]*\}", " ", t)) for f in features(x) if " " in f}
    sure, others = [], []
    for x in text_sample(records, text_col, rows, SAMPLE_CHARS).get("", []):
        (sure if trusted(x, known) else others).append(x)
    return Bayes(content, sure, others[:other_rows])


def mark_residue(records: DataFrame, templates: DataFrame, id_col: str, text_col: str, fit_on: DataFrame | None = None) -> DataFrame:
    """(id, residue, odds) for every row; null, empty and blank texts are kept (residue = false, odds 0). The sample is
    taken from fit_on, by default the records; where they come from a costly plan, name the table behind them."""
    id_type = dict(records.dtypes)[id_col]
    model = fit(records if fit_on is None else fit_on, templates, text_col)
    weights = records.sparkSession.sparkContext.broadcast((model.weights, model.prior, model.unseen))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bayes = Bayes.__new__(Bayes)
        bayes.weights, bayes.prior, bayes.unseen = weights.value
        for part in parts:
            got = [bayes.residue(x) for x in part["_text"]]
            yield pd.DataFrame({"_id": part["_id"], "residue": [r for r, _ in got], "odds": [o for _, o in got]})

    return records.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id {id_type}, residue boolean, odds double").withColumnRenamed("_id", id_col)
