"""Rules of the user: word lists, labelled values and patterns, checked before they run."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
from collections.abc import Iterable

from pyspark.sql import Column

from ..functions.contract import STAGES
from .recognise import Rule, recognise

# Forms a labelled value may have, {a} and {b} are its least and greatest length; in the second group two
# signs at the edges are counted apart. Then the older names of keys, kinds and forms, which are still read.
FORMS = {"digits": r"\d{{{a},{b}}}", "alphanumeric": r"[A-Za-z0-9][A-Za-z0-9.\-]{{{a},{b}}}", "to_end_of_line": r"[^\n]{{{a},{b}}}", "digits_grouped": r"\d[\d.\s'-]{{{a},{b}}}\d", "letter_digits": r"[A-Za-z]{{1,3}}[-.\s]?\d{{{a},{b}}}"}
EDGED = frozenset(("digits_grouped", "letter_digits"))
OLDER = {"name": "bezeichnung", "placeholder": "platzhalter", "type": "art", "words": "woerter", "ignore_case": "ohne_gross", "labels": "etiketten", "value_form": "wertform", "pattern": "muster", "window": "fenster", "same_line": "gleiche_zeile", "max_distance": "hoechstabstand", "not_after": "nicht_nach"}
OLDER_KINDS = {"wortliste": "wordlist", "words": "wordlist", "etikett": "label"}
OLDER_FORMS = {"ziffern": "digits", "ziffern_gruppiert": "digits_grouped", "alphanumerisch": "alphanumeric", "buchstabe_ziffern": "letter_digits", "bis_zeilenende": "to_end_of_line"}
LEAST_WORD, BUDGET_S, LONGEST = 3, 0.25, 200
PROBE = "Musterstrasse 12, 3011 Bern, Dossier 2024-1234567890 " * 200

_CHILD = """
import re, sys, time
pattern, probe = sys.stdin.buffer.read().decode().split("\\0")
began = time.perf_counter()
for _ in re.finditer(pattern, probe): pass
print(time.perf_counter() - began)
"""


def word_list(words: list[str]) -> str:
    """Longest first, whole words."""
    own = sorted({w for w in words if w.strip()}, key=lambda w: (-len(w), w))
    if not own or len(own[-1]) < LEAST_WORD:
        raise ValueError(f"a word list needs words, of {LEAST_WORD} signs at least")
    return rf"\b(?:{'|'.join(map(re.escape, own))})\b"


def checked(pattern: str, probe: str = PROBE, budget: float = BUDGET_S) -> str:
    """The pattern, if it compiles and is done with a probe in time. The probe runs in a process of its own, which is ended
    when the time is over, whatever the pattern does."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"no valid pattern: {e}") from e
    try:
        done = subprocess.run([sys.executable, "-S", "-c", _CHILD], input=f"{pattern}\0{probe}".encode(), capture_output=True, timeout=2 + 4 * budget, check=True)
    except (subprocess.TimeoutExpired, subprocess.CalledProcessError) as e:
        raise ValueError("the pattern takes too long") from e
    if float(done.stdout) > budget:
        raise ValueError("the pattern takes too long")
    return pattern


def load(rules: Iterable[dict], findings: list[str] | None = None) -> dict[str, Rule]:
    """Rules by tag X_<id>; what is wrong raises. Older names of keys and kinds, and a stage, which has no effect, are
    read and noted in findings."""
    notes = findings if findings is not None else []
    out: dict[str, Rule] = {}
    labels: set[str] = set()
    for r in rules:

        def get(key: str, default=None, r=r):
            if key in r:
                return r[key]
            old = OLDER.get(key, key)
            if old in r:
                notes.append(f"{old} -> {key}")
            return r.get(old, default)

        ident = str(r.get("id", "")).strip()
        if not re.fullmatch(r"[a-z0-9_]{2,32}", ident):
            raise ValueError(f"id {ident!r}")
        label = str(get("placeholder") or ident).strip()
        if not re.fullmatch(r"[A-Za-z0-9]{2,20}", label):
            raise ValueError(f"placeholder {label!r}")
        # One placeholder for two tags would stand for two values.
        if label in STAGES or label in labels or f"X_{ident}" in out:
            raise ValueError(f"{ident}: taken")
        labels.add(label)
        notes += [f"{k} has no effect" for k in ("stage", "stufe") if k in r]
        kind = get("type", "label")
        if kind in OLDER_KINDS:
            notes.append(f"{kind} -> {OLDER_KINDS[kind]}")
            kind = OLDER_KINDS[kind]
        anchors: tuple[str, ...] = ()
        ignore_case = False
        if kind == "wordlist":
            pattern, ignore_case = word_list([str(w) for w in get("words", [])]), bool(get("ignore_case", False))
        elif kind == "label":
            anchors = tuple(str(x) for x in get("labels", []) if str(x))
            form = OLDER_FORMS.get(get("value_form", "digits"), get("value_form", "digits"))
            a, b = int(r.get("min", 1)), int(r.get("max", 20))
            if not anchors or form not in FORMS or not 1 <= a <= b <= LONGEST:
                raise ValueError(f"{ident}: labels, form or lengths")
            cut = 2 if form in EDGED else 0
            pattern = FORMS[form].format(a=max(0, a - cut), b=max(0, b - cut))
        elif kind == "regex":
            if not get("pattern"):
                raise ValueError(f"{ident}: no pattern")
            pattern, anchors = checked(str(get("pattern"))), tuple(str(x) for x in get("labels", []) if str(x))
        else:
            raise ValueError(f"{ident}: type {kind!r}")
        out[f"X_{ident}"] = Rule(
            f"X_{ident}", pattern, ignore_case, None, anchors, bool(anchors), int(get("window", 40)), False, bool(get("same_line", True)), get("max_distance", 3), tuple(get("not_after", ())), "benutzer", label
        )
    return out


def load_file(path: str, findings: list[str] | None = None) -> dict[str, Rule]:
    """Rules from a file: JSON, or YAML where a reader for it is installed; a missing file has none."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        data = json.loads(body)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no JSON, and no reader for YAML here") from e
        try:
            data = yaml.safe_load(body) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"no valid YAML: {e}") from e
    return load(data.get("rules", data.get("regeln", [])) if isinstance(data, dict) else data, findings)


def apply(text: Column, rules: dict[str, Rule]) -> Column:
    """array<span> of the rules, source benutzer; null and empty texts have none."""
    return recognise(text, rules, iban=False)
