"""The passes over the spans of one text: resolve, merge, widen, follow, number, replace. Plain Python for Arrow batches.

Spans are tuples (tag, start, end, canonical, source). Every pass sorts once and asks for free places by binary search,
so none compares all spans of a text with all others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.contract import ACTIONS, IN_PARTS, PROPAGATED, STAGES, THRESHOLDS
from ..functions.plain import CHECKS
from .recognise import Occupied, Span

#: Sources by rank where stage and length agree.
RANKS = {"regex": 0, "benutzer": 0, "model": 1}
LEAST_PART = 3
#: Signs that a span is widened by at most, on either side.
WIDEST = 50
_INNER = re.compile(r"[\w'’]")
WORD = re.compile(r"\w+")


def kept(spans: Iterable[Span], order: Callable[[Span], tuple]) -> list[Span]:
    """First come, first kept, in the given order: a span stays if it overlaps none that is kept already."""
    places, out = Occupied(), []
    for s in sorted(spans, key=order):
        if s[1] < s[2] and places.free(s[1], s[2]):
            places.take(s[1], s[2])
            out.append(s)
    return sorted(out, key=lambda s: s[1])


def resolve(spans: Iterable[Span], stages: dict[str, int] = STAGES) -> list[Span]:
    """Lower stage first, then longest, then in the given order; unknown tags come last. Empty spans are left out."""
    return kept(spans, lambda s: (stages.get(s[0], 9), s[1] - s[2]))


def widened(text: str, a: int, b: int, most: int = WIDEST) -> tuple[int, int]:
    """A place moved out to word boundaries where its edges lie inside a word."""
    if 0 < a < len(text) and _INNER.match(text[a]):
        a -= _run(reversed(text[max(0, a - most) : a]))
    if 0 < b and _INNER.match(text[b - 1]):
        b += _run(text[b : b + most])
    return a, b


def _run(signs: Iterable[str]) -> int:
    n = 0
    for c in signs:
        if not _INNER.match(c):
            break
        n += 1
    return n


Scored = tuple[str, int, int, float]


def merge(text: str, scored: Iterable[Scored], found: list[Span], thresholds: dict[str, float] | None = None) -> tuple[list[Span], list[tuple[str, str, str]], int]:
    """(spans, what was dropped as (tag, value, reason), spans that were widened) from model spans and recognised ones.

    Model spans below the tag's threshold are dropped, the others widened to words; those of a tag with check digits are
    dropped where the digits are wrong. What is left is kept greedily: tags with check digits first, then longest, then
    recognised before model. Where all agree, recognised tags with check digits, other recognised ones and model spans
    come in this order.
    """
    limits = thresholds or THRESHOLDS
    dropped, model, moved = [], [], 0
    for tag, a, b, score in scored:
        limit = limits.get(tag)
        if limit is not None and score < limit:
            dropped.append((tag, text[a:b], f"unter Schwelle {limit:.2f} ({score:.2f})"))
            continue
        c, d = widened(text, a, b)
        moved += (a, b) != (c, d)
        model.append((tag, c, d, None, "model"))
    first = lambda s: STAGES.get(s[0]) == 1
    good = []
    for s in model:
        if first(s) and not (s[0] in CHECKS and CHECKS[s[0]](text[s[1] : s[2]])):
            dropped.append((s[0], text[s[1] : s[2]], "Pruefsumme ungueltig"))
        else:
            good.append(s)
    everything = [s for s in found if first(s)] + [s for s in found if not first(s)] + good
    return kept(everything, lambda s: (1 if first(s) else 2, s[1] - s[2], RANKS.get(s[4], 1))), dropped, moved


class Words:
    """Places of the words of a text by the word, to find many values in it at the cost of one reading."""

    def __init__(self, text: str):
        self.text = text
        self.at: dict[str, list[int]] = {}
        for m in WORD.finditer(text):
            self.at.setdefault(m[0], []).append(m.start())

    def places(self, value: str) -> list[tuple[int, int]]:
        """(start, end) wherever the value stands as whole words, with any white space between its parts."""
        pieces = value.split()
        first = WORD.search(value)
        if not pieces or not first:
            return []
        lead = pieces[0].find(first[0])
        if lead < 0:  # the first part is signs only
            return [m.span() for m in _value(value).finditer(self.text)]
        pattern, out, end = _value(value), [], 0
        for at in self.at.get(first[0], ()):
            if at - lead >= end and (m := pattern.match(self.text, at - lead)):
                out.append(m.span())
                end = m.end()
        return out


@lru_cache(maxsize=50_000)
def _value(value: str) -> re.Pattern:
    body = r"\s+".join(re.escape(x) for x in value.split())
    return re.compile(rf"(?<!\w){body}(?!\w)")


def follow(text: str, spans: list[Span], tags: tuple[str, ...] = PROPAGATED) -> list[Span]:
    """The spans and every other free place where their values stand: whole values of all seeds in their order, then the
    capitalised parts of names and organisations. The seed's value is the canonical form."""
    seeds = [(s[0], text[s[1] : s[2]]) for s in spans if s[0] in tags]
    if not seeds:
        return sorted(spans, key=lambda s: s[1])
    wanted = list(dict.fromkeys((value, tag, value) for tag, value in seeds))
    for tag, value in dict.fromkeys(seeds):
        parts = [x for x in re.split(r"[\s\-]+", value) if len(x) >= LEAST_PART]
        if tag in IN_PARTS and len(parts) > 1:
            wanted += [(x, tag, value) for x in parts if x[0].isupper()]
    words, taken, out = Words(text), Occupied([(s[1], s[2]) for s in spans]), list(spans)
    done: set[str] = set()
    for needle, tag, value in wanted:
        if needle in done:  # its free places went to the first seed
            continue
        done.add(needle)
        for a, b in words.places(needle):
            if taken.free(a, b):
                taken.take(a, b)
                out.append((tag, a, b, value, "propagation"))
    return sorted(out, key=lambda s: s[1])


@dataclass
class Names:
    """What is replaced and under which name: tags with their action, label and stage."""

    actions: dict[str, str] = field(default_factory=lambda: dict(ACTIONS))
    labels: dict[str, str] = field(default_factory=dict)
    stages: dict[str, int] = field(default_factory=lambda: dict(STAGES))

    def masks(self, tag: str) -> bool:
        return self.actions.get(tag) == "mask"


Entry = tuple[str, str, str, int, int]


def numbered(text: str, spans: list[Span], names: Names) -> list[Entry]:
    """(tag, value, placeholder, start, end) of the spans to be replaced, by start.

    Values of one canonical form share a number, given per tag in order of first appearance; the canonical form has the
    bare number, its variants letters in order of appearance.
    """
    own = sorted((s for s in spans if names.masks(s[0])), key=lambda s: s[1])
    groups: dict[tuple[str, str], dict[str, None]] = {}
    for tag, a, b, canonical, _ in own:
        groups.setdefault((tag, canonical or text[a:b]), {})[text[a:b]] = None
    counts: dict[str, int] = {}
    name: dict[tuple[str, str, str], str] = {}
    for (tag, canonical), values in groups.items():
        counts[tag] = counts.get(tag, 0) + 1
        for i, value in enumerate(sorted(values, key=lambda v: v != canonical)):
            name[tag, canonical, value] = f"[{names.labels.get(tag, tag)}_{counts[tag]}{chr(96 + i) if i else ''}]"
    return [(tag, text[a:b], name[tag, canonical or text[a:b], text[a:b]], a, b) for tag, a, b, canonical, _ in own]


def replaced(text: str, entries: list[Entry]) -> str:
    out, last = [], 0
    for _, _, name, a, b in entries:
        out += [text[last:a], name]
        last = b
    return "".join(out) + text[last:]


def masked(text: str, spans: list[Span], names: Names, follows: bool = True) -> tuple[list[Span], list[Entry], str]:
    """(spans, entries, masked text): resolve, follow through the text, resolve again, number and replace."""
    spans = resolve(spans, names.stages)
    if follows:
        spans = resolve(follow(text, spans), names.stages)
    entries = numbered(text, spans, names)
    return spans, entries, replaced(text, entries)
