"""Problem 9: cut texts above a token limit at natural boundaries, consecutive pieces overlapping by given tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, clean, count, encoding, slices

#: Separators from coarse to fine; a cut stands after the match. Below the last, texts are cut between tokens.
LEVELS = (
    re.compile(r"\f|\n[ \t\r]*\n[ \t\r]*\n\s*|\n(?=#{1,6} )"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"[.!?…][\"'»”’)\]]*(?:\s+)(?=[^\W\d_a-zà-ÿ]|[\d«“\"(\[-])|\n"),
    re.compile(r"\s+"),
)


def spans_of_tokens(text: str, path: str = VOCABULARY) -> list[int]:
    """Character position at which each token begins; a token inside a character counts as beginning at it."""
    enc, starts = encoding(path), []
    for at, part in slices(text):
        ids = enc.encode_ordinary(clean(part))
        position = at
        for piece in enc.decode_tokens_bytes(ids):
            lead = sum((b & 0xC0) != 0x80 for b in piece)
            starts.append(position if lead and (piece[0] & 0xC0) != 0x80 else max(at, position - 1))
            position += lead
    return starts


def pieces(text: str, limit: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece; a text within the limit is one piece, an empty one none."""
    if not text:
        return []
    total = count(text, path)
    if total <= limit:
        return [(0, len(text), total)]
    starts = spans_of_tokens(text, path)
    room, atoms = limit - overlap, []
    size = lambda a, b: bisect_left(starts, b) - bisect_left(starts, a)

    def split(a: int, b: int, level: int) -> None:
        """Atoms are at most room tokens: a piece then holds its overlap and one atom at least."""
        if size(a, b) <= room:
            atoms.append(b)
            return
        if level < len(LEVELS):
            cuts = [m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b]
            for x, y in zip([a, *cuts], [*cuts, b]):
                split(x, y, level + 1)
            return
        while size(a, b) > room:
            k = bisect_left(starts, a) + room
            while k > 0 and starts[k] >= b or starts[k] <= a and k < len(starts) - 1:
                k += 1 if starts[k] <= a else -1
            if not a < starts[k] < b:
                break
            atoms.append(starts[k])
            a = starts[k]
        atoms.append(b)

    split(0, len(text), 0)
    enc, out, a, k = encoding(path), [], 0, 0
    while k < len(atoms):
        last = max(k, bisect_right(atoms, starts[min(len(starts) - 1, bisect_left(starts, a) + limit)]) - 1) if bisect_left(starts, a) + limit < len(starts) else len(atoms) - 1
        n = len(enc.encode_ordinary(clean(text[a : atoms[last]])))
        while n > limit and last > k:  # a cut inside a word may cost some tokens more
            last -= 1
            n = len(enc.encode_ordinary(clean(text[a : atoms[last]])))
        while n > limit:  # less overlap then
            a = starts[bisect_right(starts, a)]
            n = len(enc.encode_ordinary(clean(text[a : atoms[last]])))
        end = atoms[last]
        out.append((a, end, n))
        k = last + 1
        a = starts[max(bisect_left(starts, end) - overlap, bisect_right(starts, a))] if overlap else end
    return out


def chunk(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, path: str = VOCABULARY) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, piece_tokens, piece): texts within the limit come back as one piece.

    Null and empty texts give no piece. Without any separator a text is cut between characters. Equal texts under
    different ids, and repeated ids, are cut alike and separately. Other columns are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    id_type = dict(docs.dtypes)[id_col]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 256):  # bounds the memory of one batch of results
                rows = [(i, n, a, b, size, text[a:b]) for i, text in part.iloc[lo : lo + 256].itertuples(index=False) for n, (a, b, size) in enumerate(pieces(text, limit, overlap, path))]
                yield pd.DataFrame(rows, columns=["_id", "piece_no", "start_pos", "end_pos", "piece_tokens", "piece"])

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    return chosen.mapInPandas(cut, f"_id {id_type}, piece_no int, start_pos int, end_pos int, piece_tokens int, piece string").withColumnRenamed("_id", id_col)
