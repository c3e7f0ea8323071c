"""Token sizes under a public vocabulary. The vocabulary file is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Texts above this many characters are counted in slices cut where a word begins, so that memory stays bounded.
SLICE = 200_000


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("veilspark", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """Lone surrogates can't be encoded; they count as the replacement sign."""
    return text.encode("utf-8", "replace").decode("utf-8")


def slices(text: str, step: int = SLICE) -> Iterator[tuple[int, str]]:
    """(offset, slice): each cut stands before a single space between two letters, where the split pattern cuts anyway."""
    at, n = 0, len(text)
    while n - at > 2 * step:
        m = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])").search(text, at + step)
        if not m:
            break
        yield at, text[at : m.start()]
        at = m.start()
    yield at, text[at:]


def count(text: str | None, path: str = VOCABULARY) -> int:
    if not text:
        return 0
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(clean(part))) for _, part in slices(text))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty."""

    @F.pandas_udf("bigint")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding(path)
        for part in parts:
            yield pd.Series([count(x, path) for x in part], dtype="int64")

    return counted(text)
