"""Scorers: what finds the details that no pattern can. A model is plugged in here; two scorers need none.

A scorer takes a table and a text column and adds a column of array<struct<tag, start, end, score>>, which
mask.filter_texts merges with what the patterns find.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recognise import lists_array

SCORED = "array<struct<tag:string,start:int,end:int,score:double>>"
Find = tuple[str, int, int, float]
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: Entries that a word list may have, as it goes to every worker.
MOST_ENTRIES = 2_000_000


class Scorer(Protocol):
    def scored(self, df: DataFrame, text_col: str, into: str) -> DataFrame:
        """The table with the column `into` of SCORED."""


class FunctionScorer:
    """Wraps a model: load is called once a worker and gives a function from texts to finds."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[Find]]]]):
        self.load = load

    def scored(self, df: DataFrame, text_col: str, into: str = "scored") -> DataFrame:
        """Null texts have no finds."""
        load = self.load

        @F.arrow_udf(SCORED)
        def done(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            score = load()
            for part in parts:
                yield lists_array(score([t or "" for t in part.to_pylist()]), ["tag", "start", "end", "score"], [pa.string(), pa.int32(), pa.int32(), pa.float64()])

        return df.withColumn(into, done(F.col(text_col)))


class TableScorer:
    """Scores that stand in a table (key, tag, start_pos, end_pos, score), such as those of a model that ran elsewhere."""

    def __init__(self, scores: DataFrame, key: str):
        self.scores, self.key = scores, key

    def scored(self, df: DataFrame, text_col: str, into: str = "scored") -> DataFrame:
        """Texts without scores have an empty list; scores with nulls are left out."""
        whole = F.col("tag").isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull() & F.col("score").isNotNull()
        own = self.scores.where(whole).groupBy(self.key).agg(F.sort_array(F.collect_list(F.struct(F.col("start_pos").cast("int").alias("start"), F.col("end_pos").cast("int").alias("end"), "tag", F.col("score").cast("double").alias("score")))).alias("_s"))
        listed = F.transform("_s", lambda s: F.struct(s["tag"].alias("tag"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
        return df.join(own, self.key, "left").withColumn(into, F.coalesce(listed, F.array().cast(SCORED))).drop("_s")


def finds(text: str, entries: dict[tuple[str, ...], tuple[str, float]], firsts: dict[str, int]) -> list[Find]:
    """Entries of one to several words in a text, the longest at each place, from left to right."""
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    out, i = [], 0
    while i < len(words):
        for n in range(min(firsts.get(words[i][2], 0), len(words) - i), 0, -1):
            own = words[i : i + n]
            if all(text[a[1] : b[0]] == " " for a, b in zip(own, own[1:])) and (hit := entries.get(tuple(w[2] for w in own))):
                out.append((hit[0], own[0][0], own[-1][1], hit[1]))
                i += n - 1
                break
        i += 1
    return out


class GazetteerScorer:
    """Finds the entries of a word list (name, tag, score) as whole words. Of an entry with several tags the best score
    counts, then the first tag."""

    def __init__(self, entries: DataFrame, most: int = MOST_ENTRIES):
        best = entries.where("name is not null and tag is not null").groupBy(F.trim("name").alias("name")).agg(F.max_by("tag", F.struct("score", "tag")).alias("tag"), F.max("score").alias("score"))
        rows = best.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the word list has more than {most} entries")
        self.entries: dict[tuple[str, ...], tuple[str, float]] = {}
        for r in rows:
            if words := tuple(_WORD.findall(r["name"])):
                self.entries[words] = (r["tag"], float(r["score"]))

    def scored(self, df: DataFrame, text_col: str, into: str = "scored") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.entries)

        def load() -> Callable[[list[str]], list[list[Find]]]:
            entries = shared.value
            firsts: dict[str, int] = {}
            for words in entries:
                firsts[words[0]] = max(firsts.get(words[0], 0), len(words))
            return lambda texts: [finds(t, entries, firsts) for t in texts]

        return FunctionScorer(load).scored(df, text_col, into)


def used_tokens(texts: DataFrame, tokens: Column) -> DataFrame:
    """(token, n): the tokens that occur in all texts together; counted before the shuffle."""
    return texts.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
