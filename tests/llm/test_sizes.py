from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilspark.llm import chunking, mixing, packing, tokens


def test_best_fit_finds_the_tightest_bin():
    rng = random.Random(2)
    for _ in range(30):
        cap = rng.randint(5, 60)
        sizes = sorted((rng.randint(0, cap) for _ in range(80)), reverse=True)
        got, left, want = packing.best_fit(sizes, cap), [], []
        for s in sizes:  # brute force over all open bins
            fits = [r for r in left if r >= s]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - s)
                want.append(min(fits) - s)
            else:
                left.append(cap - s)
                want.append(cap - s)
        used = defaultdict(int)
        for s, b in zip(sizes, got):
            used[b] += s
        assert sorted(cap - u for u in used.values()) == sorted(left) and max(used.values()) <= cap


def test_packing_keeps_every_token(spark):
    rows = [(i, s) for i, s in enumerate([10, 0, None, 95, 100, 101, 250, 7, 7, 33])] + [(0, 10), (None, 5)]
    df = spark.createDataFrame(rows, "id bigint, n bigint").withColumn("container", F.lit("clash"))
    out = packing.pack(df, "id", "n", 100).collect()
    total, bins = defaultdict(int), defaultdict(int)
    for r in out:
        total[r["id"]] += r["piece_tokens"]
        bins[r["container"]] += r["piece_tokens"]
    assert total == {0: 20, 1: 0, 2: 0, 3: 95, 4: 100, 5: 101, 6: 250, 7: 7, 8: 7, 9: 33, None: 5} and max(bins.values()) <= 100
    assert {r["id"] for r in out if r["piece_no"] > 0} == {5, 6}
    assert packing.pack(df.where("id < -1"), "id", "n", 100).count() == 0
    assert packing.fill_report(packing.pack(df, "id", "n", 100), 100).first()["tokens"] == 618


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2] and mixing.sainte_lague([0, 0], 5) == [0, 0] and mixing.sainte_lague([1, 1], 4, [1, 9]) == [1, 2]


def test_mix_meets_shares_and_names_what_cannot(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i % 3 == 0 else "b", rng.randint(1, 50)) for i in range(3000)] + [(9000 + i, "c", 5) for i in range(10)] + [(9900, None, 7), (9901, "x", 9), (9902, "a", None)]
    df = spark.createDataFrame(rows, "id bigint, source string, n bigint").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 2), ("c", 0.1, 2), ("d", 0.0, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, targets, "id", "source", "n")
    r = {x["source"]: x for x in report.collect()}
    assert (r["a"]["reachable"], r["b"]["reachable"], r["c"]["reachable"], r["d"]["reachable"]) == (True, True, False, True)
    assert abs(r["a"]["share_of_total"] - 0.6) < 0.01 and abs(r["b"]["share_of_total"] - 0.3) < 0.01 and r["c"]["drawn_tokens"] == 100
    assert all(1 <= x["repeats"] <= {"a": 3, "b": 2, "c": 2}[x["source"]] for x in chosen.collect())
    assert mixing.mix(df.where("id < 0"), targets, "id", "source", "n")[0].count() == 0


@pytest.mark.parametrize("text", ["ein Satz. " * 900, "ä" * 4000, "😀" * 1500, "wort\n\n" * 1200, " " * 9000, "kurz", "# A\n" + "b " * 3000, "x" * 20_000])
def test_pieces_cover_the_text_within_the_limit(text):
    ps = chunking.pieces(text, 256, 32)
    assert ps[0][0] == 0 and ps[-1][1] == len(text) and all(tokens.count(text[a:b]) == n <= 256 for a, b, n in ps)
    for (a, b, _), (c, e, _) in zip(ps, ps[1:]):
        assert a < c <= b < e and tokens.count(text[c:b]) <= 40
    assert (len(ps) > 1) == (tokens.count(text) > 256)


def test_natural_cuts_and_edges(spark):
    text = "\n\n".join(" ".join(["Dieser Satz steht hier."] * 12) for _ in range(20))
    assert all(text[:b].endswith(("\n\n", ". ", ".")) for _, b, _ in chunking.pieces(text, 256, 32))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "kurz"), (4, "kurz")], "id bigint, t string").withColumn("piece_no", F.lit("clash"))
    got = chunking.chunk(df, "id", "t", 256, 32).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got}[4] == 2 and {r["id"] for r in got} == {1, 4}
    with pytest.raises(ValueError):
        chunking.chunk(df, "id", "t", 10, 10)
