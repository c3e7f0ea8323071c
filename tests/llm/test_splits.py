from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilspark.llm import splits as S

EX = "example_id bigint, template_id string, dossier_nr string, lang string, geladen_am timestamp_ntz, text string, spans string"
TP = "template_id string, derived_from string, lang string"


def examples(spark, rows):
    return spark.createDataFrame(rows, "example_id bigint, template_id string, dossier_nr string, lang string").withColumns({"geladen_am": F.lit(None).cast("timestamp_ntz"), "text": F.lit("x"), "group_key": F.lit("clash")})


def truth(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[top(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def found(df):
    groups = defaultdict(set)
    for r in df.collect():
        groups[r["component"]].add(r["node"])
    return {frozenset(g) for g in groups.values()}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 120)}", f"n{rng.randint(0, 120)}") for _ in range(90)]
    edges += [(f"p{i}", f"p{i + 1}") for i in range(40)]  # a long path
    edges += [("hub", f"h{i}") for i in range(300)]  # a hot node
    df = spark.createDataFrame(edges + edges[:20] + [(None, "n1")], "a string, b string")
    assert found(S.components(df)) == truth(edges)
    assert found(S.components(df, one_task=0)) == truth(edges)  # merging in rounds only


def test_groups_across_spellings(spark):
    templates = spark.createDataFrame([("de_a", "de_b.v3", "de"), ("de_b", None, "de"), ("de_c", "«gone»", "de"), ("de_x", "de/y.yaml#de_y", "de"), ("de_y", "DE-X", "de")], TP)
    rows = [(1, " DE_A ", None, "de"), (2, "it/z.yaml#de_b", "D00-000001", "x"), (3, None, "d00/000001 ", None), (4, "de_c_rev2", None, "de"), (5, "unknown", "D00-000009", "de"), (6, "?", "d00-000009", "fr"), (7, "", None, "de"), (8, "de-x", None, "de"), (8, "de-x", None, "de"), (9, None, "D00-000001", "de")]
    got = {r["example_id"]: r["group_key"] for r in S.groups(examples(spark, rows), templates)[0].collect()}
    assert got == {1: "de_a", 2: "de_a", 3: "de_a", 9: "de_a", 4: "de_c", 5: "D00-000009", 6: "D00-000009", 7: None, 8: "de_x"}


def test_splits_keep_groups_whole_and_meet_shares(spark):
    rng = random.Random(1)
    names = [f"t_{i}" for i in range(300)]
    templates = spark.createDataFrame([(n, None, "de") for n in names], TP)
    rows = [(i, "t_0" if i % 10 == 0 else rng.choice(names), None, rng.choice(["de", "fr", "Deutsch", None])) for i in range(6000)]
    out = S.split(examples(spark, rows), templates, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(out) == 6000 and all(len({r["split"] for r in out if r["group_key"] == k}) == 1 for k in {r["group_key"] for r in out})
    share = Counter(r["split"] for r in out)
    assert abs(share["train"] / 6000 - 0.8) < 0.03 and abs(share["test"] / 6000 - 0.1) < 0.03


def test_empty_tables(spark):
    empty = examples(spark, [])
    templates = spark.createDataFrame([], TP)
    assert S.split(empty, templates, {"train": 1.0}).count() == 0 and S.groups(empty, templates)[0].count() == 0


def test_hubs_are_spread(spark):
    edges = [("hub", f"h{i}") for i in range(400)] + [("hub", "hub2")] + [("hub2", f"g{i}") for i in range(300)] + [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("p30", "h5"), ("x", "y"), ("z", "z")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert found(S.components(df, hot_links=20)) == truth(edges) == found(S.components(df, one_task=0, hot_links=20))


def test_ranges_are_cut_in_hash_order():
    buckets = {(lang, b): 10 for lang in ("de", "fr") for b in range(100)}
    out = S.cuts(buckets, {lang: {"train": 800, "validation": 100, "test": 100} for lang in ("de", "fr")})
    for lang in ("de", "fr"):
        own = [out[lang, b] for b in range(100)]
        assert own == ["train"] * 80 + ["validation"] * 10 + ["test"] * 10
    # Where no split needs more, all take alike.
    assert sorted(S.cuts({("de", b): 5 for b in range(4)}, {"de": {"train": -3.0, "test": 0.0}}).values()) == ["test", "test", "train", "train"]
