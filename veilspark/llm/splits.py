"""Problem 1: train, validation and test splits that keep linked records together.

Links form a graph of templates and dossiers. Its components come from concurrent breadth-first searches: adjacency is
hash-partitioned, every locally strongest node seeds a search, and all frontiers advance one step a round. Searches that
meet have their seed labels merged in the graph of colliding labels, which is smaller by a level each time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, label_col, latest, salted_join

#: Edges of colliding labels that one task may merge; more are merged by another round of searches.
ONE_TASK_EDGES = 1_000_000
#: Hash ranges of components that are cut in their order, and components that the driver places one by one.
BUCKETS, LARGE = 4_096, 4_096
#: A node of more links than this, and than a share of 1 / MOST_HOT of all, has its links spread over several partitions.
HOT_LINKS, MOST_HOT = 50_000, 10_000


def plain_template(raw: Column) -> Column:
    """A template id without path, quotes, case, separators and version mark; null if nothing is left."""
    x = F.regexp_replace(F.lower(raw), r"[\s«»\"'`‹›„“”]+", " ")
    x = F.regexp_replace(F.trim(F.substring_index(x, "#", -1)), r"^.*/|\.ya?ml$", "")
    x = F.regexp_replace(x, r"(?:[@._\- ]v|[@._\- ]rev(?:ision)?[._\-]?)\d+$", "")
    x = F.regexp_replace(F.trim(x), r"[\s\-._]+", "_")
    return F.nullif(x, F.lit(""))


def plain_dossier(raw: Column) -> Column:
    """Letters and digits of a dossier number, upper case; null if there are none."""
    return F.nullif(F.regexp_replace(F.upper(raw), r"[^\p{L}\p{N}]", ""), F.lit(""))


def shape(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"\p{N}", "9"), r"\p{Lu}", "A")


def usual_shape(ids: DataFrame, column: str) -> str | None:
    """The way in which most ids are written, as a shape of 9 and A; ties fall to the smallest."""
    top = ids.where(F.col(column).isNotNull()).groupBy(shape(F.col(column)).alias("s")).count().orderBy(F.desc("count"), "s").first()
    return top["s"] if top else None


def in_shape(plain: Column, form: str | None) -> Column:
    """The plain id spread over the letters and digits of the form, if their kinds agree; else the plain id."""
    if not form:
        return plain
    groups, target, run, k = "", "", "", 0
    for kind in form + "\0":
        if run and kind != run[0] or kind not in "9A" and not run:
            if run:
                k += 1
                groups += f"({'[0-9]' if run[0] == '9' else '[A-Z]'}{{{len(run)}}})"
                target += f"${k}"
            run = ""
        if kind in "9A":
            run += kind
        elif kind != "\0":
            target += "\\" + kind if kind in "$\\" else kind
    return F.regexp_replace(plain, f"^{groups}$", target)


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in parts:
        for a, b in zip(part["a"], part["b"]):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "component": [top(x) for x in nodes]}, columns=["node", "component"])


def _dealt(df: DataFrame, node: str, salts: str) -> DataFrame:
    """A row for each part that a node's links are spread over."""
    return df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).withColumn("_key", F.col(node))


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES, hot_links: int = HOT_LINKS) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); the component is one of its nodes.

    Repeated edges, loops and both directions are allowed; edges with a null end are left out. A node that only has a
    loop is a component of its own. The links of a hub are spread over as many partitions as its share of them asks for,
    and what is joined to them comes once for each.
    """
    kind = dict(edges.dtypes)["a"]
    pairs = edges.where("a is not null and b is not null").select("a", "b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = both.groupBy("a").agg(F.count_if(F.col("a") != F.col("b")).alias("degree"), F.count("*").alias("n"))
    least = max(hot_links, both.count() // MOST_HOT)
    # Fewer than MOST_HOT nodes can have that share of the links, so the broadcast is bounded.
    hot = F.broadcast(degrees.where(F.col("n") > least).select(F.col("a").alias("h"), F.ceil(F.col("n") / least).cast("int").alias("parts")))
    spread_a = both.join(hot, F.col("a") == F.col("h"), "left").withColumn("sa", F.coalesce("parts", F.lit(1))).drop("h", "parts")
    spread_b = spread_a.join(hot, F.col("b") == F.col("h"), "left").withColumn("sb", F.coalesce("parts", F.lit(1))).drop("h", "parts")
    part = lambda other, salts: F.pmod(F.xxhash64(other), F.col(salts)).cast("int")
    dealt = spread_b.withColumn("pa", part("b", "sa")).withColumn("pb", part("a", "sb"))
    links = cut(dealt.where("a <> b").repartition("a", "pa"))
    power = degrees.join(hot, F.col("a") == F.col("h"), "left").select(F.col("a").alias("node"), F.coalesce("parts", F.lit(1)).alias("salts"), F.struct("degree", F.xxhash64("a").alias("h"), F.col("a").alias("n")).alias("power"))
    power = cut(power)
    there = _dealt(power, "node", "salts").select(F.col("_key").alias("b"), F.col("_part").alias("pb"), "power")
    strongest = links.join(there, ["b", "pb"]).groupBy("a").agg(F.max("power").alias("most"))
    seeds = power.join(strongest, F.col("node") == F.col("a"), "left").where("most is null or power > most").select("node", F.col("node").alias("label"), "salts")
    labels = frontier = cut(seeds)
    while True:
        steps = _dealt(frontier, "node", "salts").select(F.col("_key").alias("a"), F.col("_part").alias("pa"), "label")
        met = steps.join(links, ["a", "pa"]).groupBy("b").agg(F.min("label").alias("label"), F.first("sb").alias("salts")).select(F.col("b").alias("node"), "label", "salts")
        frontier = cut(met.join(labels.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        labels = labels.unionByName(frontier)
    labels = cut(labels.repartition("node"))
    left = _dealt(labels, "node", "salts").select(F.col("_key").alias("a"), F.col("_part").alias("pa"), F.col("label").alias("la"))
    right = _dealt(labels, "node", "salts").select(F.col("_key").alias("b"), F.col("_part").alias("pb"), F.col("label").alias("lb"))
    collisions = cut(links.where("a < b").join(left, ["a", "pa"]).join(right, ["b", "pb"]).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    labels = labels.drop("salts")
    n = collisions.count()
    if not n:
        return labels.withColumnRenamed("label", "component")
    if n <= one_task:
        merged = collisions.coalesce(1).mapInPandas(_merge, f"node {kind}, component {kind}")
    else:
        merged = components(collisions, one_task, hot_links)
    merged = merged.select(F.col("node").alias("label"), "component")
    # A label may stand for most nodes of the graph.
    met = salted_join(labels, merged, "label", F.xxhash64("node"))
    return met.select("node", F.coalesce("component", "label").alias("component"))


def groups(examples: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(example_id, lang, group_key for linked examples else null; and the template groups).

    Example rows that were delivered again count once. Unknown or missing templates link nothing; a derived_from that
    names no known template links nothing; circles are harmless. group_key is the smallest plain template id of the
    group or, without any template, the dossier number in the table's usual spelling.
    """
    known = templates.select(plain_template(F.col("template_id")).alias("t"), F.trim("template_id").alias("as_written"), plain_template(F.col("derived_from")).alias("d")).where("t is not null")
    names = known.groupBy("t").agg(F.min("as_written").alias("as_written"))
    rows = latest(examples.select("example_id", "template_id", "dossier_nr", "lang", "geladen_am"), "example_id", "geladen_am")
    rows = rows.select("example_id", "lang", plain_template(F.col("template_id")).alias("t"), plain_dossier(F.col("dossier_nr")).alias("dossier"))
    tagged = salted_join(rows, names.select("t", F.lit(True).alias("is_known")), "t", F.xxhash64("example_id"))
    rows = cut(tagged.select("example_id", "lang", F.when(F.col("is_known"), F.concat(F.lit("t:"), "t")).alias("tn"), F.concat(F.lit("d:"), "dossier").alias("dn")))
    derived = known.join(names.select(F.col("t").alias("d")), "d").select(F.concat(F.lit("t:"), "t").alias("a"), F.concat(F.lit("t:"), "d").alias("b"))
    alone = names.select(F.concat(F.lit("t:"), "t").alias("a"), F.concat(F.lit("t:"), "t").alias("b"))
    used = rows.where("dn is not null").select(F.coalesce("tn", "dn").alias("a"), F.col("dn").alias("b")).distinct()
    found = components(derived.unionByName(alone).unionByName(used))
    written = names.select(F.concat(F.lit("t:"), "t").alias("node"), "as_written")
    form = usual_shape(examples.select("dossier_nr"), "dossier_nr")
    keyed = found.join(written, "node", "left").withColumn("as_dossier", F.when(F.col("node").startswith("d:"), in_shape(F.expr("substring(node, 3)"), form)))
    # The number of nodes of one component is unbounded, so each key is found by a partial aggregate and joined back.
    best = keyed.groupBy("component").agg(F.min("as_written").alias("t"), F.min("as_dossier").alias("d")).select("component", F.coalesce("t", "d").alias("group_key"))
    node_keys = cut(found.join(best, "component").select("node", "group_key"))
    # Rows with a dossier join by it, the others by template; one of either may hold a third of all rows.
    linked = salted_join(rows.withColumn("node", F.coalesce("dn", "tn")), node_keys, "node", F.xxhash64("example_id"))
    return linked.select("example_id", "lang", "group_key"), names


def place(units: list[tuple[str, dict[str, int]]], shares: dict[str, float]) -> dict[str, str]:
    """Split of each unit, largest first: the one in which the unit adds least to the squared misses per language."""
    totals: dict[str, int] = defaultdict(int)
    for _, counts in units:
        for lang, n in counts.items():
            totals[lang] += n
    have = {s: defaultdict(int) for s in shares}
    out = {}
    for unit, counts in units:

        def cost(split: str) -> float:
            # change of sum((have - goal)^2 / goal) over the languages of the unit
            return sum(((2 * (have[split][lang] - (goal := shares[split] * totals[lang])) + n) * n) / max(goal, 1e-9) for lang, n in counts.items())

        split = min((s for s in shares if shares[s] > 0), key=cost)
        out[unit] = split
        for lang, n in counts.items():
            have[split][lang] += n
    return out


def cuts(buckets: dict[tuple[str, int], int], needs: dict[str, dict[str, float]]) -> dict[tuple[str, int], str]:
    """Split of each (language, hash range): of each language the ranges are walked in hash order, and the splits follow
    each other as their needs are met; a range belongs where its middle falls."""
    out = {}
    for lang in sorted({x for x, _ in buckets}):
        own = sorted(k for k in buckets if k[0] == lang)
        need = {s: max(0.0, n) for s, n in needs[lang].items() if n > 0} or {s: 1.0 for s in needs[lang]}
        whole, total = sum(need.values()), sum(buckets[k] for k in own)
        ends, reach = [], 0.0
        for s, n in need.items():
            reach += n / whole * total
            ends.append((reach, s))
        before = 0.0
        for k in own:
            middle = before + buckets[k] / 2
            out[k] = next((s for end, s in ends if middle < end), ends[-1][1])
            before += buckets[k]
    return out


def split(examples: DataFrame, templates: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """(example_id, group_key, split): whole groups, in the given shares, with the languages spread alike.

    The largest groups (at most LARGE, each above a 1/BUCKETS share) are placed one by one where they disturb least. All
    others are cut by component hash order: the components whose main language is the same are lined up by hash, in
    BUCKETS ranges, and the splits follow each other by what they still need. Examples without links are groups of their
    own. A group larger than a split's share can miss it by that much. An empty table gives no rows.
    """
    rows, _ = groups(examples, templates)
    rows = cut(rows.select("example_id", "group_key", F.coalesce(label_col(F.col("lang")), F.lit("other")).alias("lang"), F.coalesce("group_key", F.concat(F.lit("row:"), F.col("example_id").cast("string"))).alias("unit")))
    sizes = rows.groupBy("unit", "lang").count()
    whole = cut(sizes.groupBy("unit").agg(F.sum("count").alias("n"), F.max_by("lang", F.struct("count", "lang")).alias("main"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("langs")))
    total = whole.agg(F.sum("n")).first()[0]
    if not total:
        return rows.select("example_id", "group_key", F.lit(None).cast("string").alias("split"))
    large = [(r["unit"], r["langs"]) for r in whole.where(F.col("n") * BUCKETS > total).orderBy(F.desc("n"), "unit").limit(LARGE).collect()]
    placed = place(large, shares)
    bucket = F.floor((F.xxhash64("unit", F.lit(seed)) / F.lit(2.0**64) + 0.5) * BUCKETS).cast("int")
    rest = whole
    if placed:
        names = F.broadcast(rows.sparkSession.createDataFrame(list(placed.items()), "unit string, split string"))  # at most LARGE rows
        rest = whole.join(names, "unit", "left_anti")
    ranges = {(r["main"], r["bucket"]): r["n"] for r in rest.groupBy("main", bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()}
    have = {lang: dict.fromkeys(shares, 0) for lang, _ in ranges}
    sums = dict.fromkeys(have, 0)
    for unit, langs in large:
        for lang, n in langs.items():
            if lang in have:
                have[lang][placed[unit]] += n
                sums[lang] += n
    for (lang, _), n in ranges.items():
        sums[lang] += n
    where = cuts(ranges, {lang: {s: share * sums[lang] - have[lang][s] for s, share in shares.items()} for lang in have})
    # At most languages x BUCKETS rows, so the broadcast is bounded.
    table = F.broadcast(rows.sparkSession.createDataFrame([(*k, s) for k, s in where.items()], "main string, bucket int, split string"))
    units = rest.withColumn("bucket", bucket).join(table, ["main", "bucket"]).select("unit", "split")
    if placed:
        units = units.unionByName(names)
    return salted_join(rows, units, "unit", F.xxhash64("example_id")).select("example_id", "group_key", "split")
