"""Synthetic labelled texts: templates filled with values drawn by hash, so that a row's id alone decides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import GENERATORS
from ..functions.text import zone
from .synthesis import PLAIN

SLOT = r"\{[~@]?[A-Za-z0-9_]+\}"


def slots(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(SLOT), F.lit(0))


def draw(pool: Column, *key: Column) -> Column:
    """One of the pool's values by hash of the key; null from an empty pool."""
    return F.when(F.size(pool) > 0, F.element_at(pool, (F.pmod(F.xxhash64(*key), F.size(pool)) + 1).cast("int")))


def value(slot: Column, pools: Column, *key: Column) -> Column:
    """A slot's value: from its pool, else from a generator of identifiers, else its name in lower case."""
    name = F.regexp_replace(slot, r"[{}~@]", "")
    made = F.lower(name)
    for tag, make in GENERATORS.items():
        made = F.when(name == tag, make(F.pmod(F.xxhash64(*key), F.lit(10**8)))).otherwise(made)
    return F.coalesce(draw(F.element_at(pools, name), *key), made)


def inject(rows: DataFrame, template_col: str, pools: Column, seed: int = 7) -> DataFrame:
    """The rows (with id) plus text and spans: slots filled from left to right, spans of {TAG} slots recorded, those of
    {~decoy} slots as decoys. Equal slots are drawn apart. A null template gives a null text."""
    template = F.col(template_col)
    pieces = rows.withColumn("_slots", slots(template)).withColumn("_gaps", F.split(template, SLOT, -1))
    drawn = pieces.withColumn("_values", F.transform("_slots", lambda s, i: value(s, pools, F.col("id"), i, F.lit(seed))))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<tag:string,start:int,end:int>>").alias("spans"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("decoys"))

    def step(acc: Column, x: Column) -> Column:
        at = F.length(acc["text"]) + F.length(x["g"])
        end = at + F.length(x["v"])
        name = F.regexp_replace(x["s"], r"[{}~@]", "")
        plain = x["s"].rlike(r"^\{[A-Z]")
        return F.struct(
            F.concat(acc["text"], x["g"], x["v"]).alias("text"),
            F.when(plain, F.concat(acc["spans"], F.array(F.struct(name.alias("tag"), at.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"),
            F.when(~plain, F.concat(acc["decoys"], F.array(F.struct(at.alias("start"), end.alias("end"), name.alias("kind"))))).otherwise(acc["decoys"]).alias("decoys"),
        )

    zipped = F.arrays_zip(F.slice("_gaps", F.lit(1), F.size("_slots")).alias("g"), F.col("_slots").alias("s"), F.col("_values").alias("v"))
    filled = drawn.withColumn("_f", F.aggregate(zipped, start, step))
    text = F.concat(F.col("_f.text"), F.element_at("_gaps", -1))
    return filled.withColumn("text", F.when(template.isNotNull(), text)).withColumn("spans", F.col("_f.spans")).withColumn("decoys", F.col("_f.decoys")).drop("_f", "_slots", "_gaps", "_values")


def _plain(word: Column) -> Column:
    for letter, form in PLAIN.items():
        word = F.replace(word, F.lit(letter), F.lit(form))
    return word


def noisy(word: Column, *key: Column) -> Column:
    """One typing error in words of four letters or more, never at the first: swap, drop, double, umlaut or upper case."""
    n = F.length(word)
    k = (F.pmod(F.xxhash64(*key, F.lit("at")), n - 2) + 2).cast("int")
    head, a, b, tail = F.substring(word, F.lit(1), k - 1), F.substring(word, k, F.lit(1)), F.substring(word, k + 1, F.lit(1)), F.substring(word, k + 2, n)
    kinds = [F.concat(head, b, a, tail), F.concat(head, b, tail), F.concat(head, a, a, b, tail), _plain(word), F.upper(word)]
    return F.when(n < 4, word).otherwise(F.element_at(F.array(*kinds), (F.pmod(F.xxhash64(*key), F.lit(len(kinds))) + 1).cast("int")))


def held_out(names: DataFrame, column: str) -> DataFrame:
    """Values of the held-out zone."""
    return names.where(zone(F.col(column)) == 0)


def weighted(names: DataFrame, key: str, name_col: str, weight_col: str) -> DataFrame:
    """(key, name, upto): running sums of dampened weights, for draws by range; null and negative weights count as 1."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(name_col)
    damp = F.greatest(F.lit(1), F.floor(F.sqrt(F.greatest(F.coalesce(F.col(weight_col), F.lit(0)), F.lit(0)))).cast("int"))
    return names.where(F.col(name_col).isNotNull()).groupBy(key, name_col).agg(F.sum(damp).alias("_w")).withColumn("upto", F.sum("_w").over(w)).drop("_w")


def draw_weighted(rows: DataFrame, key: Column, ranges: DataFrame, group_col: str, name_col: str, into: str) -> DataFrame:
    """The rows with a name of their group (a column of both tables), drawn by weight from a hash of the key; ranges are those
    of weighted(). A group's names are one row of the list, so groups of a bounded size are asked for."""
    lists = ranges.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct("upto", name_col))).alias("_l"))
    place = F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.element_at("_l", -1)["upto"])
    drawn = rows.join(lists, group_col).withColumn("_p", place)
    return drawn.withColumn(into, F.element_at(F.filter("_l", lambda x: x["upto"] > F.col("_p")), 1)[name_col]).drop("_l", "_p")


def number_spellings(value: Column, sizes: tuple[int, ...]) -> Column:
    """map<string, string> of the ways an identifier is written: in one piece, and in groups of the given sizes with blanks,
    stops, hyphens and narrow blanks between them."""
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    parts, at = [], 1
    for n in sizes:
        parts.append(F.substring(bare, at, n))
        at += n
    shown = {"compact": bare} | {name: F.concat_ws(sep, *parts) for name, sep in (("blank", " "), ("stop", "."), ("hyphen", "-"), ("narrow", "\u202f"))}
    return F.create_map(*[x for k, v in shown.items() for x in (F.lit(k), v)])


def spellings(probe: Column, letters: str) -> Column:
    """Probes for character sets: the text with its second letter swapped for each of the given ones."""
    return F.transform(F.split(F.lit(letters), ""), lambda c: F.concat(F.substring(probe, 1, 1), c, F.substring(probe, F.lit(3), F.length(probe))))
