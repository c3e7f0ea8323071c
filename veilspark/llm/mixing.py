"""Problem 8: mix sources to target shares of the total tokens, by Sainte-Laguë apportionment of equal token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Blocks that the total is divided into, rows that one shard of a source holds at most on average, and shards of one.
BLOCKS, SHARD_ROWS, MOST_SHARDS = 20_000, 100_000, 4_096
#: Target sources at most; their names and numbers go to the driver and to every task.
MOST_SOURCES = 100_000


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotient weight / (2 seats + 1); a party at its cap takes no more and its next seats stay empty."""
    out = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-weights[i] / (2 * out[i] + 1), i))
    return [min(n, c) for n, c in zip(out, caps)] if caps is not None else out


def mix(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, size: str | Column, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection: id, source, size, repeats; report: one row per target source).

    The total (default: the tokens of all documents of target sources) is cut into equal blocks, and the sources get
    blocks by Sainte-Laguë. A source that cannot fill its blocks with max_repeats of each document gives all of them and
    is reported with reachable = false; its missing share is not handed to others, so the rest keep their target tokens.
    Within a source every document is repeated as often as the quota holds all of them; what is left is apportioned to
    hash shards by the same rule and filled there in seeded order. Documents with a null source, a source without a
    target, or size 0 are never drawn. A source named twice in targets counts by its summed share and least repeats;
    null shares and repeats count as 0. The size is a column or an expression, which is only asked for in target sources.

    The driver holds one number for each target source (MOST_SOURCES at most); shards stay in tables.
    """
    spark = docs.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("_source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("_most"))
    goals = wanted.orderBy("_source").limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    names = F.broadcast(spark.createDataFrame([(r["_source"],) for r in goals], "_source string"))
    slot = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(MOST_SHARDS)).cast("int")
    own = docs.withColumn("_source", F.col(source_col)).join(names, "_source", "left_semi")
    costs = F.col(size) if isinstance(size, str) else size
    # Sizes are costly and read by the sums and by the draw.
    sized = cut(own.select(F.col(id_col).alias("_id"), "_source", costs.cast("bigint").alias("_size"))).where("_size > 0")
    sums = cut(sized.groupBy("_source", slot.alias("_slot")).agg(F.count("*").alias("n"), F.sum("_size").alias("tokens")))
    found = {r["_source"]: (r["n"], r["tokens"]) for r in sums.groupBy("_source").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    everything = sum(tokens for _, tokens in found.values())
    total = everything if total is None else total
    block = max(1, total // BLOCKS)
    seats = sainte_lague([r["_share"] for r in goals], total // block if total else 0)
    report, plan = [], []
    for r, n in zip(goals, seats):
        s, share, most = r["_source"], float(r["_share"]), int(r["_most"])
        rows, have = found.get(s, (0, 0))
        quota = n * block
        # A source falls short if it is given the blocks that it can fill, or more; whether the last block is a whole one
        # is then settled by the tokens themselves.
        short = n + 1 >= have * most // block and have * most < share * total
        give = min(quota, have * most)
        whole = min(most, give // have) if have else 0
        shards = 1
        while shards < MOST_SHARDS and shards * SHARD_ROWS < rows:
            shards *= 2
        plan.append((s, shards, int(whole), int(give - whole * have) if whole < most else 0, max(1, block // 16)))
        report.append((s, share, most, int(have), int(quota), not short))
    plans = F.broadcast(spark.createDataFrame(plan, "_source string, _shards int, _whole int, _rest bigint, _unit bigint"))  # one row a source

    def shares_of(part: pd.DataFrame) -> pd.DataFrame:
        seats = sainte_lague(part["tokens"].tolist(), int(part["_rest"].iloc[0] // part["_unit"].iloc[0]))
        return part[["_source", "_shard", "_whole"]].assign(_left=[int(n * part["_unit"].iloc[0]) for n in seats])

    shard = F.pmod(F.col("_slot"), F.col("_shards")).cast("int")
    # A source has MOST_SHARDS shards at most, so a task of this holds that many rows.
    inside = sums.join(plans, "_source").groupBy("_source", shard.alias("_shard"), "_whole", "_rest", "_unit").agg(F.sum("tokens").alias("tokens"))
    quotas = inside.groupBy("_source").applyInPandas(shares_of, "_source string, _shard int, _whole int, _left bigint")
    placed = sized.join(plans.select("_source", "_shards"), "_source").withColumn("_slot", slot).withColumn("_shard", shard)
    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64("_id", F.lit(seed + 1)), "_id")
    # A document is drawn while the running middle of its tokens lies within the quota: the error is half a document.
    before = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = placed.withColumn("_before", F.coalesce(before, F.lit(0))).join(quotas, ["_source", "_shard"])
    chosen = chosen.withColumn("repeats", F.col("_whole") + (F.col("_before") + F.col("_size") / 2 <= F.col("_left")).cast("int"))
    selection = chosen.where("repeats > 0").select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("tokens"), "repeats")
    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("drawn_docs"), F.max("repeats").alias("most_repeats"))
    base = spark.createDataFrame(report, "source string, target_share double, max_repeats int, source_tokens bigint, quota_tokens bigint, reachable boolean")
    filled = base.join(reached, "source", "left").na.fill(0, ["drawn_tokens", "drawn_docs", "most_repeats"])
    everywhere = Window.partitionBy(F.lit(1))  # one row a source
    shares = filled.withColumn("actual_share", F.try_divide(F.col("drawn_tokens").cast("double"), F.sum("drawn_tokens").over(everywhere))).withColumn("share_of_total", F.lit(1.0 / total if total else 0.0) * F.col("drawn_tokens"))
    return selection, shares
