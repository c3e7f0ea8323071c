"""Problem 7: fill fixed-capacity containers by best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Items that one packing task takes. A shard leaves at most a few containers part-empty, so the loss falls with its size.
SHARD_ITEMS = 20_000


class Remaining:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the open containers with exactly that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open: dict[int, list[int]] = {}
        self.filled = bytearray(2 * self.size)

    def add(self, left: int, container: int) -> None:
        self.open.setdefault(left, []).append(container)
        node = left + self.size
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (left, container) with the least left that still holds need; None if nothing does."""
        filled, node = self.filled, need + self.size
        if not filled[node]:
            while node > 1 and not (node & 1 == 0 and filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        left = node - self.size
        containers = self.open[left]
        container = containers.pop()
        if not containers:
            node = left + self.size
            filled[node] = 0
            node >>= 1
            while node and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
                node >>= 1
        return left, container


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; the items come in decreasing size and none exceeds the capacity."""
    tree, out, used = Remaining(capacity), [], 0
    for size in sizes:
        got = tree.take(size)
        if got is None:
            left, container = capacity, used
            used += 1
        else:
            left, container = got
        out.append(container)
        tree.add(left - size, container)
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(id, piece_no, start_token, piece_tokens, container): every item in containers of the capacity.

    An item within the capacity is one piece. A larger one is cut into full pieces, each alone in a container, and a
    rest that is packed like any item. Null sizes count as 0; items of size 0 take a place in a container, too. Repeated
    ids are separate items. Other columns of the input are left out. Packing runs in shards of bounded item number, by
    hash of id and size, so a source of any weight spreads evenly.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = items.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    sized = cut(sized)  # sizes are costly and read by the count, the rests and the full pieces
    total = sized.count()
    shards = max(1, -(-total // shard_items))
    whole = F.when(F.col("_size") > capacity, F.expr(f"cast((_size - 1) div {capacity} as int)")).otherwise(F.lit(0))
    pieces = sized.withColumn("_whole", whole)
    rest = pieces.select("_id", F.col("_whole").alias("piece_no"), (F.col("_whole").cast("bigint") * capacity).alias("start_token"), (F.col("_size") - F.col("_whole").cast("bigint") * capacity).alias("piece_tokens"))
    full = pieces.where("_whole > 0").select("_id", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("piece_no")).select(
        "_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("piece_tokens"), F.concat(F.lit("full-"), F.col("_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container")
    )
    id_type = dict(sized.dtypes)["_id"]

    def shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["piece_tokens", "_id"], ascending=[False, True], kind="stable", na_position="last")
        part["container"] = [f"{key[0]}-{c}" for c in best_fit(part["piece_tokens"].tolist(), capacity)]
        return part[["_id", "piece_no", "start_token", "piece_tokens", "container"]]

    packed = rest.withColumn("_shard", F.pmod(F.xxhash64("_id", "piece_tokens"), F.lit(shards))).groupBy("_shard").applyInPandas(
        shard, f"_id {id_type}, piece_no int, start_token bigint, piece_tokens bigint, container string"
    )
    return packed.unionByName(full).withColumnRenamed("_id", id_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, their tokens, and the share of the room that is used (null when there are no containers)."""
    per = packed.groupBy("container").agg(F.sum("piece_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), (F.sum("used") / (F.count("*") * F.lit(capacity))).alias("fill"), F.max("used").alias("fullest"))
