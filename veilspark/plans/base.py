"""What the query modules share: the registry of queries and of the same in SQL, and the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, over at least as many partitions as there are cores: small files else keep all work in one
    task. To be asked of scans only, whose partitions are known without a job."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def rows_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(column).alias("s")).select(*keys, F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.value").alias("value"))


def matches_sql(pattern: str, text: str = "text", key: str = "doc_id", source: str = "documents") -> str:
    """Places of a pattern's matches, from the matches and the pieces between them."""
    p = pattern.replace("'", "''")
    return f"""
    WITH m AS (SELECT {key}, regexp_extract_all({text}, '{p}') v, regexp_split_to_array({text}, '{p}') g FROM {source} WHERE {text} IS NOT NULL),
         u AS (SELECT {key}, v, g, unnest(range(1, len(v) + 1)) k FROM m)
    SELECT {key}, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:k-1], lambda x: length(x))), 0) AS INT) AS start_pos,
           CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(v[1:k], lambda x: length(x))) AS INT) AS end_pos, v[k] AS value FROM u"""
