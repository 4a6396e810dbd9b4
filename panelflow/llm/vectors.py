"""What the vector searches share: usable rows, shards and blocks of queries, and merging.

Rows are dealt to shards by a hash of their row number and queries to blocks, both of a bounded
number of rows on average, whatever the table's size. Each (shard, block) pair is a group of its
own, so no task holds more than a shard's index rows and a block.

Shards are searched in phases, each some times as many as all before: a query's kth score so far
goes along, and groups return only rows that reach it. So a phase returns about as many rows for
each query as a shard would return to the first, and not k for each of its shards.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import written

#: Queries of a block at most, and at least (where there are fewer tasks than cores).
BLOCK_ROWS, LEAST_ROWS = 4096, 64
FOUND = "q long, query_id long, row long, vec_id long, score "


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool, null_ids: bool = False) -> DataFrame:
    """(id, x, dim) of the rows whose vector isn't null and holds no null or non-finite component.

    zero: vectors of zeros only are usable. null_ids: so are rows without an id. Vectors of another length
    than most would have no inner product; each length is searched by itself. Components of type
    float stay so (they are exact in double precision, in half the room).
    """
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    x = F.col(vec_col).cast("array<float>" if single else "array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    if not zero:
        fine = fine & F.exists(x, lambda v: v != 0)
    there = F.col(vec_col).isNotNull() & (F.lit(null_ids) | F.col(id_col).isNotNull())
    return df.where(there).where(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(x).alias("dim"))


def numbered(vectors: DataFrame, folder: str) -> DataFrame:
    """The vectors, written, with a number for each row (ids may repeat)."""
    return written(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "x", "dim"), folder, "vectors")


def thinned(vectors: DataFrame, k: int) -> DataFrame:
    """The candidates: of equal vectors the k + 1 smallest ids only, and of each of these k rows.

    A query leaves out all rows of its own id, so k rows of the k smallest other ids are enough, and
    nothing is lost. The rows of one id and vector are counted first: Spark applies that limit before
    it shuffles, as it does the one on ids, so a vector that very many rows share is no burden.
    """
    same = Window.partitionBy("x", "id").orderBy("row")
    few = vectors.withColumn("__copy", F.row_number().over(same)).where(F.col("__copy") <= k)
    ids = Window.partitionBy("x").orderBy("id")
    return few.withColumn("__id", F.dense_rank().over(ids)).where(F.col("__id") <= k + 1).drop("__copy", "__id")


def shard_of(n: int):
    return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("shard")


def searched(shards: DataFrame, queries: DataFrame, first: int, count: int, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, n_queries: int) -> DataFrame:
    """search(shard, queries) of each of `count` shards from the first on with every block of queries."""
    wanted = -(-2 * shards.sparkSession.sparkContext.defaultParallelism // count)
    n_blocks = max(1, -(-n_queries // BLOCK_ROWS), min(-(-n_queries // LEAST_ROWS), wanted))
    left = shards.where((F.col("shard") >= first) & (F.col("shard") < first + count)).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block")
    right = queries.select("*", block, F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("shard"))
    key = ["shard", "block", "dim"]
    return left.groupBy(*key).cogroup(right.toDF(*right.columns).groupBy(*key)).applyInPandas(search, schema)


def in_phases(shards: DataFrame, queries: DataFrame, n_shards: int, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], score: str, k: int, folder: str, growth: int = 8) -> DataFrame:
    """ranked() rows of all shards. search(shard, queries) gets (row, id, x, dim, floor) of the queries, floor
    being the kth score so far (null: none yet), and gives rows of FOUND no worse than it.
    """
    n_queries = queries.count()
    found, first, count = None, 0, 1
    while first < n_shards:
        count = min(count, n_shards - first)
        asked = queries.withColumn("floor", F.lit(None).cast("double"))
        if found is not None:
            floor = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
            asked = queries.join(floor, queries["row"] == floor["q"], "left").select("row", "id", "x", "dim", "floor")
        new = searched(shards, asked, first, count, search, FOUND + score, n_queries)
        found = written(ranked(new if found is None else found.drop("rank").union(new), k), folder, f"found{first}")
        first += count
        count = first * (growth - 1)
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The rows of FOUND that are among each query's k best, ties to the smaller vec_id, with their rank."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def no_rows(score: str) -> pd.DataFrame:
    return pd.DataFrame({"q": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64").astype({"score": score})
