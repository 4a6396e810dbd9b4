"""Purged cross-validation splits as tables (fold, bar, role)."""

from __future__ import annotations

from itertools import combinations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelflow.functions.prefix import ordinals


def _check(n: int, groups: int, horizon: int) -> None:
    if groups < 2 or horizon < 1 or groups > n:
        raise ValueError("at least two groups, a horizon of at least one, and no more groups than bars")


def _bounds(n: int, groups: int) -> list[tuple[int, int]]:
    """Contiguous groups with evenly spaced, truncated bounds."""
    edges = [int(n * i / groups) for i in range(groups)] + [n]
    return list(zip(edges, edges[1:], strict=False))


def _splits(spark: SparkSession, n: int, tests: list[list[tuple[int, int]]], horizon: int, embargo: int) -> DataFrame:
    parts = spark.createDataFrame([(fold, a, b, a - horizon, b + horizon + embargo) for fold, spans in enumerate(tests) for a, b in spans], "fold int, a long, b long, pa long, pb long")
    folds = spark.createDataFrame([(fold,) for fold in range(len(tests))], "fold int")
    bars = folds.crossJoin(F.broadcast(spark.range(n).withColumnRenamed("id", "bar")))
    test = bars.join(F.broadcast(parts), "fold").where("bar >= a and bar < b").select("fold", "bar", F.lit("test").alias("role"))
    near = parts.select(F.col("fold").alias("f"), "pa", "pb")
    train = bars.join(F.broadcast(near), (F.col("fold") == F.col("f")) & (F.col("bar") >= F.col("pa")) & (F.col("bar") < F.col("pb")), "left_anti")
    return test.union(train.select("fold", "bar", F.lit("train").alias("role")))


def purged_folds(spark: SparkSession, n: int, groups: int = 5, horizon: int = 1, embargo: int = 0) -> DataFrame:
    """Each group is tested once; bars within horizon of it, and the embargo behind it, aren't trained on."""
    _check(n, groups, horizon)
    return _splits(spark, n, [[span] for span in _bounds(n, groups)], horizon, embargo)


def combinatorial_folds(spark: SparkSession, n: int, groups: int = 6, tested: int = 2, horizon: int = 1, embargo: int = 0) -> DataFrame:
    """Every choice of `tested` groups is a fold, purged around each of them."""
    _check(n, groups, horizon)
    if not 0 < tested < groups:
        raise ValueError("some groups, but not all, can be tested")
    return _splits(spark, n, [list(spans) for spans in combinations(_bounds(n, groups), tested)], horizon, embargo)


class FoldRoles:
    """Table function: each bar's role in each fold, row by row, so that bars may lie in any number of tasks.

    Its table has (bar, pos, n): the bar's place and the number of bars. A fold tests `tested` of the
    groups of places; places within horizon of them, and the embargo behind them, have no role.
    """

    def eval(self, row: Row, groups: int, tested: int, horizon: int, embargo: int) -> Iterator[tuple]:
        n, pos = row["n"], row["pos"]
        for fold, spans in enumerate(combinations(_bounds(n, groups), tested)):
            if any(a <= pos < b for a, b in spans):
                yield fold, row["bar"], "test"
            elif not any(a - horizon <= pos < b + horizon + embargo for a, b in spans):
                yield fold, row["bar"], "train"


def register(spark: SparkSession) -> None:
    """Makes FoldRoles known to SQL: SELECT * FROM fold_roles(TABLE(bars), 5, 1, 2, 3)."""
    spark.udtf.register("fold_roles", F.udtf(FoldRoles, returnType="fold int, bar long, role string"))


def fold_roles(panel: DataFrame, groups: int = 5, tested: int = 1, horizon: int = 1, embargo: int = 0) -> DataFrame:
    """(fold, bar, role) of a panel's own bars; tested 1: purged folds, more: every choice of that many groups."""
    spark = panel.sparkSession
    bars = ordinals(panel.select("bar").distinct(), "bar", name="pos")
    n = bars.count()
    _check(n, groups, horizon)
    if not 0 < tested < groups:
        raise ValueError("some groups, but not all, can be tested")
    register(spark)
    return spark.sql(f"SELECT * FROM fold_roles(TABLE(SELECT bar, pos, {n}L AS n FROM {{bars}}), {groups}, {tested}, {horizon}, {embargo})", bars=bars)
