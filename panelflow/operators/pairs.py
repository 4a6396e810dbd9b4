"""Relations of ordered pairs of series: lagged correlation, regression, hit rates, strength.

A pair's rows meet in an equi-join on the bar (leader's bar + lag = follower's bar). Each series
has few bars, so the work spreads over the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import pearson, slope


def lagged(returns: DataFrame, lags: list[int], pairs: DataFrame | None = None, same: bool = False) -> DataFrame:
    """(source, target, lag, bar, l, f): the source's return and the target's `lag` bars later, at the target's bar.

    pairs: (source, target) to restrict to. Negative lags look the other way.
    """
    left = returns.select(F.col("series").alias("source"), F.col("bar").alias("b"), F.col("ret").alias("l")).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    left = left.withColumn("bar", F.col("b") + F.col("lag")).drop("b")
    right = returns.select(F.col("series").alias("target"), "bar", F.col("ret").alias("f"))
    out = left.join(right, "bar")
    out = out if same else out.where("source <> target")
    return out.join(pairs, ["source", "target"], "left_semi") if pairs is not None else out


def lagged_correlation(returns: DataFrame, lags: list[int], least: int = 20) -> DataFrame:
    """(source, target, lag, n, corr): 0 where a pair has `least` common rows or fewer, or no spread."""
    grouped = lagged(returns, lags).groupBy("source", "target", "lag").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("l"), F.col("f")).alias("c"))
    return grouped.select("source", "target", "lag", "n", F.when(F.col("n") > least, F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("corr"))


def tail_correlation(returns: DataFrame, least: int = 50) -> DataFrame:
    """(source, target, n, corr): returns that stand at neighbouring places from the end, whatever their bars.

    Each series loses its missing returns by itself; the source's place j + 1 from its end meets the
    target's place j. 0 where `least` places or fewer are common, or there's no spread.
    """
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("bar"))) - 1
    rows = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret")).withColumn("k", place)
    left = rows.select(F.col("series").alias("source"), (F.col("k") - 1).alias("k"), F.col("ret").alias("l"))
    right = rows.select(F.col("series").alias("target"), "k", F.col("ret").alias("f"))
    grouped = left.join(right, "k").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("l"), F.col("f")).alias("c"))
    return grouped.select("source", "target", "n", F.when(F.col("n") > least, F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("corr"))


def regression(returns: DataFrame, lag: int = 1, least: int = 30) -> DataFrame:
    """(source, target, n, beta) of target on lagged source; null below `least` rows."""
    grouped = lagged(returns, [lag]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), slope(F.col("l"), F.col("f")).alias("b"))
    return grouped.select("source", "target", "n", F.when(F.col("n") >= least, F.col("b")).alias("beta"))


def regime_regression(returns: DataFrame, regimes: DataFrame, lag: int = 1, least: int = 30) -> DataFrame:
    """(regime, source, target, n, beta): regression() on the targets' bars of each regime (bar, regime)."""
    rows = lagged(returns, [lag]).join(regimes.select("bar", "regime"), "bar")
    grouped = rows.groupBy("regime", "source", "target").agg(F.count(F.lit(1)).alias("n"), slope(F.col("l"), F.col("f")).alias("b"))
    return grouped.select("regime", "source", "target", "n", F.when(F.col("n") >= least, F.col("b")).alias("beta"))


def recent_sigma(returns: DataFrame, rows: int = 252) -> DataFrame:
    """(series, sigma): standard deviation of each series' last rows."""
    last = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("bar")))
    return returns.withColumn("__k", last).where(F.col("__k") <= rows).groupBy("series").agg(F.stddev_samp("ret").alias("sigma"))


def scaled_beta(returns: DataFrame, lag: int = 1, rows: int = 252) -> DataFrame:
    """(source, target, corr, beta): lagged correlation times the ratio of recent standard deviations."""
    sigma = recent_sigma(returns, rows)
    out = lagged_correlation(returns, [lag]).join(sigma.select(F.col("series").alias("source"), F.col("sigma").alias("ss")), "source")
    out = out.join(sigma.select(F.col("series").alias("target"), F.col("sigma").alias("st")), "target")
    return out.select("source", "target", "corr", F.when(F.col("ss") > 0, F.col("corr") * F.col("st") / F.col("ss")).alias("beta"))


def hit_rate(returns: DataFrame, lag: int = 1, rows: int = 252, min_signals: int = 30, min_moves: int = 20) -> DataFrame:
    """(source, target, hits, n, rate): how often the source's sign, times the correlation's, was the target's.

    Over the pair's last `rows` rows; sources that hardly move and targets that don't aren't counted.
    """
    rows_ = lagged(returns, [lag])
    sign = rows_.groupBy("source", "target").agg(F.signum(F.coalesce(pearson(F.col("l"), F.col("f")), F.lit(0.0))).alias("s"))
    last = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("bar")))
    late = rows_.withColumn("k", last).where(F.col("k") <= rows).join(sign, ["source", "target"])
    moved = (F.abs("l") > 1e-8) & (F.col("f") != 0)
    grouped = late.groupBy("source", "target").agg(F.count_if(F.abs("l") > 1e-8).alias("signals"), F.count_if(moved).alias("n"), F.count_if(moved & (F.signum(F.col("l") * F.col("s")) == F.signum("f"))).alias("hits"))
    return grouped.select("source", "target", "hits", "n", F.when((F.col("signals") >= min_signals) & (F.col("n") >= min_moves), F.col("hits") / F.col("n")).alias("rate"))


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """(a, b, corr, cov) of every two series on their common bars, both orders and the diagonal."""
    rows = lagged(returns, [0], same=True)
    return rows.groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(pearson(F.col("l"), F.col("f")).alias("corr"), F.covar_samp("l", "f").alias("cov"))


def top_edges(edges: DataFrame, n: int, weight: str = "te") -> DataFrame:
    """The n heaviest edges; ties by source, then target. n = 0: all."""
    ordered = edges.orderBy(F.desc(weight), "source", "target")
    return ordered.limit(n) if n else ordered


def top_per(edges: DataFrame, group: str, n: int, weight: str = "te", tie: str = "source") -> DataFrame:
    """The n heaviest edges of each group, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(weight), tie)
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def strength(edges: DataFrame, weight: str = "te") -> DataFrame:
    """(series, strength): the sum of the weights of all its edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("series"), F.col(weight).alias("w"))
    return ends.groupBy("series").agg(F.sum("w").alias("strength"))


def degrees(edges: DataFrame) -> DataFrame:
    """(series, out_degree, in_degree, degree, size): size is what a drawn node takes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("series"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("series"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    out = ends.groupBy("series").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree")).withColumn("size", 12 + 2 * F.col("degree"))


def network(edges: DataFrame, threshold: float = 0.05, n: int = 40, weight: str = "te") -> DataFrame:
    """Edges at or above the threshold, the n heaviest; isolated nodes have no edge and so are gone."""
    return top_edges(edges.where((F.col(weight) >= threshold) & (F.col("source") != F.col("target"))), n, weight)


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (series) without an edge."""
    used = edges.select(F.explode(F.array("source", "target")).alias("series"))
    return nodes.select("series").distinct().join(used, "series", "left_anti")


def hubs(edges: DataFrame) -> DataFrame:
    """(source_hub, sink_hub): the nodes of most outgoing and most incoming edges, the first by name."""
    d = degrees(edges)
    return d.agg(F.min_by("series", F.struct(-F.col("out_degree"), F.col("series"))).alias("source_hub"), F.min_by("series", F.struct(-F.col("in_degree"), F.col("series"))).alias("sink_hub"))


def wide(edges: DataFrame, weight: str = "te", names: list[str] | None = None) -> DataFrame:
    """The square matrix: a row for each source, a column for each target, 0 where there's no edge.

    names: the columns; if none are given, those of the edges, which a table to look at holds few of.
    """
    if names is None:
        names = [r[0] for r in edges.select("target").distinct().orderBy("target").limit(10_001).collect()]
        if len(names) > 10_000:
            raise ValueError("too many columns for a matrix: name those to show")
    return edges.groupBy("source").pivot("target", names).agg(F.first(weight)).na.fill(0.0)


def tidy(matrix: DataFrame, weight: str = "te") -> DataFrame:
    """(source, target, weight) of a square matrix, off its diagonal."""
    columns = [c for c in matrix.columns if c != "source"]
    return matrix.unpivot("source", columns, "target", weight).where("source <> target")
