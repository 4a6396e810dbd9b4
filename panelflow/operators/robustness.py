"""How much of a result may be luck: overfitting, deflation, intervals, churn, regimes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import ANNUAL
from panelflow.functions.numeric import deflated_sharpe, expected_max_sharpe
from panelflow.functions.prefix import ordinals, previous, running


def overfitting_splits(trials: DataFrame, min_bars: int = 60) -> DataFrame:
    """(split, winner, rank, trials, logit): of every half of the blocks, the in-sample winner's rank out of sample.

    trials (trial, bar, ret), bars 0 to T - 1; split: the bits of the blocks in sample. Blocks of
    about 30 bars on each side: an even number from 4 to 16. A trial is brought to its blocks'
    counts, sums and squares, so the splits meet one short row for each trial. No rows with fewer
    than min_bars bars or two trials.
    """
    c = F.col
    size = trials.agg((F.max("bar") + 1).alias("t"), F.count_distinct("trial").alias("m")).where((c("t") >= min_bars) & (c("m") >= 2))
    size = size.select("t", F.greatest(F.lit(4), F.least(F.lit(16), F.floor(2 * F.floor(c("t") / 30) / 2) * 2)).cast("int").alias("s"))
    block = F.least(F.floor(c("bar") * c("s") / c("t")).cast("int"), c("s") - 1)
    sums = trials.crossJoin(F.broadcast(size)).groupBy(c("trial").cast("string").alias("trial"), block.alias("block"), "s").agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.sum("ret").alias("s1"), F.sum(c("ret") * c("ret")).alias("s2")).alias("v"))
    rows = sums.groupBy("trial", "s").agg(F.collect_list(F.struct("block", "v")).alias("blocks"))
    # the halves of s blocks: 70 masks of 8 bits to 12,870 of 16, made beside each trial's row
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2), c("s")).cast("int") - 1), lambda i: F.bit_count(i) == c("s") / 2)
    rows = rows.select("trial", "s", "blocks", F.explode(masks).alias("split"))

    def total(inside: bool, name: str):
        mine = F.filter("blocks", lambda b: (F.getbit(c("split"), b["block"]) == 1) == F.lit(inside))
        return F.aggregate(mine, F.lit(0.0), lambda a, b: a + b["v"][name])

    rows = rows.select("split", "trial", *[total(inside, name).alias(f"{name}_{'in' if inside else 'out'}") for inside in (True, False) for name in ("n", "s1", "s2")])

    def sharpe(side: str):
        n, s1, s2 = (c(f"{name}_{side}") for name in ("n", "s1", "s2"))
        variance = (s2 - s1 * s1 / n) / (n - 1)
        return F.when(variance > 1e-24, s1 / n / F.sqrt(variance)).otherwise(0.0)

    rows = rows.select("split", F.struct("trial", sharpe("in").alias("a"), sharpe("out").alias("b")).alias("x"))
    rows = rows.groupBy("split").agg(F.min_by("x", F.struct(-c("x.a"), c("x.trial"))).alias("w"), F.collect_list("x.b").alias("bs"))
    ranked = rows.select("split", c("w.trial").alias("winner"), (1 + F.size(F.filter("bs", lambda b: b > c("w.b")))).alias("rank"), F.size("bs").alias("trials"))
    share = c("rank") / (c("trials") + 1)
    return ranked.withColumn("logit", F.log(share / (1 - share)))


def overfitting_probability(trials: DataFrame) -> DataFrame:
    """(pbo, splits): the share of splits whose winner ends in the worse half; null with too few bars or trials."""
    return overfitting_splits(trials).agg(F.avg(F.when(F.col("logit") > 0, 1.0).otherwise(0.0)).alias("pbo"), F.count(F.lit(1)).alias("splits"))


def moments(pnl: DataFrame, value: str = "net", keys: tuple[str, ...] = ()) -> DataFrame:
    """(n, sharpe, skew, kurtosis) of each key: per-bar Sharpe ratio, population moments, kurtosis 3 of a normal."""
    every = Window.partitionBy(*(keys or (F.lit(1),)))
    r = F.col(value)
    rows = pnl.withColumn("d", r - F.avg(r).over(every))
    out = rows.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.avg(F.pow("d", F.lit(2))).alias("m2"), F.avg(F.pow("d", F.lit(3))).alias("m3"), F.avg(F.pow("d", F.lit(4))).alias("m4"))
    sharpe = F.when(F.col("s") > 1e-10, F.col("m") / F.col("s")).otherwise(0.0)
    return out.select(*keys, "n", sharpe.alias("sharpe"), (F.col("m3") / (F.pow("m2", F.lit(1.5)) + 1e-12)).alias("skew"), (F.col("m4") / (F.pow("m2", F.lit(2)) + 1e-12)).alias("kurtosis"))


def deflated(stats: DataFrame, trials: int, trial_std: float = 1.0) -> DataFrame:
    """moments() with (deflated, p_value, benchmark, passes)."""

    def run(batches):
        for pdf in batches:
            found = [deflated_sharpe(r.sharpe, trials, int(r.n), r.skew, r.kurtosis, trial_std) for r in pdf.itertuples(index=False)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=["deflated", "p_value", "benchmark", "passes"])], axis=1)

    return stats.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", deflated double, p_value double, benchmark double, passes boolean")


def block_size(bars: int) -> int:
    """Bars of a block of the bootstrap: about the square root of all."""
    return max(5, round(bars**0.5))


def sharpe_interval(returns: np.ndarray, count: int = 1000, level: float = 0.95, seed: int = 0, name: str = "") -> tuple[float, float, float]:
    """(sharpe, low, high): annualised, by block bootstrap: what sharpe_intervals() spreads over tasks."""
    t = len(returns)
    if t < 30:
        return (float("nan"),) * 3
    size = block_size(t)
    blocks = np.asarray(returns, float)[: t // size * size].reshape(-1, size)
    n, sharpes = blocks.size, []
    for i in range(count):
        pick = [int(hashlib.md5(f"{seed}:{name}:{i}:{j}".encode()).hexdigest()[:12], 16) % len(blocks) for j in range(len(blocks))]
        a, b = blocks[pick].sum(), (blocks[pick] ** 2).sum()
        sd = np.sqrt(max((b - a * a / n) / (n - 1), 0.0))
        sharpes.append(a / n / sd * ANNUAL**0.5 if sd > 1e-12 else 0.0)
    spread = np.std(returns, ddof=1)
    own = np.mean(returns) / spread * ANNUAL**0.5 if spread > 1e-12 else 0.0
    return float(own), float(np.quantile(sharpes, (1 - level) / 2)), float(np.quantile(sharpes, (1 + level) / 2))


def expected_best(trials: DataFrame, column: str = "trials") -> DataFrame:
    """trials with `expected`: the largest Sharpe ratio, in standard errors, that so many trials without skill would show."""

    @F.pandas_udf("double")
    def expected(n: pd.Series) -> pd.Series:
        return n.map(expected_max_sharpe)

    return trials.withColumn("expected", expected(column))


def sharpe_intervals(pnl: DataFrame, key: str = "strategy", value: str = "net", count: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(key, sharpe, low, high) of each strategy, annualised; nulls for fewer than 30 bars.

    Blocks of neighbouring bars are drawn with replacement, as many as there are. A block is known by its
    sums, so a draw is a join of its numbers with them; the numbers come from a hash of strategy,
    draw and place, and draws are rows, wherever they are computed.
    """
    rows = ordinals(pnl.select(key, "bar", F.coalesce(value, F.lit(0.0)).alias("x")), "bar", (key,), "pos")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("t"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("spread"))
    sizes = sizes.withColumn("size", F.greatest(F.lit(5), F.bround(F.sqrt("t")).cast("int"))).withColumn("blocks", F.floor(F.col("t") / F.col("size")))
    sums = rows.join(sizes.select(key, "size", "blocks"), key).withColumn("block", F.floor(F.col("pos") / F.col("size"))).where("block < blocks")
    sums = sums.groupBy(key, "block").agg(F.sum("x").alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"))
    drawn = sizes.where("t >= 30").select(key, "size", "blocks", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    drawn = drawn.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("draw").cast("string"), F.col("place").cast("string"))
    drawn = drawn.withColumn("block", F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.col("blocks"))
    one = drawn.join(sums, [key, "block"]).groupBy(key, "draw").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), (F.first("size") * F.first("blocks")).alias("n"))
    sd = F.sqrt(F.greatest((F.col("b") - F.col("a") * F.col("a") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    annual = F.sqrt(F.lit(float(ANNUAL)))
    sharpe = F.when(sd > 1e-12, F.col("a") / F.col("n") / F.nullif(sd, F.lit(0.0)) * annual).otherwise(0.0)
    ends = [F.percentile(sharpe, F.lit(q)).alias(n) for n, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))]
    own = F.when(F.col("t") < 30, None).when(F.col("spread") > 1e-12, F.col("mean") / F.col("spread") * annual).otherwise(0.0)
    return sizes.select(key, own.alias("sharpe")).join(one.groupBy(key).agg(*ends), key, "left")


def by_regime(pnl: DataFrame, regimes: DataFrame, value: str = "net") -> DataFrame:
    """(regime, n, mean, sharpe): annualised, of the bars in each regime."""
    rows = pnl.join(regimes.select("bar", "regime"), "bar").groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    return rows.select("regime", "n", "mean", F.when(F.col("s") > 1e-10, F.col("mean") / F.col("s") * F.sqrt(F.lit(float(ANNUAL)))).otherwise(0.0).alias("sharpe"))


def churn(edges: DataFrame, refresh: int) -> DataFrame:
    """(refresh_bar, active, new): pairs of each refresh, and those that the refresh before didn't have."""
    before = edges.select((F.col("refresh_bar") + refresh).alias("refresh_bar"), "source", "target", F.lit(1).alias("had"))
    rows = edges.join(before, ["refresh_bar", "source", "target"], "left")
    return rows.groupBy("refresh_bar").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("had").isNull()).alias("new"))


def regime_summary(features: DataFrame, regimes: DataFrame) -> DataFrame:
    """(regime, mean, std, n, pct): over all features' values together; n counts bars."""
    rows = features.join(regimes.select("bar", "regime"), "bar")
    out = rows.groupBy("regime").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count_distinct("bar").alias("n"))
    return out.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def stress_blocks(probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(start, end, bars) of the runs of bars whose probability (bar, p) is over the threshold."""
    rows = probabilities.withColumn("on", (F.col("p") > threshold).cast("int"))
    rows = previous(rows, "bar", {"before": "on"})
    changed = F.when(F.col("on") != F.coalesce("before", F.lit(-1)), 1).otherwise(0)
    rows = running(rows, "bar", sums={"island": changed})
    return rows.where("on = 1").groupBy("island").agg(F.min("bar").alias("start"), F.max("bar").alias("end"), F.count(F.lit(1)).alias("bars")).drop("island")


def cumulative(returns: DataFrame) -> DataFrame:
    """(series, bar, total): running sums of returns."""
    return running(returns.select("series", "bar", "ret"), "bar", ("series",), {"total": F.col("ret")}).drop("ret")
