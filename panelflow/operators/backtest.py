"""Walk-forward evaluation without a loop over time: weights join their out-of-sample bars by a computed key."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import ANNUAL, by, clip, compounded, ratio
from panelflow.functions.prefix import rolled, running


def rebalances(returns: DataFrame, init: int = 252, step: int = 21) -> DataFrame:
    """(rebalance_bar) of init, init + step, … within the panel."""
    last = returns.agg(F.max("bar").alias("last")).where(F.col("last") >= init)
    return last.select(F.explode(F.sequence(F.lit(init).cast("long"), F.col("last"), F.lit(step).cast("long"))).alias("rebalance_bar"))


def book_bar(bar: Column, init: int, step: int, lag: int) -> Column:
    """The rebalance whose weights a bar earns on: those of the last one at least `lag` bars before."""
    return F.lit(init) + step * F.floor((bar - lag - init) / step)


def inverse_vol_weights(returns: DataFrame, init: int = 252, step: int = 21, rows: int = 252) -> DataFrame:
    """(rebalance_bar, series, weight): at each rebalance, from the bars strictly before it."""
    w = by("series").rowsBetween(-rows, -1)
    sigma = returns.withColumn("sigma", F.stddev_samp("ret").over(w)).join(rebalances(returns, init, step), F.col("bar") == F.col("rebalance_bar"))
    inverse = F.when(F.col("sigma") > 0, 1.0 / F.col("sigma"))
    every = Window.partitionBy("rebalance_bar")
    total = F.sum(inverse).over(every)
    return sigma.select("rebalance_bar", "series", F.when(total.isNull(), 1.0 / F.count(F.lit(1)).over(every)).otherwise(F.coalesce(inverse / total, F.lit(0.0))).alias("weight"))


def momentum_trials(returns: DataFrame, lookbacks: list[int], init: int = 252, step: int = 21) -> DataFrame:
    """(trial, rebalance_bar, series, weight): for each look-back, the sign of the mean of that many rows
    before, equal gross weights. All look-backs share one pass over the panel.
    """
    dates = rebalances(returns, init, step)
    signs = {f"m{k:02d}": F.signum(F.avg("ret").over(by("series").rowsBetween(-k, -1))) for k in lookbacks}
    rows = returns.select("series", "bar", *[c.alias(n) for n, c in signs.items()]).join(dates, F.col("bar") == F.col("rebalance_bar"))
    rows = rows.unpivot(["rebalance_bar", "series"], list(signs), "trial", "s")
    gross = F.sum(F.abs("s")).over(Window.partitionBy("trial", "rebalance_bar"))
    return rows.select("trial", "rebalance_bar", "series", F.when(gross > 0, F.col("s") / gross).otherwise(0.0).alias("weight"))


def momentum_weights(returns: DataFrame, init: int = 252, step: int = 21, rows: int = 21) -> DataFrame:
    """(rebalance_bar, series, weight) of one look-back."""
    return momentum_trials(returns, [rows], init, step).drop("trial")


def callback_weights(returns: DataFrame, strategy: Callable[[pd.DataFrame], dict[str, float] | pd.Series], init: int = 252, step: int = 21, lookback: int = 0) -> DataFrame:
    """Weights of an opaque strategy: it gets a wide panel of the bars before each rebalance (the last
    `lookback` of them, if given). A strategy that fails, or gives neither dict nor Series, holds nothing.

    Rebalances are dealt to blocks of neighbours, and each block gets the bars that its rebalances need
    once; they are cut for each rebalance in the task.
    """
    last = returns.agg(F.max("bar")).first()[0]
    n = 0 if last is None or last < init else (last - init) // step + 1
    per = max(1, -(-n // (2 * returns.sparkSession.sparkContext.defaultParallelism)))
    blocks = [(b, init + b * per * step, init + (min((b + 1) * per, n) - 1) * step) for b in range(-(-n // per))]
    spans = returns.sparkSession.createDataFrame(blocks, "block int, first long, last long")  # two for each core at most
    needed = F.col("bar") < F.col("last")
    if lookback:
        needed = needed & (F.col("bar") >= F.col("first") - lookback)
    history = returns.select("series", "bar", "ret").join(F.broadcast(spans), needed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, out = pdf.pivot(index="bar", columns="series", values="ret").sort_index(), []
        for at in range(int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0]) + 1, step):
            panel = whole.loc[(at - lookback if lookback else whole.index[0]) : at - 1].dropna(axis=1, how="all")
            if not len(panel):
                continue
            try:
                found = strategy(panel)
                found = dict(found) if isinstance(found, dict | pd.Series) else {}
            except Exception:  # the contract: a failing strategy is out of the market
                found = {}
            out += [(at, c, float(found.get(c, 0.0))) for c in panel.columns]
        return pd.DataFrame(out, columns=["rebalance_bar", "series", "weight"])

    return history.groupBy("block").applyInPandas(run, "rebalance_bar long, series string, weight double")


def turnover(weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rebalance_bar, turnover, change): what is traded to get there from the last book (at first, from nothing).

    change: the same without the first book, which counts 0.
    """
    before = F.lag("weight").over(by(*keys, "series", order="rebalance_bar"))
    rows = weights.withColumn("m", F.abs(F.col("weight") - F.coalesce(before, F.lit(0.0)))).groupBy(*keys, "rebalance_bar").agg(F.sum("m").alias("turnover"))
    first = rows.groupBy(*keys).agg(F.min("rebalance_bar").alias("__first"))
    rows = rows.join(first, list(keys)) if keys else rows.crossJoin(first)
    return rows.withColumn("change", F.when(F.col("rebalance_bar") > F.col("__first"), F.col("turnover")).otherwise(0.0)).drop("__first")


def walk_forward(returns: DataFrame, weights: DataFrame, init: int = 252, step: int = 21, tc_bps: float = 1.0, lag: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bar, rebalance_bar, gross, cost, net) of the out-of-sample bars; keys: columns of weights that part trials.

    The cost (half of tc_bps for each unit traded) falls on a book's first bar; a book without a
    bar loses its cost. Missing returns earn nothing.
    """
    rows = returns.withColumn("rebalance_bar", book_bar(F.col("bar"), init, step, lag)).where(F.col("bar") >= init + lag)
    gross = rows.join(weights, ["rebalance_bar", "series"]).groupBy(*keys, "rebalance_bar", "bar").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    rows = gross.join(turnover(weights, keys).drop("change"), [*keys, "rebalance_bar"])
    cost = F.when(F.col("bar") == F.col("rebalance_bar") + lag, tc_bps / 2 / 1e4 * F.col("turnover")).otherwise(0.0)
    return rows.select(*keys, "bar", "rebalance_bar", "gross", cost.alias("cost")).withColumn("net", F.col("gross") - F.col("cost"))


def cost_sweep(returns: DataFrame, weights: DataFrame, costs: list[float], init: int = 252, step: int = 21, lag: int = 1) -> DataFrame:
    """(tc_bps, bar, net): one pass over the panel for all costs, as weights don't depend on them."""
    unit = walk_forward(returns, weights, init, step, 1.0, lag)
    grid = unit.sparkSession.createDataFrame([(float(c),) for c in costs], "tc_bps double")
    return unit.crossJoin(F.broadcast(grid)).select("tc_bps", "bar", (F.col("gross") - F.col("cost") * F.col("tc_bps")).alias("net"))


def equity(pnl: DataFrame, keys: tuple[str, ...] = (), value: str = "net") -> DataFrame:
    """pnl with its equity curve, running peak and drawdown; a missing return is 0."""
    grown = 1 + F.coalesce(F.col(value), F.lit(0.0))
    logs = {"__size": F.when(grown != 0, F.log(F.abs(grown))).otherwise(0.0), "__negative": F.when(grown < 0, 1).otherwise(0)}
    rows = running(pnl, "bar", keys, logs, {"__lost": F.when(grown == 0, 1).otherwise(0)})
    size = F.exp("__size")
    curve = F.when(F.col("__lost") == 1, 0.0).when(F.col("__negative") % 2 == 1, -size).otherwise(size)
    rows = rows.withColumn("equity", curve).drop(*logs, "__lost")
    rows = running(rows, "bar", keys, maxima={"peak": F.col("equity")})
    return rows.withColumn("drawdown", ratio(F.col("equity"), F.col("peak")) - 1)


def metrics(pnl: DataFrame, keys: tuple[str, ...] = (), value: str = "net", change: DataFrame | None = None) -> DataFrame:
    """Sharpe, Sortino, largest drawdown, Calmar, hit rate, total and annual return (and turnover) of each key."""
    r = F.coalesce(F.col(value), F.lit(0.0))
    rows = equity(pnl, keys, value)
    annual = F.sqrt(F.lit(float(ANNUAL)))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("down"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), (F.max_by("equity", "bar") - 1).alias("total_return"),
    ).where("n > 0")
    out = out.withColumn("annual_return", F.pow(1 + F.col("mu"), F.lit(ANNUAL)) - 1)
    safe = lambda s: F.when(F.col(s) > 1e-10, F.col("mu") / F.col(s) * annual).otherwise(0.0)
    out = out.withColumns({"sharpe": safe("sd"), "sortino": F.coalesce(safe("down"), F.lit(0.0)), "calmar": F.when(F.abs("max_drawdown") > 1e-10, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0)})
    if change is not None:
        out = out.crossJoin(F.broadcast(change.agg(F.avg("change").alias("avg_turnover"))))
    return out.drop("mu", "sd", "down")


def rolling_sharpe(pnl: DataFrame, rows: int = 63, value: str = "net") -> DataFrame:
    """(bar, sharpe): null until the window is full or where it has no spread."""
    moments = {"__mean": (F.avg(value), rows), "__spread": (F.stddev_samp(value), rows)}
    sharpe = ratio(F.col("__mean"), F.col("__spread")) * F.sqrt(F.lit(float(ANNUAL)))
    return rolled(pnl.select("bar", value), "bar", rows, moments).select("bar", sharpe.alias("sharpe"))


def monthly(pnl: DataFrame, value: str = "net") -> DataFrame:
    """(year, month, ret): compounded by calendar month (pnl has ts); months without a bar give 0."""
    ends = pnl.agg(F.min(F.trunc(F.to_date("ts"), "month")).alias("a"), F.max(F.trunc(F.to_date("ts"), "month")).alias("b"))
    months = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    grown = pnl.groupBy(F.trunc(F.to_date("ts"), "month").alias("m")).agg((compounded(F.coalesce(F.col(value), F.lit(0.0))) - 1).alias("ret"))
    return months.join(grown, "m", "left").select(F.year("m").alias("year"), F.month("m").alias("month"), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_table(pnl: DataFrame, value: str = "net") -> DataFrame:
    """A row for each year, a column for each month."""
    return monthly(pnl, value).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def lead_weights(returns: DataFrame, edges: DataFrame, init: int = 252, step: int = 1, refresh: int = 63, rows: int = 252, top: int = 30, cap: float = 0.15, least: int = 30) -> DataFrame:
    """The lead strategy's (rebalance_bar, series, weight), from edges (refresh_bar, source, target, te).

    Of each refresh the top edges predict their followers by rolling one-bar betas on the leaders'
    last returns, weighted by entropy; predictions are scaled to gross 1, clipped, scaled again.
    The refresh that a bar uses is a function of the bar alone, so sweeps can't leak.
    """
    rank = F.row_number().over(Window.partitionBy("refresh_bar").orderBy(F.desc("te"), "source", "target"))
    chosen = edges.withColumn("k", rank).where((F.col("k") <= top) & (F.col("te") > 0)).drop("k")
    dates = rebalances(returns, init, step).withColumn("refresh_bar", F.lit(init) + refresh * F.floor((F.col("rebalance_bar") - init) / refresh))
    series = returns.select("series", "bar", "ret")
    pairs = chosen.select("source", "target").distinct()
    both = series.select(F.col("series").alias("source"), F.col("bar"), F.col("ret").alias("now"), F.lag("ret").over(by("series")).alias("l")).join(pairs, "source")
    both = both.join(series.select(F.col("series").alias("target"), "bar", F.col("ret").alias("f")), ["target", "bar"])
    # rows up to bar b - 1, as known before rebalance bar b
    w = Window.partitionBy("source", "target").orderBy("bar").rowsBetween(1 - rows, 0)
    n, sl, sf = F.count("l").over(w), F.sum("l").over(w), F.sum(F.when(F.col("l").isNotNull(), F.col("f"))).over(w)
    spread = F.sum(F.col("l") * F.col("l")).over(w) - sl * sl / n
    beta = F.when((n >= least) & (spread > 1e-18), (F.sum(F.col("l") * F.col("f")).over(w) - sl * sf / n) / F.nullif(spread, F.lit(0.0)))
    betas = both.select("source", "target", (F.col("bar") + 1).alias("rebalance_bar"), "now", beta.alias("beta"))
    used = chosen.join(dates, "refresh_bar").join(betas, ["source", "target", "rebalance_bar"]).where("beta is not null")
    raw = used.groupBy("rebalance_bar", "target").agg((F.sum(F.col("te") * F.col("beta") * F.col("now")) / F.sum("te")).alias("p"))
    every = Window.partitionBy("rebalance_bar")
    scaled = raw.withColumn("w", F.col("p") / F.nullif(F.sum(F.abs("p")).over(every), F.lit(0.0))).withColumn("w", clip(F.col("w"), -cap, cap))
    scaled = scaled.withColumn("w", F.col("w") / F.nullif(F.sum(F.abs("w")).over(every), F.lit(0.0)))
    grid = dates.select("rebalance_bar").crossJoin(series.select("series").distinct())
    return grid.join(scaled.select("rebalance_bar", F.col("target").alias("series"), "w"), ["rebalance_bar", "series"], "left").select("rebalance_bar", "series", F.coalesce("w", F.lit(0.0)).alias("weight"))


def refresh_edges(returns: DataFrame, followers: list[str] | None = None, init: int = 252, refresh: int = 63, lookback: int = 750, lag: int = 1, **options) -> DataFrame:
    """(refresh_bar, source, target, te): each refresh's entropies, on the bars before it, of allowed followers only."""
    from panelflow.operators.discovery import entropy_matrix

    dates = rebalances(returns, init, refresh).withColumnRenamed("rebalance_bar", "refresh_bar")
    history = returns.join(dates, (F.col("bar") < F.col("refresh_bar")) & (F.col("bar") >= F.col("refresh_bar") - lookback))
    return entropy_matrix(history, lags=[lag], targets=followers, keys=("refresh_bar",), **options).select("refresh_bar", "source", "target", "te")
