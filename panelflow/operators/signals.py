"""Signals of leaders for followers, their averages, and the boards made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import sigmoid
from panelflow.operators.discovery import NEXT_DAY, SLOW, SWING

TRADABLE = (NEXT_DAY, SWING, SLOW)


def raw_signal(coefficient: Column, leader_return: Column) -> Column:
    return coefficient * leader_return


def confidence(te: Column) -> Column:
    return sigmoid(te * 10.0)


def generate(edges: DataFrame, coefficients: DataFrame, latest: DataFrame, regime: int, threshold: float = 0.01, top: int = 10) -> DataFrame:
    """(leader, follower, lag, te_score, regime, coefficient, leader_return, raw_signal, confidence) of the strongest edges.

    edges (source, target, lag, te); coefficients (regime, source, target, coefficient), joined by
    name, of the regime or else of the first one; latest (series, ret).
    """
    chosen = coefficients.agg(F.max(F.when(F.col("regime") == regime, F.lit(regime))).alias("own"), F.min("regime").alias("first")).select(F.coalesce("own", "first").alias("r"))
    own = coefficients.join(F.broadcast(chosen), F.col("regime") == F.col("r")).select("source", "target", "coefficient")
    rows = edges.where((F.col("te") >= threshold) & (F.col("source") != F.col("target"))).join(own, ["source", "target"], "left")
    rows = rows.join(latest.select(F.col("series").alias("source"), F.col("ret").alias("leader_return")), "source", "left")
    rows = rows.withColumns({"coefficient": F.coalesce("coefficient", F.lit(0.0)), "leader_return": F.coalesce("leader_return", F.lit(0.0))})
    rows = rows.orderBy(F.desc("te"), "source", "target", "lag").limit(top)
    return rows.select(F.col("source").alias("leader"), F.col("target").alias("follower"), "lag", F.col("te").alias("te_score"), F.lit(regime).alias("regime"), "coefficient", "leader_return", raw_signal(F.col("coefficient"), F.col("leader_return")).alias("raw_signal"), confidence(F.col("te")).alias("confidence"))


def averaged(signals: DataFrame) -> DataFrame:
    """(follower, expected_return, confidence, dominant_leader, leaders): signals weighted by their entropy.

    Equal weights where the entropies sum to nothing. leaders: array of structs by leader.
    """
    total = F.sum("te_score").over(Window.partitionBy("follower"))
    n = F.count(F.lit(1)).over(Window.partitionBy("follower"))
    rows = signals.withColumn("w", F.when(total > 1e-10, F.col("te_score") / total).otherwise(1.0 / n))
    leader = F.struct(F.col("leader").alias("name"), F.col("w").alias("weight"), F.col("raw_signal").alias("signal"), "te_score")
    return rows.groupBy("follower").agg(
        F.sum(F.col("w") * F.col("raw_signal")).alias("expected_return"),
        F.sum(F.col("w") * F.col("confidence")).alias("confidence"),
        F.min_by("leader", F.struct(-F.col("w"), F.col("leader"))).alias("dominant_leader"),
        F.array_sort(F.collect_list(leader)).alias("leaders"),
    )


def regime_weights(edges: DataFrame, regime: int, fallback: int | None = None, threshold: float = 0.01, top: int = 3) -> DataFrame:
    """(follower, leader, weight): each follower's `top` leaders of the regime's edges, or the fallback's; weights sum to 1."""
    has = edges.agg(F.max(F.when(F.col("regime") == regime, regime)).alias("own"), F.max(F.when(F.col("regime") == fallback, fallback) if fallback is not None else F.lit(None).cast("int")).alias("other"))
    chosen = has.select(F.coalesce("own", "other").alias("__r"))
    rows = edges.join(F.broadcast(chosen), F.col("regime") == F.col("__r")).where((F.col("te") >= threshold) & (F.col("source") != F.col("target")))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("te"), "source"))
    rows = rows.withColumn("k", rank).where(F.col("k") <= top)
    share = F.col("te") / F.sum("te").over(Window.partitionBy("target"))
    return rows.select(F.col("target").alias("follower"), F.col("source").alias("leader"), share.alias("weight"))


# The market that a series trades on; those that aren't named are "other".
MARKETS = {
    "equity": "SPX NDX RTY XLB XLC XLE XLF XLI XLK XLP XLRE XLU XLV XLY VIX",
    "fx": "EURUSD USDJPY GBPUSD AUDUSD USDCAD USDCNH DXY",
    "crypto": "BTC ETH",
    "commodity": "GOLD COPPER BRENT",
    "bond": "UST_2Y UST_10Y UST_30Y REAL_YIELD_10Y BREAKEVEN_5Y BREAKEVEN_10Y MOVE",
    "credit": "IG_OAS HY_OAS BBB_OAS CCC_OAS",
    "weekly_macro": "NFCI CFNAI",
}
# Whether a follower's price can still be acted on once the leader's is known.
ACTIONABLE, PRICED, DELAYED = "actionable", "likely priced", "delayed data"


def market_of(series: Column) -> Column:
    found = F.lit("other")
    for market, names in MARKETS.items():
        found = F.when(series.isin(*names.split()), market).otherwise(found)
    return found


def timing(leader: Column, follower: Column) -> Column:
    """When a signal can be acted on, by the markets of its ends.

    A leader of weekly figures is known late, whatever follows it. Followers that trade around the
    clock have moved before anyone can act: crypto behind any leader, currencies behind those
    that close with or before them (equities, currencies, bonds, credit). All else is in time.
    """
    moved = (follower == "crypto") | ((follower == "fx") & leader.isin("equity", "fx", "bond", "credit"))
    return F.when(leader == "weekly_macro", DELAYED).when(moved, PRICED).otherwise(ACTIONABLE)


def board(edges: DataFrame, correlations: DataFrame, betas: DataFrame, hits: DataFrame, latest: DataFrame, markets: DataFrame, top: int = 20) -> DataFrame:
    """The strongest pairs with what they say now: correlation, beta, expected return, hit rate, strength, timing.

    edges (source, target, lag, te), of which each pair's smallest lag counts; markets (series, market).
    """
    smallest = F.min("lag").over(Window.partitionBy("source", "target"))
    rows = edges.withColumn("m", smallest).where("lag = m").drop("m").orderBy(F.desc("te"), "source", "target").limit(top)
    most = F.max("te").over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("te_strength", F.when(most > 0, F.least(F.col("te") / most, F.lit(1.0))).otherwise(0.0))
    for other, columns in ((correlations, ["corr"]), (betas, ["beta"]), (hits, ["rate", "n"])):
        rows = rows.join(other.select("source", "target", *columns), ["source", "target"], "left")
    rows = rows.join(latest.select(F.col("series").alias("source"), F.col("ret").alias("leader_return")), "source", "left")
    rows = rows.join(markets.select(F.col("series").alias("source"), F.col("market").alias("leader_market")), "source", "left")
    rows = rows.join(markets.select(F.col("series").alias("target"), F.col("market").alias("follower_market")), "target", "left")
    other = F.lit("other")
    return rows.select(
        F.col("source").alias("leader"), F.col("target").alias("follower"), "lag", "te", "te_strength", "corr", "beta",
        (F.coalesce("beta", F.lit(0.0)) * F.coalesce("leader_return", F.lit(0.0))).alias("expected_return"),
        F.col("rate").alias("hit_rate"), F.col("n").alias("hit_n"),
        timing(F.coalesce("leader_market", other), F.coalesce("follower_market", other)).alias("timing"),
    )


def tradable(decays: DataFrame, categories: tuple[str, ...] = TRADABLE) -> DataFrame:
    """Each pair's row of smallest lag, of tradable categories, strongest first."""
    smallest = F.min("lag").over(Window.partitionBy("source", "target"))
    return decays.withColumn("m", smallest).where((F.col("lag") == F.col("m")) & F.col("category").isin(*categories)).drop("m")


def summary(board_rows: DataFrame) -> DataFrame:
    """(signals, strongest, mean_abs_return, best_hit_rate) of a board."""
    size = F.abs("expected_return")
    name = F.concat_ws(" > ", "leader", "follower")
    return board_rows.agg(F.count(F.lit(1)).alias("signals"), F.min_by(name, F.struct(-size, name)).alias("strongest"), F.avg(size).alias("mean_abs_return"), F.max("hit_rate").alias("best_hit_rate"))


def split_actionable(board_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signals that can still be acted on, and the others."""
    acts = F.col("timing") == ACTIONABLE
    return board_rows.where(acts), board_rows.where(~acts)
