"""Features that tell market regimes, by the roles that series play."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.prefix import rolled

# A feature, the series that may play its role (the first that the panel has), and
# whether it is their rolling volatility or their rolling mean.
ROLES = [
    ("spx_rvol", ["SPX"], "volatility"),
    ("credit_stress", ["HY_OAS", "IG_OAS", "BBB_OAS"], "mean"),
    ("curve_slope", ["SPREAD_2s10s"], "mean"),
    ("vix_level", ["VIX"], "mean"),
]


def regime_features(returns: DataFrame, roles: list[tuple[str, list[str], str]] | None = None, window: int = 21, annual: int = 252) -> DataFrame:
    """(bar, feature, value): each role's rolling feature, standardised over the bars that have all of them.

    A role that no series of the panel plays has no feature. A window with a missing return has no
    value. A feature without spread stays as it is.
    """
    roles = ROLES if roles is None else roles
    wanted = {s for _, candidates, _ in roles for s in candidates}
    there = {r[0] for r in returns.where(F.col("series").isin(list(wanted))).select("series").distinct().collect()}  # no more than the roles name
    parts = []
    for name, candidates, kind in roles:
        if found := [s for s in candidates if s in there]:
            parts.append(F.when(F.col("series") == found[0], F.struct(F.lit(name).alias("feature"), F.lit(kind).alias("kind"))))
    if not parts:
        return returns.select("bar", F.col("series").alias("feature"), F.col("ret").cast("double").alias("value")).limit(0)
    value = F.when(~F.isnan("ret"), F.col("ret"))
    rows = returns.select("bar", value.alias("ret"), F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("bar", "ret", "p.feature", "p.kind")
    whole = {"__n": (F.count("ret"), window), "__mean": (F.avg("ret"), window), "__spread": (F.stddev_samp("ret"), window)}
    rows = rolled(rows, "bar", window, whole, ("feature",)).where(F.col("__n") == window)
    raw = F.when(F.col("kind") == "volatility", F.col("__spread") * F.sqrt(F.lit(float(annual)))).otherwise(F.col("__mean"))
    rows = rows.select("bar", "feature", raw.alias("value"))
    rows = rows.join(rows.groupBy("bar").count().where(F.col("count") == len(parts)).select("bar"), "bar", "left_semi")
    moments = rows.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    scaled = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).otherwise(F.col("value"))
    return rows.join(moments, "feature").select("bar", "feature", scaled.alias("value"))
