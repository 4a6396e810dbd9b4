"""Portfolio weights: inverse volatility, risk parity, Kelly, position and sector limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import clip
from panelflow.operators.pairs import recent_sigma


def _all():
    """One window over a portfolio's few rows."""
    return Window.partitionBy(F.lit(1))


def inverse_volatility(returns: DataFrame, rows: int = 252) -> DataFrame:
    """(series, weight): 1/sigma of the last rows, normalised; equal weights if no series moves."""
    sigma = recent_sigma(returns, rows)
    inverse = F.when(F.col("sigma") > 0, 1.0 / F.col("sigma"))
    total = F.sum(inverse).over(_all())
    return sigma.select("series", F.when(total.isNull(), 1.0 / F.count(F.lit(1)).over(_all())).otherwise(inverse / total).alias("weight")).where("weight is not null")


def constrained(weights: DataFrame, sectors: DataFrame, max_position: float = 0.15, max_sector: float = 0.40) -> DataFrame:
    """(series, sector, weight): clipped positions, sectors scaled to their limit, then gross exposure of 1.

    The last step can lift a position over its limit again. Series without a sector are in "other".
    """
    rows = weights.join(F.broadcast(sectors.select("series", "sector")), "series", "left").withColumn("sector", F.coalesce("sector", F.lit("other")))
    rows = rows.withColumn("w", clip(F.col("weight"), -max_position, max_position))
    gross = F.sum(F.abs("w")).over(Window.partitionBy("sector"))
    rows = rows.withColumn("w", F.when(gross > max_sector, F.col("w") * max_sector / gross).otherwise(F.col("w")))
    total = F.sum(F.abs("w")).over(_all())
    return rows.select("series", "sector", F.when(total > 0, F.col("w") / total).otherwise(0.0).alias("weight"))


def equal_risk(cov: np.ndarray, turns: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Long-only weights of equal risk contributions, by cyclical descent on each weight's quadratic."""
    n = len(cov)
    x = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-18))
    x /= np.sqrt(x @ cov @ x)
    for _ in range(turns):
        before = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest**2 + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - before).max() < tol * x.max():
            break
    return x / x.sum()


def kelly(mu: np.ndarray, cov: np.ndarray, max_leverage: float = 2.0) -> np.ndarray:
    """Growth-optimal weights of the ridged covariance, scaled down to the gross leverage allowed."""
    w = np.linalg.solve(cov + 1e-6 * np.eye(len(mu)), mu)
    gross = np.abs(w).sum()
    return w * (max_leverage / gross) if gross > max_leverage else w


def _by_portfolio(forecasts: DataFrame, covariances: DataFrame, solve, key: str) -> DataFrame:
    """solve(mu, cov) of each portfolio; forecasts (key, series, mu), covariances (key, a, b, cov)."""

    def run(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        matrix = c.pivot(index="a", columns="b", values="cov") if len(c) else pd.DataFrame()
        names = [s for s in sorted(f["series"]) if s in matrix.index]
        if not names:
            return pd.DataFrame({key: f[key].iloc[:0], "series": f["series"].iloc[:0], "weight": f["mu"].iloc[:0]})
        mu = f.set_index("series")["mu"].reindex(names).to_numpy(float)
        w = solve(mu, matrix.loc[names, names].to_numpy(float))
        return pd.DataFrame({key: f[key].iloc[0], "series": names, "weight": w})

    kind = forecasts.schema[key].dataType.simpleString()
    return forecasts.groupBy(key).cogroup(covariances.groupBy(key)).applyInPandas(run, f"{key} {kind}, series string, weight double")


def risk_parity(forecasts: DataFrame, covariances: DataFrame, key: str = "portfolio") -> DataFrame:
    return _by_portfolio(forecasts, covariances, lambda mu, cov: equal_risk(cov), key)


def kelly_weights(forecasts: DataFrame, covariances: DataFrame, max_leverage: float = 2.0, key: str = "portfolio") -> DataFrame:
    return _by_portfolio(forecasts, covariances, lambda mu, cov: kelly(mu, cov, max_leverage), key)
