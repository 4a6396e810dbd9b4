"""Stationarity tests of each series: augmented Dickey-Fuller and KPSS."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelflow.functions.numeric import ols

# MacKinnon's response surfaces of the Dickey-Fuller statistic with a constant (1994): the
# normal quantile of p as a polynomial in the statistic, below and above where the two meet, and the
# statistics beyond which p is 0 or 1.
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_MEET, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
# Published critical values of the other test about a level.
KPSS_LEVELS = [(0.10, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739)]


def adf_p(stat: float) -> float:
    """The p-value of a Dickey-Fuller statistic with a constant."""
    if stat > ADF_MOST:
        return 1.0
    if stat < ADF_LEAST:
        return 0.0
    surface = ADF_LOW if stat <= ADF_MEET else ADF_HIGH
    return NormalDist().cdf(sum(c * stat**i for i, c in enumerate(surface)))


def adf(x: np.ndarray) -> tuple[float, float]:
    """(statistic, p) with a constant; the number of lags has the least AIC."""
    n = len(x)
    dx, most = np.diff(x), int(np.ceil(12 * (n / 100) ** 0.25))
    most = max(0, min(most, n // 2 - 2))
    y = dx[most:]

    def design(lags: int, start: int) -> np.ndarray:
        return np.column_stack([np.ones(len(dx) - start), x[start:-1], *[dx[start - k : len(dx) - k] for k in range(1, lags + 1)]])

    def aic(lags: int) -> float:
        _, _, rss = ols(design(lags, most), y)
        return len(y) * np.log(max(rss, 1e-300) / len(y)) + 2 * (lags + 2)

    lags = min(range(most + 1), key=aic)
    coef, error, _ = ols(design(lags, lags), dx[lags:])
    stat = float(coef[1] / error[1]) if error[1] > 0 else 0.0
    return stat, adf_p(stat)


def kpss(x: np.ndarray) -> tuple[float, float]:
    """(statistic, p) about a level; bandwidth by the data; p within the published table's range."""
    n = len(x)
    e = x - x.mean()
    most = int(n ** (2 / 9))
    cov = lambda k: float(e[k:] @ e[: n - k]) / n
    s0, s1 = cov(0) + 2 * sum(cov(i) for i in range(1, most + 1)), 2 * sum(i * cov(i) for i in range(1, most + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    spread = cov(0) + 2 * sum((1 - i / (lags + 1)) * cov(i) for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / spread) if spread > 0 else 0.0
    return stat, float(np.interp(stat, [v for _, v in KPSS_LEVELS], [p for p, _ in KPSS_LEVELS]))


def stationarity(returns: DataFrame, value: str = "ret", least: int = 20) -> DataFrame:
    """(series, n, adf, adf_p, kpss, kpss_p, stationary): nulls for fewer than `least` rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("bar")[value].dropna().to_numpy(float)
        head = [pdf["series"].iloc[0], len(x)]
        if len(x) < least:
            return pd.DataFrame([[*head, None, None, None, None, None]], columns=names).astype({"stationary": object})
        a, ap = adf(x)
        k, kp = kpss(x)
        return pd.DataFrame([[*head, a, ap, k, kp, bool(ap < 0.05 and kp >= 0.05)]], columns=names)

    names = ["series", "n", "adf", "adf_p", "kpss", "kpss_p", "stationary"]
    return returns.groupBy("series").applyInPandas(run, "series string, n long, adf double, adf_p double, kpss double, kpss_p double, stationary boolean")
