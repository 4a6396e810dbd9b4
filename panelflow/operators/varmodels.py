"""Vector autoregressions: sparse (lasso) and regime-switching, and hidden Markov regimes.

Lasso fits are spread over targets. Regimes are fitted on blocks of bars by operators.chains, whatever
a panel's length; SwitchingVar and GaussianHmm are the same recursions for a panel in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.numeric import kmeans, log_gaussian, logsumexp
from panelflow.operators import chains, gram
from panelflow.sources import store


# -- lasso --------------------------------------------------------------------------------------


def lasso_var(returns: DataFrame, lags: int = 5, alpha: float | None = None, criterion: str = "bic") -> DataFrame:
    """(target, source, lag, coef, alpha, intercept) of every target's regression on all series' lags, as they are scaled.

    alpha None: chosen along the path by the criterion. returns must have a row for each series and
    bar. The fits use sums of products only (operators.gram), so no task holds the panel.
    """
    return gram.sparse_regressions(gram.gram(returns, lags), lags, alpha, criterion)


def lasso_forecast(returns: DataFrame, coefficients: DataFrame, steps: int = 1) -> DataFrame:
    """(series, step, value): iterated forecasts from lasso_var()'s rows, behind each series' last bars.

    A step is one join of the coefficients with the last values, so the panel is never gathered. The
    coefficients and each step's values, a row for each series, are written and read back.
    """
    folder = store.scratch(returns.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    coefficients = kept(coefficients, "coefficients")
    lags = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("bar")))
    deepest = coefficients.agg(F.max("lag").alias("deepest"))
    past = returns.select("series", F.col("ret").alias("value"), lags.alias("lag")).crossJoin(F.broadcast(deepest)).where("lag <= deepest").drop("deepest")
    past, out = kept(past, "past"), None
    for step in range(1, steps + 1):
        terms = coefficients.join(past.withColumnRenamed("series", "source"), ["source", "lag"])
        new = kept(terms.groupBy(F.col("target").alias("series")).agg((F.sum(F.col("coef") * F.col("value")) + F.first("intercept")).alias("value")), f"step{step}")
        rows = new.select("series", F.lit(step).alias("step"), "value")
        out = rows if out is None else out.union(rows)
        past = past.withColumn("lag", F.col("lag") + 1).union(new.select("series", "value", F.lit(1).alias("lag")))
    return out


def lead_matrix(coefficients: DataFrame) -> DataFrame:
    """(source, target, lead): the mean over the lags of the absolute coefficients."""
    return coefficients.groupBy("source", "target").agg((F.sum(F.abs("coef")) / F.max("lag")).alias("lead"))


def forecast(coef: np.ndarray, history: np.ndarray, steps: int = 1, constant: np.ndarray | float = 0.0) -> np.ndarray:
    """Iterated forecasts: coef[lag - 1, target, source], history's last rows newest at the end."""
    past = list(history[-len(coef) :])
    out = []
    for _ in range(steps):
        out.append(constant + sum(c @ past[-k - 1] for k, c in enumerate(coef)))
        past.append(out[-1])
    return np.array(out)


# -- regime-switching -----------------------------------------------------------------------------


@dataclass
class SwitchingVar:
    """A vector autoregression whose coefficients and covariance depend on a hidden Markov regime.

    Densities are summed in logs. compat=True clips log densities to [-500, 0] instead, as some
    implementations do, which blurs regimes on data of small scale.
    """

    lags: int = 2
    regimes: int = 2
    max_iter: int = 100
    tol: float = 1e-6
    seed: int = 42
    compat: bool = False

    def design(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        return data[self.lags :], np.column_stack([np.ones(n - self.lags), *[data[self.lags - k : n - k] for k in range(1, self.lags + 1)]])

    def density(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.stack([log_gaussian(y - x @ b, np.zeros(y.shape[1]), s) for b, s in zip(self.coef, self.cov, strict=True)], 1)
        return np.clip(out, -500, 0) if self.compat else out

    def filtered(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Filtered and predicted log probabilities, and the log likelihood."""
        move, now = np.log(self.moves), np.log(self.start)
        kept, ahead, total = np.empty_like(logp), np.empty_like(logp), 0.0
        for t in range(len(logp)):
            ahead[t] = now if t == 0 else logsumexp(kept[t - 1][:, None] + move, 0)
            joint = ahead[t] + logp[t]
            level = logsumexp(joint, 0)
            kept[t], total = joint - level, total + float(level)
        return kept, ahead, total

    def smoothed(self, kept: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed probabilities, and the sums of the joint ones of neighbouring times."""
        move, s = np.log(self.moves), kept.copy()
        pairs = np.zeros_like(self.moves)
        for t in range(len(kept) - 2, -1, -1):
            joint = kept[t][:, None] + move + (s[t + 1] - ahead[t + 1])[None]
            s[t] = logsumexp(joint, 1)
            pairs += np.exp(joint)
        return np.exp(s), pairs

    def fit(self, data: np.ndarray) -> SwitchingVar:
        y, x = self.design(data)
        labels = kmeans(np.column_stack([y, np.abs(y)]), self.regimes, self.seed)
        weight = np.where(labels[:, None] == np.arange(self.regimes), 0.9, 0.1 / max(self.regimes - 1, 1))
        self.moves = np.full((self.regimes, self.regimes), 0.1 / max(self.regimes - 1, 1))
        np.fill_diagonal(self.moves, 0.9)
        self.start = np.full(self.regimes, 1 / self.regimes)
        self.maximise(y, x, weight)
        last = -np.inf
        for turn in range(self.max_iter):
            kept, ahead, total = self.filtered(self.density(y, x))
            weight, pairs = self.smoothed(kept, ahead)
            self.moves = (pairs + 1e-10) / (pairs + 1e-10).sum(1, keepdims=True)
            self.start = np.maximum(weight[0], 1e-10) / np.maximum(weight[0], 1e-10).sum()
            self.maximise(y, x, weight)
            if turn > 5 and abs(total - last) < self.tol:
                break
            last = total
        kept, ahead, self.loglik = self.filtered(self.density(y, x))
        self.filter, self.smooth = np.exp(kept), self.smoothed(kept, ahead)[0]
        return self

    def maximise(self, y: np.ndarray, x: np.ndarray, weight: np.ndarray) -> None:
        self.coef, self.cov = [], []
        for r in range(self.regimes):
            w = weight[:, r : r + 1]
            b = np.linalg.solve(x.T @ (x * w) + 1e-6 * np.eye(x.shape[1]), x.T @ (y * w))
            e = y - x @ b
            self.coef.append(b)
            self.cov.append((e * w).T @ e / max(w.sum(), 1e-10) + 1e-6 * np.eye(y.shape[1]))

    def predict(self, data: np.ndarray, steps: int = 1) -> np.ndarray:
        """Iterated forecasts, the regimes weighted by their probabilities so far."""
        past, p, out = list(data[-self.lags :]), self.filter[-1], []
        for _ in range(steps):
            p = p @ self.moves
            row = np.concatenate([[1.0], *past[: -self.lags - 1 : -1]])
            out.append(sum(p[r] * (row @ self.coef[r]) for r in range(self.regimes)))
            past.append(out[-1])
        return np.array(out)

    def current(self) -> int:
        return int(self.filter[-1].argmax())


def _switching(returns: DataFrame, key: str, lags: int, block_bars: int | None, options: dict) -> tuple[chains.Blocks, dict]:
    blocks = chains.lagged_blocks(returns, key, lags, store.scratch(returns.sparkSession), block_bars)
    return blocks, chains.switching_chains(blocks, lags, **options)


def switching_var(returns: DataFrame, key: str = "panel", lags: int = 2, block_bars: int | None = None, **options) -> DataFrame:
    """(key, bar, regime, prob, smoothed): filtered and smoothed probabilities of each panel's bars.

    The panels' bars stay in blocks (operators.chains); panels fitted together have as many series.
    """
    found = chains.probabilities(*_switching(returns, key, lags, block_bars, options))
    regime = (F.array_position("prob", F.array_max("prob")) - 1).cast("int")
    return found.select(key, "bar", regime.alias("regime"), "prob", "smoothed")


def switching_coefficients(returns: DataFrame, key: str = "panel", lags: int = 2, block_bars: int | None = None, **options) -> DataFrame:
    """(key, regime, source, target, lag, coefficient): lag 0 has the constants, without a source. A panel's parameters are few."""
    _, models = _switching(returns, key, lags, block_bars, options)
    rows = []
    for panel, names in chains.names_of(returns, key, "series").items():
        for r, b in enumerate(models[panel].coef if panel in models else ()):
            for j, target in enumerate(names):
                rows.append((panel, r, None, target, 0, float(b[0, j])))
                rows += [(panel, r, source, target, lag, float(b[1 + (lag - 1) * len(names) + i, j])) for lag in range(1, lags + 1) for i, source in enumerate(names)]
    kind = returns.schema[key].dataType.simpleString()
    return returns.sparkSession.createDataFrame(rows, f"{key} {kind}, regime int, source string, target string, lag int, coefficient double")


# -- hidden Markov regimes ------------------------------------------------------------------------


@dataclass
class GaussianHmm:
    """Gaussian emissions with full covariances; two regimes are ordered by the trace of theirs."""

    regimes: int = 2
    max_iter: int = 200
    tol: float = 1e-4
    seed: int = 42

    def fit(self, x: np.ndarray) -> GaussianHmm:
        d, labels = x.shape[1], kmeans(x, self.regimes, self.seed)
        weight = np.where(labels[:, None] == np.arange(self.regimes), 0.95, 0.05 / max(self.regimes - 1, 1))
        self.moves = np.full((self.regimes, self.regimes), 0.1 / max(self.regimes - 1, 1))
        np.fill_diagonal(self.moves, 0.9)
        self.start, last = np.full(self.regimes, 1 / self.regimes), -np.inf
        for turn in range(self.max_iter + 1):
            w = weight / np.maximum(weight.sum(0), 1e-10)
            self.mean = w.T @ x
            self.cov = [((x - m).T * w[:, r]) @ (x - m) + 1e-6 * np.eye(d) for r, m in enumerate(self.mean)]
            forward, ahead, total = SwitchingVar.filtered(self, self.density(x))
            weight, pairs = SwitchingVar.smoothed(self, forward, ahead)
            if turn and total - last < self.tol:
                break
            self.moves = (pairs + 1e-10) / (pairs + 1e-10).sum(1, keepdims=True)
            self.start, last = np.maximum(weight[0], 1e-10) / np.maximum(weight[0], 1e-10).sum(), total
        if self.regimes == 2 and np.trace(self.cov[0]) > np.trace(self.cov[1]):
            self.mean, self.cov, self.start = self.mean[::-1], self.cov[::-1], self.start[::-1]
            self.moves = self.moves[::-1, ::-1]
        self.prob = self.posterior(x)
        self.labels = self.viterbi(x)
        return self

    def density(self, x: np.ndarray) -> np.ndarray:
        return np.stack([log_gaussian(x, m, s) for m, s in zip(self.mean, self.cov, strict=True)], 1)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        forward, ahead, _ = SwitchingVar.filtered(self, self.density(x))
        return SwitchingVar.smoothed(self, forward, ahead)[0]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        logp, move = self.density(x), np.log(self.moves)
        best, came = np.log(self.start) + logp[0], np.zeros(logp.shape, int)
        for t in range(1, len(logp)):
            way = best[:, None] + move
            came[t] = way.argmax(0)
            best = way.max(0) + logp[t]
        path = np.empty(len(logp), int)
        path[-1] = best.argmax()
        for t in range(len(logp) - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        return path


def hmm_regimes(features: DataFrame, key: str = "panel", method: str = "hmm", regimes: int = 2, seed: int = 42, block_bars: int | None = None) -> DataFrame:
    """(key, bar, regime, prob) of features (key, bar, feature, value); method "kmeans": labels without a chain."""
    return predicted_regimes(features, None, key, method, regimes, seed, block_bars)


def predicted_regimes(features: DataFrame, new: DataFrame | None, key: str = "panel", method: str = "hmm", regimes: int = 2, seed: int = 42, block_bars: int | None = None) -> DataFrame:
    """(key, bar, regime, prob) of new rows (key, bar, feature, value) under the model of each panel's own rows.

    prob: as the new rows, one after the other, show it; panels without rows to learn from give none.
    new None: the rows learned from. Bars stay in blocks (operators.chains).
    """
    if method not in ("hmm", "kmeans"):
        raise ValueError(f"no regime method {method}")
    folder = store.scratch(features.sparkSession)
    blocks = later = chains.gaussian_blocks(features, key, folder, block_bars)
    models = chains.gaussian_chains(blocks, regimes, seed=seed) if method == "hmm" else _centres(blocks, regimes, seed)
    if new is not None:
        known = new.join(features.select(key, "feature").distinct(), [key, "feature"], "left_semi")
        later = chains.gaussian_blocks(known, key, folder, block_bars, "later")
    later = chains.Blocks(later.rows.where(F.col(key).isin(list(models))), key, later.shape)
    if method == "hmm":
        prob = chains.probabilities(later, models).select(key, "bar", F.col("smoothed").alias("prob"))
        return chains.best_states(later, models).join(prob, [key, "bar"]).select(key, "bar", "regime", "prob")

    def nearest(piece: chains.Piece, bars: np.ndarray, z: np.ndarray) -> dict:
        labels = ((z[:, None, 1:] - models[piece.key]) ** 2).sum(2).argmin(1)
        return {"bar": bars, "regime": labels.astype(np.int32), "prob": np.eye(regimes)[labels].tolist()}

    return later.mapped(nearest, "bar long, regime int, prob array<double>")


def _centres(blocks: chains.Blocks, regimes: int, seed: int) -> dict:
    """key -> the centres of k-means on chains.FIRST_BARS bars at most."""
    out = {}
    for panel, z in blocks.sample().items():
        labels = kmeans(z[:, 1:], regimes, seed)
        out[panel] = np.array([z[labels == r, 1:].mean(0) if (labels == r).any() else np.full(z.shape[1] - 1, np.inf) for r in range(regimes)])
    return out


def switching_forecast(returns: DataFrame, steps: int = 1, key: str = "panel", lags: int = 2, block_bars: int | None = None, **options) -> DataFrame:
    """(key, series, step, value, regime): iterated forecasts behind each panel's last bar, and the regime it ends in."""
    blocks, models = _switching(returns, key, lags, block_bars, options)
    chains.expected(blocks, models)
    ends = blocks.mapped(lambda p, b, z: {"bar": b[-1:], "z": [z[-1].tolist()]}, "bar long, z array<double>")
    rows, names = [], chains.names_of(returns, key, "series")
    for r in ends.groupBy(key).agg(F.max_by("z", "bar").alias("z")).collect():
        chain, n = models[r[0]], len(names[r[0]])
        # newest first: the bar's own values, then those of its lags
        past, p = np.concatenate([r["z"][-n:], r["z"][1 : 1 + n * (lags - 1)]]), chain.last
        for step in range(1, steps + 1):
            p = p @ chain.moves
            value = sum(p[i] * (np.concatenate([[1.0], past]) @ b) for i, b in enumerate(chain.coef))
            rows += [(r[0], s, step, float(v), int(chain.last.argmax())) for s, v in zip(names[r[0]], value, strict=True)]
            past = np.concatenate([value, past[: n * (lags - 1)]])
    kind = returns.schema[key].dataType.simpleString()
    return returns.sparkSession.createDataFrame(rows, f"{key} {kind}, series string, step int, value double, regime int")
