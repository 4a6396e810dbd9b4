"""Numerics of grouped functions: digamma, the normal distribution, small solvers."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

EULER = 0.5772156649015329


def digamma_table(n: int) -> np.ndarray:
    """psi(0..n) at integers: -gamma plus harmonic numbers (the entry 0 is unused)."""
    return np.concatenate([[np.nan], -EULER + np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, max(n, 1)))])])


def expected_max_sharpe(trials: int) -> float:
    """Expected largest Sharpe ratio of independent trials without skill, in standard errors."""
    if trials < 2:
        return 0.0
    q = NormalDist().inv_cdf
    return (1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * np.e))


def deflated_sharpe(sharpe: float, trials: int, n: int, skew: float = 0.0, kurtosis: float = 3.0, trial_std: float = 1.0) -> dict[str, float | bool]:
    """Probability that the Sharpe ratio exceeds what the best of the trials would show by luck."""
    if n < 2:
        return {"deflated": 0.0, "p_value": 1.0, "benchmark": 0.0, "passes": False}
    benchmark = trial_std * expected_max_sharpe(trials)
    spread = (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) / (n - 1)
    deflated = NormalDist().cdf((sharpe - benchmark) / spread**0.5) if spread > 0 else 0.0
    return {"deflated": deflated, "p_value": 1 - deflated, "benchmark": benchmark, "passes": deflated >= 0.95}


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residual sum of squares."""
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ coef
    rss = float(rest @ rest)
    cov = np.linalg.pinv(x.T @ x) * rss / max(len(y) - x.shape[1], 1)
    return coef, np.sqrt(np.maximum(np.diag(cov), 0)), rss


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, coef: np.ndarray | None = None, max_iter: int = 10_000, tol: float = 1e-8) -> np.ndarray:
    """Coordinate descent on |y - xb|^2 / 2n + alpha |b|_1, by the Gram matrix."""
    return lasso_gram(x.T @ x / len(y), x.T @ y / len(y), alpha, coef, max_iter, tol)


def lasso_gram(gram: np.ndarray, cross: np.ndarray, alpha: float, coef: np.ndarray | None = None, max_iter: int = 10_000, tol: float = 1e-8) -> np.ndarray:
    """lasso() from x'x / n and x'y / n."""
    b = np.zeros(len(cross)) if coef is None else coef.copy()
    for _ in range(max_iter):
        most = 0.0
        for j in range(len(b)):
            if gram[j, j] <= 1e-300:
                continue
            z = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(z) * max(abs(z) - alpha, 0.0) / gram[j, j]
            most, b[j] = max(most, abs(new - b[j])), new
        if most < tol:
            break
    return b


def lasso_path(x: np.ndarray, y: np.ndarray, most: int = 500) -> list[tuple[float, np.ndarray]]:
    """(alpha, coefficients) at each knot of the lasso's path, from no coefficient on, by least-angle steps."""
    return path_gram(x.T @ x / len(y), x.T @ y / len(y), len(y), most)


def path_gram(gram: np.ndarray, cross: np.ndarray, n: int, most: int = 500) -> list[tuple[float, np.ndarray]]:
    """lasso_path() from x'x / n and x'y / n."""
    p = len(cross)
    b, alpha = np.zeros(p), float(np.abs(cross).max(initial=0))
    path, active, left = [(alpha, b.copy())], [], -1
    while alpha > 1e-12 and len(path) < most:
        size = np.abs(cross)
        level = [j for j in range(p) if j not in active and j != left and size[j] >= alpha * (1 - 1e-10)]
        if level and len(active) < min(n - 1, p):
            active.append(min(level))
        if not active:
            break
        sign = np.sign(cross[active])
        way = np.linalg.lstsq(gram[np.ix_(active, active)], sign, rcond=None)[0]
        turn = gram[:, active] @ way
        step, left = alpha, -1
        for j in range(p):
            if j not in active and len(active) < min(n - 1, p):
                for top, bottom in ((alpha - cross[j], 1 - turn[j]), (alpha + cross[j], 1 + turn[j])):
                    if bottom > 1e-12 and 1e-14 < top / bottom < step:
                        step = top / bottom
        for j, d in zip(active, way, strict=True):
            if d * b[j] < 0 and 1e-14 < -b[j] / d < step:
                step, left = -b[j] / d, j
        b[active] += step * way
        cross, alpha = cross - step * turn, alpha - step
        if left >= 0:
            b[left] = 0.0
            active.remove(left)
        path.append((max(alpha, 0.0), b.copy()))
    return path


def lasso_ic(x: np.ndarray, y: np.ndarray, criterion: str = "bic") -> tuple[np.ndarray, float]:
    """The knot of the path that the information criterion likes best (df: nonzero coefficients).

    The noise's variance is that of the least-squares fit on all columns; where there are too few
    rows for one, the knot's own.
    """
    return lasso_ic_gram(x.T @ x, x.T @ y, float(y @ y), len(y), criterion)[:2]


def lasso_ic_gram(square: np.ndarray, cross: np.ndarray, yy: float, n: int, criterion: str = "bic", whole: bool = True) -> tuple[np.ndarray, float, list[tuple[float, np.ndarray]]]:
    """lasso_ic() from x'x, x'y and y'y, and the path up to the chosen knot.

    whole: the columns are all there are; of some only, each knot's own noise counts.
    """
    p = len(cross)
    cost = np.log(n) if criterion == "bic" else 2.0
    noise = 0.0
    if whole and n > p + 1 and p:
        noise = max(yy - float(cross @ np.linalg.lstsq(square, cross, rcond=None)[0]), 0.0) / (n - p - 1)
    best, kept, last = np.inf, (np.zeros(p), 0.0), 0
    path = path_gram(square / n, cross / n, n)
    for i, (alpha, b) in enumerate(path):
        rss = max(yy - 2 * float(b @ cross) + float(b @ square @ b), 0.0)
        misfit = n * np.log(2 * np.pi * noise) + rss / noise if noise > 1e-300 else n * np.log(max(rss / n, 1e-300))
        value = misfit + cost * np.count_nonzero(np.abs(b) > 1e-15)
        if value < best:
            best, kept, last = value, (b, alpha), i
    return *kept, path[: last + 1]


def log_gaussian(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of each row of x."""
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mean).T)
    return -0.5 * ((z**2).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def kmeans(x: np.ndarray, k: int, seed: int = 42, turns: int = 50) -> np.ndarray:
    """Labels; centres start far from each other."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        away = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=away / away.sum()) if away.sum() > 0 else rng.integers(len(x))])
    centres = np.array(centres)
    labels = np.zeros(len(x), int)
    for _ in range(turns):
        new = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if (new == labels).all() and _:
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                centres[j] = x[labels == j].mean(0)
    return labels
