"""Directed influence: nearest-neighbour transfer entropy, mutual information, their significance.

A pair's kernel is numpy on two series. The returns panel is gathered once per series (a row with its
bars and returns); blocks of such rows are dealt to the tasks, which go through the pairs of a block
of sources and a block of targets. So a series is shuffled once for each block, and not for each of
its pairs.

Long series are searched by an index of the target's histories, and a pair's points are dealt to
pieces: a task sums over the points of some cells, and Spark adds the sums. Surrogates and
resamples are dealt to pieces too: each draw is a row, drawn from a seed of its pair and number, and
means, shares and percentiles are Spark's aggregates over them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.neighbours import Cells, max_norm, within
from panelflow.functions.numeric import digamma_table
from panelflow.operators.pairs import lagged_correlation
from panelflow.sources import store

LAGS = [1, 2, 3, 5, 10, 20]
#: Series of a block at most: a group has the pairs of two blocks.
BLOCK_SERIES = 128
# How long an influence lasts, from the shortest, and the sign of the lagged correlation.
HFT, NEXT_DAY, SHORT, SWING, SLOW = "HFT only", "Next-day tradable", "Short-term", "Swing (tradable)", "Slow decay (tradable)"
SAME, INVERSE = "same", "inverse"
#: Points up to which all distances are computed at once, and kept for the next source; beyond, cells are searched.
BLOCK = 512
#: Points of a pair, and draws, that a task takes at a time.
PIECE_POINTS, PIECE_DRAWS = 4096, 25


def embed(source: np.ndarray, target: np.ndarray, lag: int, history: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(future, target's history, source's history) at the times from `history` on."""
    t = np.arange(history, len(target) - lag)
    back = np.arange(history)
    return target[t + lag][:, None], target[t[:, None] - back], source[t[:, None] - back]


def _paired(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.isfinite(source) & np.isfinite(target)
    return source[both], target[both]


class Targets:
    """What the next sources need again of the target met last: all its distances, or its cells."""

    def __init__(self):
        self.held: dict[int, tuple] = {}

    def get(self, future: np.ndarray, own: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray] | Cells:
        """Of up to `BLOCK` points: the distances of the own histories, and of those with the futures."""
        key = future.tobytes() + own.tobytes()
        found = self.held.get(lag)
        if found is None or found[0] != key:
            if len(own) > BLOCK:
                found = (key, Cells(own))
            else:
                d_own = max_norm(own, own)
                found = (key, (d_own, np.maximum(max_norm(future, future), d_own)))
            self.held[lag] = found
        return found[1]


def _mine(n: int, piece: int, pieces: int) -> range:
    return range(n * piece // pieces, n * (piece + 1) // pieces)


def entropy_terms(source: np.ndarray, target: np.ndarray, lag: int = 1, k: int = 5, history: int = 3, noise: float = 1e-8, targets: Targets | None = None, piece: int = 0, pieces: int = 1) -> tuple[float, int]:
    """The sum of the points' terms, and how many points there are (0: series too short); of a piece's points, if there are several."""
    source, target = _paired(source, target)
    least = max(50, 3 * k)
    if len(source) < least:
        return 0.0, 0
    future, own, other = embed(source, target, lag, history)
    n = len(future)
    if n < least:
        return 0.0, 0
    if noise:
        jitter = np.random.default_rng(0).normal(0.0, noise, (n, 1 + 2 * history))
        future, own, other = future + jitter[:, :1], own + jitter[:, 1 : 1 + history], other + jitter[:, 1 + history :]
    psi, held = digamma_table(n + 1), (targets or Targets()).get(future, own, lag)

    def terms(d_own, d_future, d_other, radius) -> float:
        radius = radius[:, None] - 1e-15
        count = lambda d: psi[np.maximum((d <= radius).sum(1), 1)]
        return float((count(d_own) - count(d_future) - count(d_other)).sum())

    if isinstance(held, Cells):
        total, size = 0.0, 0
        cells = _mine(len(held), piece, pieces)
        for rows, some, d, radius in held.searched(np.column_stack([future, other]), k, cells):
            total += terms(d, np.maximum(d, max_norm(future[rows], future[some])), np.maximum(d, max_norm(other[rows], other[some])), radius)
            size += len(rows)
        return total, size
    part = slice((mine := _mine(n, piece, pieces)).start, mine.stop)
    d_own, d_future = (d[part] for d in held)
    d_other = np.maximum(max_norm(other[part], other), d_own)
    radius = np.partition(np.maximum(d_future, d_other), k, axis=1)[:, k]
    return terms(d_own, d_future, d_other, radius), len(d_own)


def transfer_entropy(source: np.ndarray, target: np.ndarray, lag: int = 1, k: int = 5, history: int = 3, noise: float = 1e-8, targets: Targets | None = None) -> float:
    """How much the source's history tells of the target's future beyond the target's own, in nats.

    Counts include the point itself; the radius is the distance to the k-th neighbour in the joint
    space less 1e-15. 0 for series too short. noise: standard deviation of seeded jitter.
    """
    total, n = entropy_terms(source, target, lag, k, history, noise, targets)
    return max(0.0, float(digamma_table(k + 1)[k] + total / n)) if n else 0.0


def information_terms(x: np.ndarray, y: np.ndarray, k: int = 5, noise: float = 1e-8, strict: bool = False, piece: int = 0, pieces: int = 1) -> tuple[float, int, int]:
    """The sum of the points' terms and the number of a piece's points, and of all (0: series too short)."""
    x, y = _paired(x, y)
    n = len(x)
    if n < max(20, 2 * k):
        return 0.0, 0, 0
    if noise:
        rng = np.random.default_rng(0)
        x, y = x + rng.normal(0, noise, n), y + rng.normal(0, noise, n)
    psi, more = digamma_table(n + 2), 0 if strict else 1
    cells, radius, rows = Cells(x[:, None]), np.empty(n), []
    for own, _, _, r in cells.searched(y[:, None], k, _mine(len(cells), piece, pieces)):
        radius[own] = r - 1e-15
        rows.append(own)
    rows = np.sort(np.concatenate(rows)) if rows else np.zeros(0, int)
    counts = [np.maximum(within(v, v[rows], radius[rows]), 1) + more for v in (x, y)]
    return float((psi[counts[0]] + psi[counts[1]]).sum()), len(rows), n


def information_of(total: float, n: int, k: int) -> float:
    psi = digamma_table(n + 2)
    return max(0.0, float(psi[k] - total / n + psi[n])) if n else 0.0


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 5, noise: float = 1e-8, strict: bool = False) -> float:
    """Nearest-neighbour mutual information, in nats; strict: counts as in the published estimator."""
    total, _, n = information_terms(x, y, k, noise, strict)
    return information_of(total, n, k)


def lagged(x: np.ndarray, y: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """x now beside y `lag` steps on; a negative lag looks back; nothing if the lag is too long."""
    if abs(lag) >= len(x):
        return x[:0], y[:0]
    return (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])


def lagged_information(x: np.ndarray, y: np.ndarray, lag: int, **options) -> float:
    """Information of x now about y `lag` steps on; 0 if the lag is too long."""
    return mutual_information(*lagged(x, y, lag), **options)


# -- draws ------------------------------------------------------------------------------------------


def seed_of(source: str, target: str, draw: int, seed: int = 0) -> int:
    """The number behind one draw of a pair: the first 48 bits of the MD5 of its names and number."""
    return int(hashlib.md5(f"{seed}:{source}>{target}:{draw}".encode()).hexdigest()[:12], 16)


def shift_of(n: int, lag: int, history: int, number: int) -> int:
    """A circular shift that parts a surrogate from the series by more than its memory."""
    least = max(2 * history + lag + 1, 10)
    return least + number % (max(least + 1, n - least) - least)


def drawn(source: np.ndarray, method: str, number: int, lag: int = 1, history: int = 3, block: int = 10) -> np.ndarray:
    """A surrogate or resample of the source: "shift", "bootstrap" (in blocks), "shuffle" or "phase"."""
    n = len(source)
    if method == "shift":
        return np.roll(source, shift_of(n, lag, history, number))
    rng = np.random.default_rng(number)
    if method == "bootstrap":
        starts = rng.integers(0, max(n - block + 1, 1), -(-n // block))
        return source[(starts[:, None] + np.arange(block)).ravel()[:n] % n]
    if method == "shuffle":
        return rng.permutation(source)
    if method != "phase":
        raise ValueError(f"no surrogate method {method}")
    turn = np.exp(1j * rng.uniform(0, 2 * np.pi, n // 2 + 1))
    turn[0] = 1
    return np.fft.irfft(np.fft.rfft(source) * turn, n)


def drawn_entropies(source: np.ndarray, target: np.ndarray, method: str, lag: int, count: int, k: int = 5, history: int = 3, noise: float = 1e-8, block: int = 10, names: tuple[str, str] = ("", ""), seed: int = 0) -> tuple[float, np.ndarray]:
    """The pair's entropy and those of its draws, one after the other: what draws() spreads over tasks."""
    held = Targets()
    raw = transfer_entropy(source, target, lag, k, history, noise, held)
    return raw, np.array([transfer_entropy(drawn(source, method, seed_of(*names, i, seed), lag, history, block), target, lag, k, history, noise, held) for i in range(count)])


def effective_entropy(source: np.ndarray, target: np.ndarray, lag: int = 1, k: int = 5, history: int = 3, surrogates: int = 50, noise: float = 1e-8, **drawing) -> tuple[float, float, float]:
    """(raw, effective, p): raw less the mean of circularly shifted sources, and their share not below raw."""
    raw, found = drawn_entropies(source, target, "shift", lag, surrogates, k, history, noise, **drawing)
    return raw, max(0.0, raw - float(found.mean())), float((found >= raw).mean())


def best_lag(source: np.ndarray, target: np.ndarray, lags: list[int], k: int = 5, history: int = 3, surrogates: int = 30, noise: float = 1e-8, **drawing) -> dict:
    """The lag of most effective entropy (the first of equals), and how the halves agree on it."""
    found = {lag: effective_entropy(source, target, lag, k, history, surrogates, noise, **drawing) for lag in lags}
    best = max(lags, key=lambda lag: (found[lag][1], -lags.index(lag)))
    half, spread = len(source) // 2, float("nan")
    if half >= max(50, 3 * k):
        a, b = (transfer_entropy(source[s], target[s], best, k, history, noise) for s in (slice(0, half), slice(half, None)))
        if (a + b) / 2 > 1e-10:
            spread = abs(a - b) / (a + b)
    return {"best_lag": best, "te_effective": found[best][1], "p_value": found[best][2], "stability_cv": spread, "all_lags": {lag: x[1] for lag, x in found.items()}}


def bootstrap_significance(source: np.ndarray, target: np.ndarray, lag: int = 1, count: int = 1000, block: int = 10, alpha: float = 0.05, **options) -> dict:
    """The source resampled in blocks: how often it does as well, and the percentiles it reaches."""
    raw, found = drawn_entropies(source, target, "bootstrap", lag, count, block=block, **options)
    p = float((found >= raw).mean())
    return {"te": raw, "p_value": p, "low": float(np.percentile(found, 100 * alpha / 2)), "high": float(np.percentile(found, 100 * (1 - alpha / 2))), "significant": p < alpha}


def surrogate_significance(source: np.ndarray, target: np.ndarray, lag: int = 1, count: int = 1000, method: str = "shuffle", **options) -> dict:
    """The source shuffled, or with its Fourier phases drawn anew."""
    raw, found = drawn_entropies(source, target, method, lag, count, **options)
    return {"te": raw, "p_value": float((found >= raw).mean()), "mean": float(found.mean()), "std": float(found.std())}


def gathered(returns: DataFrame, *keys: str) -> DataFrame:
    """A row for each series (and key): its bars and returns in order. A series' length is a calendar's."""
    rows = F.array_sort(F.collect_list(F.struct("bar", "ret")))
    return returns.groupBy(*keys, "series").agg(rows.alias("r")).select(*keys, "series", F.col("r.bar").alias("bars"), F.col("r.ret").alias("rets"))


def on_pairs(returns: DataFrame, kernel: Callable[..., list[tuple]], columns: str, pairs: DataFrame | None = None, targets: list[str] | None = None, keys: tuple[str, ...] = (), pieces: int = 1, first: int = 0) -> DataFrame:
    """kernel(source, target, piece, names) of each ordered pair of different series, on its common bars.

    Gives (keys, source, target, columns). Series are dealt to blocks, and a group is a piece of the
    pairs of a block of sources with a block of targets: a series is shuffled once for each block and
    piece, not for each pair. Blocks are of BLOCK_SERIES at most, so a group's rows don't grow with the panel.
    pairs: (source, target) to restrict to; targets: names to restrict to; keys: panels apart;
    pieces: how many there are, from number `first` on.
    """
    rows = gathered(returns, *keys)
    names = returns.select("series").distinct().count()
    at_once = 2 * returns.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(math.sqrt(at_once / pieces)), -(-names // BLOCK_SERIES))
    every = lambda n, start=0: F.explode(F.sequence(F.lit(start), F.lit(start + n - 1)))
    own = F.pmod(F.xxhash64("series"), F.lit(blocks)).cast("int")
    right = rows.where(F.col("series").isin(targets)) if targets is not None else rows
    if pairs is not None:
        only = pairs.groupBy(F.col("source").alias("series")).agg(F.collect_set("target").alias("only"))
        left = rows.join(only, "series")
    else:
        left = rows.withColumn("only", F.lit(None).cast("array<string>"))
    left = left.select(*keys, own.alias("i"), every(blocks).alias("j"), "series", "bars", "rets", "only").withColumn("piece", every(pieces, first))
    right = right.select(*keys, every(blocks).alias("i"), own.alias("j"), "series", "bars", "rets").withColumn("piece", every(pieces, first))
    right = right.toDF(*right.columns)
    fields = [c.strip().split(" ")[0] for c in columns.split(", ")]

    def run(sources: pd.DataFrame, sinks: pd.DataFrame) -> pd.DataFrame:
        out = []
        allowed_of = [None if only is None else set(only) for only in sources["only"]]
        for t in sinks.itertuples(index=False):
            head = [getattr(t, k) for k in keys]
            for s, allowed in zip(sources.itertuples(index=False), allowed_of, strict=True):
                if s.series == t.series or (allowed is not None and t.series not in allowed):
                    continue
                _, i, j = np.intersect1d(np.asarray(s.bars), np.asarray(t.bars), assume_unique=True, return_indices=True)
                found = kernel(np.asarray(s.rets, float)[i], np.asarray(t.rets, float)[j], t.piece, (s.series, t.series))
                out += [[*head, s.series, t.series, *x] for x in found]
        return pd.DataFrame(out, columns=[*keys, "source", "target", *fields])

    schema = ", ".join([*(f"{k} {returns.schema[k].dataType.simpleString()}" for k in keys), "source string, target string", columns])
    group = [*keys, "i", "j", "piece"]
    # the work is in the kernels, not in the few rows: partitions are not to be joined for their small size
    tasks = min(blocks * blocks * pieces, 2 * at_once)
    return left.repartition(tasks, *group).groupBy(*group).cogroup(right.repartition(tasks, *group).groupBy(*group)).applyInPandas(run, schema)


def pieces_for(returns: DataFrame, keys: tuple[str, ...] = ()) -> int:
    """Pieces of a pair's points, by the longest series."""
    longest = returns.groupBy(*keys, "series").count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-longest // PIECE_POINTS))


def on_targets(returns: DataFrame, fit: Callable[[list[str], np.ndarray, int], pd.DataFrame], schema: str, targets: list[str] | None = None) -> DataFrame:
    """fit(names, x, i) for each target names[i]; x has a column for each series (in name order) and a row for each common bar.

    Targets are dealt to blocks and the panel is sent once to each block, not to each target; there
    are no more blocks than tasks that can run at a time, twice over.
    """
    blocks = 2 * returns.sparkSession.sparkContext.defaultParallelism
    own = F.pmod(F.xxhash64("series"), F.lit(blocks)).cast("int")
    mine = own == F.col("block")
    if targets is not None:
        mine = mine & F.col("series").isin(targets)
    rows = gathered(returns).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("mine", mine)
    used = rows.where("mine").select("block").distinct()
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("series")
        bars = np.asarray(pdf["bars"].iloc[0])
        for other in pdf["bars"]:
            bars = np.intersect1d(bars, other, assume_unique=True)
        x = np.column_stack([np.asarray(r, float)[np.isin(b, bars, assume_unique=True)] for b, r in zip(pdf["bars"], pdf["rets"], strict=True)])
        found = [fit(list(pdf["series"]), x, i) for i in np.flatnonzero(pdf["mine"])]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    return rows.join(used, "block", "left_semi").repartition(blocks, "block").groupBy("block").applyInPandas(run, schema)


def entropy_matrix(returns: DataFrame, lags: list[int] | None = None, k: int = 5, history: int = 3, noise: float = 1e-8, pairs: DataFrame | None = None, targets: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, source, target, lag, te) of all ordered pairs; apply `panel.covered` first."""
    lags, held, pieces = lags or LAGS, Targets(), pieces_for(returns, keys)

    def kernel(source, target, piece, names):
        return [(lag, *entropy_terms(source, target, lag, k, history, noise, held, piece, pieces)) for lag in lags]

    terms = on_pairs(returns, kernel, "lag int, total double, n long", pairs, targets, keys, pieces)
    te = F.when(F.sum("n") > 0, F.greatest(F.lit(0.0), F.lit(float(digamma_table(k + 1)[k])) + F.sum("total") / F.sum("n"))).otherwise(0.0)
    return terms.groupBy(*keys, "source", "target", "lag").agg(te.alias("te"))


def information_matrix(returns: DataFrame, lags: list[int] | None = None, k: int = 5, noise: float = 1e-8, strict: bool = False) -> DataFrame:
    """(source, target, lag, mi) of all ordered pairs."""
    lags, pieces = lags or LAGS, pieces_for(returns)

    def kernel(source, target, piece, names):
        out = []
        for lag in lags:
            total, _, n = information_terms(*lagged(source, target, lag), k, noise, strict, piece, pieces)
            psi = digamma_table(n + 2)
            out.append((lag, total, n, float(psi[k] + psi[n]) if n else 0.0))
        return out

    terms = on_pairs(returns, kernel, "lag int, total double, n long, level double", pieces=pieces)
    mi = F.when(F.max("n") > 0, F.greatest(F.lit(0.0), F.max("level") - F.sum("total") / F.max("n"))).otherwise(0.0)
    return terms.groupBy("source", "target", "lag").agg(mi.alias("mi"))


def draws(returns: DataFrame, method: str, lags: list[int], count: int, k: int = 5, history: int = 3, noise: float = 1e-8, block: int = 10, pairs: DataFrame | None = None, targets: list[str] | None = None, seed: int = 0, first: int = 0) -> DataFrame:
    """(source, target, lag, draw, te): the entropies of `count` draws of each pair, from number `first` on, a row each.

    Draw -1, of piece 0 only, is the series as it is. A draw depends on its pair's names and its number alone.
    """
    drawn(np.zeros(4), method, 0)  # an unknown method is refused at once
    held = Targets()

    def kernel(source, target, piece, names):
        numbers = range(max(first, piece * PIECE_DRAWS), min(first + count, (piece + 1) * PIECE_DRAWS))
        out = [(lag, -1, transfer_entropy(source, target, lag, k, history, noise, held)) for lag in lags if piece == 0]
        for i in numbers:
            number = seed_of(*names, i, seed)
            out += [(lag, i, transfer_entropy(drawn(source, method, number, lag, history, block), target, lag, k, history, noise, held)) for lag in lags]
        return out

    begin = first // PIECE_DRAWS
    pieces = max(1, -(-(first + count) // PIECE_DRAWS) - begin)
    return on_pairs(returns, kernel, "lag int, draw int, te double", pairs, targets, pieces=pieces, first=begin)


def compared(rows: DataFrame) -> DataFrame:
    """Each draw of draws() beside its pair's own entropy: (source, target, lag, draw, drawn, te)."""
    own = F.max(F.when(F.col("draw") < 0, F.col("te"))).over(Window.partitionBy("source", "target", "lag"))
    return rows.select("source", "target", "lag", "draw", F.col("te").alias("drawn"), own.alias("te")).where("draw >= 0")


def share():
    """The share of draws that reach the pair's own entropy."""
    return F.avg((F.col("drawn") >= F.col("te")).cast("double"))


def effective_matrix(returns: DataFrame, lag: int = 1, k: int = 5, history: int = 3, surrogates: int = 50, noise: float = 1e-8, lags: list[int] | None = None, targets: list[str] | None = None) -> DataFrame:
    """(source, target, lag, te, te_effective, p_value): raw, raw less the mean of circularly shifted sources, their share not below raw."""
    rows = compared(draws(returns, "shift", lags or [lag], surrogates, k, history, noise, targets=targets))
    effective = F.greatest(F.lit(0.0), F.first("te") - F.avg("drawn"))
    return rows.groupBy("source", "target", "lag").agg(F.first("te").alias("te"), effective.alias("te_effective"), share().alias("p_value"))


def variable_lags(returns: DataFrame, lags: list[int] | None = None, targets: list[str] | None = None, k: int = 5, history: int = 3, surrogates: int = 30, noise: float = 1e-8) -> DataFrame:
    """(source, target, best_lag, te_effective, p_value, stability_cv, all_lags).

    The lag of most effective entropy, the first in order of equals; stability_cv: how far the halves of
    the pair's bars differ there (null where they are too short or tell nothing).
    """
    lags = lags or [1, 2, 3, 5, 10]
    found = effective_matrix(returns, k=k, history=history, surrogates=surrogates, noise=noise, lags=lags, targets=targets)
    place = F.element_at(F.create_map(*[F.lit(x) for i, lag in enumerate(lags) for x in (lag, i)]), F.col("lag"))
    order = F.struct(-F.col("te_effective"), place)
    every = F.map_from_entries(F.array_sort(F.collect_list(F.struct("lag", "te_effective"))))
    best = found.groupBy("source", "target").agg(F.min_by(F.struct("lag", "te_effective", "p_value"), order).alias("b"), every.alias("all_lags"))
    held = Targets()

    def halves(source, target, piece, names):
        half = len(source) // 2
        if half < max(50, 3 * k):
            return []
        return [(lag, *(transfer_entropy(source[s], target[s], lag, k, history, noise, held) for s in (slice(0, half), slice(half, None)))) for lag in lags]

    parts = on_pairs(returns, halves, "lag int, a double, b double", None, targets)
    spread = F.when((F.col("a") + F.col("b")) / 2 > 1e-10, F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b")))
    out = best.select("source", "target", F.col("b.lag").alias("lag"), F.col("b.te_effective").alias("te_effective"), F.col("b.p_value").alias("p_value"), "all_lags")
    out = out.join(parts, ["source", "target", "lag"], "left")
    return out.select("source", "target", F.col("lag").alias("best_lag"), "te_effective", "p_value", spread.alias("stability_cv"), "all_lags")


def significance(returns: DataFrame, method: str = "bootstrap", lag: int = 1, count: int = 1000, pairs: DataFrame | None = None, alpha: float = 0.05, stop: int | None = None, **options) -> DataFrame:
    """(source, target, te, p_value, low, high, significant, draws) or, of surrogates, (…, te, p_value, mean, std, draws).

    stop: a pair gets no more draws once this many of them reach its own entropy (then it can't be
    significant); its p_value is the share among the draws up to the last of these, as sequential
    Monte Carlo tests have it. Each round trebles the draws of the pairs that are left.
    """
    if stop is None:
        rows = compared(draws(returns, method, [lag], count, pairs=pairs, **options))
        return _summary(rows, method, alpha)
    folder, done = store.scratch(returns.sparkSession), min(count, max(4 * stop, PIECE_DRAWS))
    rows = store.kept(draws(returns, method, [lag], done, pairs=pairs, **options), folder, "draws0")
    while done < count:
        reached = compared(rows).groupBy("source", "target").agg(F.count_if(F.col("drawn") >= F.col("te")).alias("reached"))
        left = store.kept(reached.where(F.col("reached") < stop).select("source", "target"), folder, f"left{done}")
        if left.isEmpty():
            break
        more = min(count, 3 * done) - done
        rows = rows.union(store.kept(draws(returns, method, [lag], more, pairs=left, first=done, **options), folder, f"draws{done}"))
        done += more
    ordered = Window.partitionBy("source", "target").orderBy("draw")
    before = F.count_if(F.col("drawn") >= F.col("te")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return _summary(compared(rows).withColumn("before", before).where(F.col("before") < stop), method, alpha)


def _summary(rows: DataFrame, method: str, alpha: float) -> DataFrame:
    grouped, te = rows.groupBy("source", "target"), F.first("te").alias("te")
    if method == "bootstrap":
        ends = [F.percentile("drawn", F.lit(q)).alias(n) for n, q in (("low", alpha / 2), ("high", 1 - alpha / 2))]
        return grouped.agg(te, share().alias("p_value"), *ends, (share() < alpha).alias("significant"), F.count(F.lit(1)).alias("draws"))
    return grouped.agg(te, share().alias("p_value"), F.avg("drawn").alias("mean"), F.stddev_pop("drawn").alias("std"), F.count(F.lit(1)).alias("draws"))


def decay(edges: DataFrame, correlations: DataFrame) -> DataFrame:
    """What becomes of each pair's entropy along the lags: (…, te_norm, half_life, category, direction, lagged_corr).

    half_life: the first lag after the first whose entropy is below half the first's, else the last lag.
    """
    pair = Window.partitionBy("source", "target")
    ordered = pair.orderBy("lag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = edges.withColumns({"first_te": F.first("te").over(ordered), "first_lag": F.first("lag").over(ordered), "last_lag": F.last("lag").over(ordered)})
    rows = rows.withColumn("te_norm", F.col("te") / F.greatest("first_te", F.lit(1e-10)))
    below = F.when((F.col("lag") > F.col("first_lag")) & (F.col("te") < F.col("first_te") * 0.5), F.col("lag"))
    rows = rows.withColumn("half_life", F.coalesce(F.min(below).over(pair), F.col("last_lag")))
    rows = rows.withColumn("kept", F.coalesce(F.max(F.when(F.col("lag") == 2, F.col("te_norm"))).over(pair), F.lit(0.0)))
    category = F.when(F.col("half_life") <= 1, HFT).when((F.col("half_life") <= 3) & (F.col("kept") >= 0.30), NEXT_DAY).when(F.col("half_life") <= 3, SHORT).when(F.col("half_life") <= 10, SWING).otherwise(SLOW)
    corr = correlations.where("lag = 1").select("source", "target", F.col("corr").alias("lagged_corr"))
    rows = rows.join(corr, ["source", "target"], "left").withColumn("lagged_corr", F.coalesce("lagged_corr", F.lit(0.0)))
    direction = F.when(F.col("lagged_corr") >= 0, SAME).otherwise(INVERSE)
    return rows.select("source", "target", "lag", "te", "te_norm", "half_life", category.alias("category"), direction.alias("direction"), "lagged_corr")


def entropy_decay(returns: DataFrame, pairs: DataFrame, lags: list[int] | None = None, k: int = 5, history: int = 3, noise: float = 1e-8) -> DataFrame:
    """decay() of chosen pairs (source, target), computed from the panel."""
    edges = entropy_matrix(returns, lags, k, history, noise, pairs.select("source", "target"))
    return decay(edges, lagged_correlation(returns, [1]))


def regime_entropy(returns: DataFrame, regimes: DataFrame, lags: list[int] | None = None, least_bars: int = 120, measure: Callable[..., DataFrame] | None = None, **options) -> DataFrame:
    """(regime, source, target, lag, te) of each regime's bars; regimes of fewer bars than least_bars are left out.

    measure: another function (returns, lags=…, keys=…) giving tidy edges.
    """
    enough = regimes.groupBy("regime").count().where(F.col("count") >= least_bars).select("regime")
    labelled = returns.join(regimes.join(enough, "regime").select("bar", "regime"), "bar")
    return (measure or entropy_matrix)(labelled, lags=lags or [1], keys=("regime",), **options)
