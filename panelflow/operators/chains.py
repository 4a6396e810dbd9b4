"""Hidden Markov chains over long panels, as Spark jobs over blocks of bars: regressions in regimes, and best paths.

Bars are packed into blocks of BLOCK_BARS, a row each, once; no group or task holds a panel's bars.
A round of the expectation has two passes over the blocks: the first sums up each block by one
small matrix over the states (functions.scans), the driver joins these in order, and the second gets
each block's states before and after it and gives the sums that the maximisation needs: weights,
moments and pairs of states. Spark adds them up. Best paths are found in the same way, with
max-plus products, and recovered block by block. The driver holds a matrix for each block, the
moments and the parameters of each panel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import scans
from panelflow.functions.numeric import kmeans, log_gaussian
from panelflow.functions.prefix import ordinals
from panelflow.sources import store

BLOCK_BARS = 4096
#: Bars at most from which the first weights are learned: every m-th of a longer panel's.
FIRST_BARS = 20_000
BLOCK = "{key}, block long, bars binary, own binary, data binary, width int"


def packed(rows: DataFrame, key: str, folder: str, before: int = 0, block_bars: int | None = None, name: str = "blocks") -> DataFrame:
    """(key, block, bars, own, data, width): rows (key, bar, x array<double>) of each panel in blocks, written.

    before: how many bars before a block go along at its front (own is false for them).
    """
    block_bars = block_bars or BLOCK_BARS
    kind = rows.schema[key].dataType.simpleString()
    placed = ordinals(rows, "bar", (key,), "pos")
    home = placed.select(key, "bar", "x", F.floor(F.col("pos") / block_bars).alias("block"), F.lit(True).alias("own"))
    every = home
    if before:
        last = placed.where(F.col("pos") % block_bars >= block_bars - before)
        every = home.union(last.select(key, "bar", "x", (F.floor(F.col("pos") / block_bars) + 1).alias("block"), F.lit(False).alias("own")))

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bar").to_numpy(), kind="stable")
        x = table.column("x").combine_chunks()
        data = x.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        own = table.column("own").to_numpy()[order]
        if not own.any():  # what stands before a block that isn't there
            return table.select([key, "block"]).slice(0, 0).append_column("bars", pa.array([], pa.binary())).append_column("own", pa.array([], pa.binary())).append_column("data", pa.array([], pa.binary())).append_column("width", pa.array([], pa.int32()))
        columns = [table.column(key)[:1], table.column("block")[:1], *[pa.array([b], pa.binary()) for b in (table.column("bar").to_numpy()[order].astype(np.int64).tobytes(), own.tobytes(), np.ascontiguousarray(data, float).tobytes())], pa.array([data.shape[1]], pa.int32())]
        return pa.table(columns, names=[key, "block", "bars", "own", "data", "width"])

    return store.kept(every.groupBy(key, "block").applyInArrow(pack, BLOCK.format(key=f"{key} {kind}")), folder, name)


@dataclass
class Piece:
    key: object
    block: int
    bars: np.ndarray
    data: np.ndarray
    own: np.ndarray


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        for r in batch.to_pylist():
            bars = np.frombuffer(r["bars"], np.int64)
            yield Piece(next(iter(r.values())), r["block"], bars, np.frombuffer(r["data"]).reshape(len(bars), r["width"]), np.frombuffer(r["own"], bool))


class Blocks:
    """Packed panels, and passes over them. shape(piece) gives what the model sees of a block: (bars, points)."""

    def __init__(self, rows: DataFrame, key: str, shape: Callable[[Piece], tuple[np.ndarray, np.ndarray]]):
        self.rows, self.key, self.shape = rows, key, shape
        self.kind = rows.schema[key].dataType.simpleString()

    def mapped(self, f: Callable[[Piece, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
        """f(piece, bars, points) gives columns of equal length, for each block with a bar."""
        shape, names = self.shape, [self.key, *(c.strip().split(" ")[0] for c in schema.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                bars, z = shape(piece)
                if not len(bars):
                    continue
                found = f(piece, bars, z)
                n = len(next(iter(found.values())))
                yield pa.RecordBatch.from_arrays([pa.array([piece.key] * n), *(pa.array(found[c]) for c in names[1:])], names=names)

        return self.rows.mapInArrow(run, f"{self.key} {self.kind}, {schema}")

    def summed(self, f: Callable[[Piece, np.ndarray, np.ndarray], np.ndarray]) -> dict:
        """key -> the sum of f's numbers over the panel's blocks, added up by Spark."""
        found = self.mapped(lambda p, b, z: {"v": [f(p, b, z).tolist()]}, "v array<double>")
        rows = found.select(self.key, F.posexplode("v").alias("at", "v")).groupBy(self.key, "at").agg(F.sum("v").alias("v")).collect()
        out: dict = {}
        for r in rows:
            out.setdefault(r[0], {})[r["at"]] = r["v"]
        return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}

    def sample(self) -> dict:
        """key -> points, in order: all, or every m-th of a panel of more than FIRST_BARS."""
        sizes = {r[0]: r["n"] for r in self.mapped(lambda p, b, z: {"n": [len(b)]}, "n long").groupBy(self.key).agg(F.sum("n").alias("n")).collect()}
        every = {k: -(-n // FIRST_BARS) for k, n in sizes.items()}
        rows = self.mapped(lambda p, b, z: {"bar": b[:: every[p.key]], "z": list(z[:: every[p.key]])}, "bar long, z array<double>").collect()
        out: dict = {}
        for r in sorted(rows, key=lambda r: r["bar"]):
            out.setdefault(r[0], []).append(r["z"])
        return {k: np.array(v) for k, v in out.items()}


# -- parameters -------------------------------------------------------------------------------------


@dataclass
class Chain:
    """One panel's parameters: transitions, first states, and a regression (of y on x) with Gaussian errors in each state."""

    moves: np.ndarray
    start: np.ndarray
    coef: np.ndarray
    cov: np.ndarray
    inputs: int
    compat: bool = False
    loglik: float = -np.inf
    last: np.ndarray | None = None

    def density(self, z: np.ndarray) -> np.ndarray:
        x, y = z[:, : self.inputs], z[:, self.inputs :]
        out = np.stack([log_gaussian(y - x @ b, np.zeros(y.shape[1]), s) for b, s in zip(self.coef, self.cov, strict=True)], 1)
        return np.clip(out, -500, 0) if self.compat else out


def moments(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each state's sum of the points' outer products, by weight."""
    return np.stack([(z * w[:, None]).T @ z for w in weight.T])


def regressions(sums: np.ndarray, inputs: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and error covariances from moments() whose first coordinate is 1."""
    coef, cov = [], []
    for g in sums:
        xx, xy, yy = g[:inputs, :inputs], g[:inputs, inputs:], g[inputs:, inputs:]
        b = np.linalg.solve(xx + ridge * np.eye(inputs), xy) if ridge else xy / max(xx[0, 0], 1e-10)
        rest = yy - b.T @ xy - xy.T @ b + b.T @ xx @ b
        coef.append(b)
        cov.append((rest + rest.T) / 2 / max(g[0, 0], 1e-10) + 1e-6 * np.eye(len(yy)))
    return np.array(coef), np.array(cov)


def entering(chains: dict, products: dict[object, list[tuple[int, np.ndarray, float]]]) -> tuple[dict, dict, dict]:
    """For each (key, block): the states before it, and what follows it is worth; each panel's log likelihood.

    products: the blocks' matrices and the logs of their scales. The states before a panel's first
    block are told by `start` (its matrix has it in every row), so any will do.
    """
    before, after, total = {}, {}, {}
    for key, found in products.items():
        found = sorted(found, key=lambda f: f[0])
        p, level = np.full(len(chains[key].start), 1 / len(chains[key].start)), 0.0
        for block, m, log in found:
            before[key, block] = p
            p = p @ m
            level += log + float(np.log(p.sum()))
            p = p / p.sum()
        total[key], worth = level, np.ones(len(p))
        chains[key].last = p
        for block, m, _ in reversed(found):
            after[key, block] = worth
            worth = m @ worth
            worth = worth / worth.max()
    return before, after, total


def _logp(chain: Chain, piece: Piece, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Densities, and the matrices of the first bar and of the others; a panel's first bar comes from `start`, whatever was before."""
    first = np.tile(chain.start, (len(chain.start), 1)) if piece.block == 0 else chain.moves
    return chain.density(z), first, chain.moves


def _steps(chain: Chain, piece: Piece, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logp, first, moves = _logp(chain, piece, z)
    m, logs = scans.steps(moves, logp)
    one, log = scans.steps(first, logp[:1])
    m[0], logs[0] = one[0], log[0]
    return m, logs


def expected(blocks: Blocks, chains: dict) -> tuple[dict, dict, dict]:
    """entering() of the blocks' products."""

    def product(piece: Piece, bars: np.ndarray, z: np.ndarray) -> dict:
        m, log = scans.product(*_steps(chains[piece.key], piece, z))
        return {"block": [piece.block], "m": [m.ravel().tolist()], "log": [log]}

    found: dict = {}
    for r in blocks.mapped(product, "block long, m array<double>, log double").collect():
        found.setdefault(r[0], []).append((r["block"], np.array(r["m"]).reshape(len(chains[r[0]].start), -1), r["log"]))
    return entering(chains, found)


def block_states(chain: Chain, piece: Piece, z: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filtered, smoothed, pairs) of a block; pairs of the bar before the block and its first one are among them, but for the panel's first."""
    logp, first, moves = _logp(chain, piece, z)
    if piece.block:
        kept, smooth, joint, pairs = scans.smoothed(moves, logp, before, after)
        return kept, smooth, joint + pairs
    # the panel's first bar has no transition: its states are `start` as they are
    m, logs = _steps(chain, piece, z)
    ahead = before @ scans.prefixes(m, logs)[0]
    kept = ahead / ahead.sum(1, keepdims=True)
    if len(z) == 1:
        smooth = kept * after
        return kept, smooth / smooth.sum(1, keepdims=True), np.zeros_like(moves)
    rest, smooth, joint, pairs = scans.smoothed(moves, logp[1:], kept[0], after)
    return np.concatenate([kept[:1], rest]), np.concatenate([joint.sum(1)[None], smooth]), joint + pairs


def fitted(blocks: Blocks, inputs: int, regimes: int, max_iter: int, ridge: float, done: Callable[[int, float, float], bool], sure: float, features: Callable[[np.ndarray], np.ndarray], seed: int = 42, compat: bool = False, once_more: bool = False) -> dict:
    """key -> Chain, by expectation and maximisation, all panels side by side until each is done.

    The first weights give `sure` to the nearest of the k-means centres of features(points).
    once_more: a panel that is done is maximised a last time.
    """
    centres: dict = {}
    for key, z in blocks.sample().items():
        seen = features(z)
        labels = kmeans(seen, regimes, seed)
        centres[key] = np.array([seen[labels == r].mean(0) if (labels == r).any() else np.full(seen.shape[1], np.inf) for r in range(regimes)])
    moves = np.full((regimes, regimes), 0.1 / max(regimes - 1, 1))
    np.fill_diagonal(moves, 0.9)

    def first(piece: Piece, bars: np.ndarray, z: np.ndarray) -> np.ndarray:
        own = ((features(z)[:, None] - centres[piece.key]) ** 2).sum(2).argmin(1)
        return moments(z, np.where(own[:, None] == np.arange(regimes), sure, (1 - sure) / max(regimes - 1, 1))).ravel()

    def shaped(v: np.ndarray) -> np.ndarray:
        return v.reshape(regimes, int((len(v) // regimes) ** 0.5), -1)

    chains = {k: Chain(moves, np.full(regimes, 1 / regimes), *regressions(shaped(v), inputs, ridge), inputs, compat) for k, v in blocks.summed(first).items()}
    going, level = set(chains), dict.fromkeys(chains, -np.inf)
    for turn in range(max_iter):
        at, now = Blocks(blocks.rows.where(F.col(blocks.key).isin(list(going))), blocks.key, blocks.shape), {k: chains[k] for k in going}
        before, after, total = expected(at, now)
        still = {k for k in going if not done(turn, total[k], level[k])}
        for k in going:
            chains[k].loglik = total[k]
        level |= total
        again = going if once_more else still
        if not again:
            break

        def sums(piece: Piece, bars: np.ndarray, z: np.ndarray, now=now, before=before, after=after) -> np.ndarray:
            _, smooth, pairs = block_states(now[piece.key], piece, z, before[piece.key, piece.block], after[piece.key, piece.block])
            head = smooth[0] if piece.block == 0 else np.zeros(regimes)
            return np.concatenate([head, pairs.ravel(), moments(z, smooth).ravel()])

        for k, v in at.summed(sums).items():
            if k in again:
                head, pairs, rest = v[:regimes], v[regimes : regimes + regimes**2].reshape(regimes, -1) + 1e-10, v[regimes + regimes**2 :]
                head = np.maximum(head, 1e-10)
                chains[k] = Chain(pairs / pairs.sum(1, keepdims=True), head / head.sum(), *regressions(shaped(rest), inputs, ridge), inputs, compat, chains[k].loglik)
        going = still
    return chains


def probabilities(blocks: Blocks, chains: dict) -> DataFrame:
    """(key, bar, prob, smoothed): filtered and smoothed probabilities."""
    before, after, total = expected(blocks, chains)
    for k, v in total.items():
        chains[k].loglik = v

    def rows(piece: Piece, bars: np.ndarray, z: np.ndarray) -> dict:
        kept, smooth, _ = block_states(chains[piece.key], piece, z, before[piece.key, piece.block], after[piece.key, piece.block])
        return {"bar": bars, "prob": kept.tolist(), "smoothed": smooth.tolist()}

    return blocks.mapped(rows, "bar long, prob array<double>, smoothed array<double>")


def best_states(blocks: Blocks, chains: dict) -> DataFrame:
    """(key, bar, regime): the best path of each panel, the first of equals."""

    def scores(chain: Chain, piece: Piece, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logp = chain.density(z)
        return logp, np.log(chain.moves)

    def product(piece: Piece, bars: np.ndarray, z: np.ndarray) -> dict:
        chain = chains[piece.key]
        logp, move = scores(chain, piece, z)
        if piece.block == 0:
            m = np.tile(np.log(chain.start) + logp[0], (len(chain.start), 1))
            if len(z) > 1:
                m = (m[:, :, None] + scans.best_product(move, logp[1:])[None]).max(1)
        else:
            m = scans.best_product(move, logp)
        return {"block": [piece.block], "m": [m.ravel().tolist()]}

    found: dict = {}
    for r in blocks.mapped(product, "block long, m array<double>").collect():
        found.setdefault(r[0], []).append((r["block"], np.array(r["m"]).reshape(len(chains[r[0]].start), -1)))
    before, last = {}, {}
    for key, parts in found.items():
        best = np.zeros(len(chains[key].start))
        for block, m in sorted(parts, key=lambda p: p[0]):
            before[key, block] = best
            best = (best[:, None] + m).max(0)
        state = int(best.argmax())
        for block, m in sorted(parts, key=lambda p: -p[0]):
            last[key, block] = state
            state = int((before[key, block] + m[:, state]).argmax())

    def path(piece: Piece, bars: np.ndarray, z: np.ndarray) -> dict:
        chain = chains[piece.key]
        logp, move = scores(chain, piece, z)
        at, end = before[piece.key, piece.block], last[piece.key, piece.block]
        if piece.block == 0:
            found = scans.best_path(move, logp[1:], np.log(chain.start) + logp[0], end) if len(z) > 1 else np.array([end])
            if len(z) > 1:
                first = (np.log(chain.start) + logp[0] + move[:, found[0]]).argmax()
                found = np.concatenate([[first], found])
        else:
            found = scans.best_path(move, logp, at, end)
        return {"bar": bars, "regime": found.astype(np.int32)}

    return blocks.mapped(path, "bar long, regime int")


# -- what the models see ------------------------------------------------------------------------------


def wide(rows: DataFrame, key: str, name: str, value: str, fill: float | None) -> DataFrame:
    """(key, bar, x): a panel's values of each bar in the order of names; bars that lack one are filled or left out."""
    names = rows.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names"))
    cells = rows.groupBy(key, "bar").agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("m"))
    x = F.transform("names", lambda n: F.try_element_at("m", n))
    if fill is not None:
        return cells.join(names, key).select(key, "bar", F.transform(x, lambda v: F.coalesce(v, F.lit(float(fill)))).alias("x"))
    return cells.join(names, key).select(key, "bar", x.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def names_of(rows: DataFrame, key: str, name: str) -> dict:
    return {r[0]: r["names"] for r in rows.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")).collect()}


def points(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """A constant and the vector of each bar."""
    return piece.bars, np.column_stack([np.ones(len(piece.bars)), piece.data])


def lagged_points(lags: int) -> Callable[[Piece], tuple[np.ndarray, np.ndarray]]:
    """A constant, all series' values one bar before, two bars before and so on, and the bar's own."""

    def shape(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        x, n = piece.data, len(piece.data)
        if n <= lags:
            return piece.bars[:0], x[:0]
        return piece.bars[lags:], np.column_stack([np.ones(n - lags), *[x[lags - k : n - k] for k in range(1, lags + 1)], x[lags:]])

    return shape


def gaussian_blocks(features: DataFrame, key: str, folder: str, block_bars: int | None = None, name: str = "blocks") -> Blocks:
    """Blocks of features (key, bar, feature, value); bars that lack a feature are left out."""
    return Blocks(packed(wide(features, key, "feature", "value", None), key, folder, 0, block_bars, name), key, points)


def lagged_blocks(returns: DataFrame, key: str, lags: int, folder: str, block_bars: int | None = None) -> Blocks:
    """Blocks of returns (key, series, bar, ret) and what was before them; a missing return is 0."""
    if (block_bars or BLOCK_BARS) <= lags:
        raise ValueError("a block has more bars than there are lags")
    return Blocks(packed(wide(returns, key, "series", "ret", 0.0), key, folder, lags, block_bars), key, lagged_points(lags))


def gaussian_chains(blocks: Blocks, regimes: int = 2, max_iter: int = 200, tol: float = 1e-4, seed: int = 42) -> dict:
    """key -> Chain of Gaussian regimes; two are ordered by the trace of their covariance."""
    chains = fitted(blocks, 1, regimes, max_iter + 1, 0.0, lambda turn, total, last: turn > 0 and total - last < tol, 0.95, lambda z: z[:, 1:], seed)
    for chain in chains.values():
        if regimes == 2 and np.trace(chain.cov[0]) > np.trace(chain.cov[1]):
            chain.coef, chain.cov, chain.start, chain.moves = chain.coef[::-1], chain.cov[::-1], chain.start[::-1], chain.moves[::-1, ::-1]
    return chains


def switching_chains(blocks: Blocks, lags: int, regimes: int = 2, max_iter: int = 100, tol: float = 1e-6, seed: int = 42, compat: bool = False) -> dict:
    """key -> Chain of vector autoregressions."""

    def features(z: np.ndarray) -> np.ndarray:
        y = z[:, -((z.shape[1] - 1) // (lags + 1)) :]
        return np.column_stack([y, np.abs(y)])

    inputs = {p: 1 + (p - 1) // (lags + 1) * lags for p in {z.shape[1] for z in blocks.sample().values()}}
    if len(inputs) > 1:
        raise ValueError("panels fitted together have as many series")
    return fitted(blocks, next(iter(inputs.values()), 1), regimes, max_iter, 1e-6, lambda turn, total, last: turn > 5 and abs(total - last) < tol, 0.9, features, seed, compat, once_more=True)


def regime_moments(returns: DataFrame, regimes: DataFrame, lags: int, block_bars: int | None = None) -> DataFrame:
    """(regime, a, b, value): sums of products of the constant ("1"), the series ("0:name") and their lags ("k:name") over each regime's bars.

    What switching_chains() maximises from, with labels (bar, regime) in place of probabilities.
    """
    key, folder = "panel", store.scratch(returns.sparkSession)
    rows = wide(returns.withColumn(key, F.lit("all")), key, "series", "ret", 0.0)
    labels = [r[0] for r in regimes.select("regime").distinct().orderBy("regime").collect()]
    rows = rows.join(regimes.select("bar", "regime"), "bar", "left").withColumn("x", F.concat("x", F.array(F.col("regime").cast("double")))).select(key, "bar", "x")
    names = names_of(returns.withColumn(key, F.lit("all")), key, "series").get("all", [])
    seen = lagged_points(lags)
    columns = ["1", *(f"{k}:{s}" for k in (*range(1, lags + 1), 0) for s in names)]

    def shape(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        label = piece.data[lags:, -1:]
        bars, z = seen(Piece(piece.key, piece.block, piece.bars, np.ascontiguousarray(piece.data[:, :-1]), piece.own))
        return bars, np.column_stack([z, label]) if len(bars) else z

    blocks = Blocks(packed(rows, key, folder, lags, block_bars), key, shape)

    def sums(piece: Piece, bars: np.ndarray, z: np.ndarray) -> dict:
        found = moments(z[:, :-1], z[:, -1:] == np.array(labels, float))
        n = len(columns)
        return {"regime": np.repeat(np.array(labels, np.int32), n * n), "a": np.tile(np.repeat(columns, n), len(labels)).tolist(), "b": np.tile(columns, n * len(labels)).tolist(), "value": found.ravel()}

    return blocks.mapped(sums, "regime int, a string, b string, value double").groupBy("regime", "a", "b").agg(F.sum("value").alias("value"))
