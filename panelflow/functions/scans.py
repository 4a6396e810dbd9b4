"""Associative scans of hidden Markov chains, in numpy: products of positive matrices and max-plus products.

A chain's step is a matrix over states (transition times emission); filters, smoothers and best paths
are prefix and suffix products of such steps. Products associate, so a block of bars is summed up by
one small matrix, and blocks are joined like bars. All prefixes of n steps take log2(n) rounds of
products of neighbours. Matrices are scaled to a largest entry of 1; their scales are kept as logs.
"""

from __future__ import annotations

import numpy as np


def scaled(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(m.max((-2, -1)), 1e-300)
    return m / top[..., None, None], logs + np.log(top)


def steps(moves: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bar's matrix: from state i to j with the bar's emission in j; logs of their scales."""
    top = logp.max(1)
    return scaled(moves[None] * np.exp(logp - top[:, None])[:, None, :], top)


def prefixes(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products of steps 0..t for each t."""
    m, logs, gap = m.copy(), logs.copy(), 1
    while gap < len(m):
        new, sums = scaled(m[:-gap] @ m[gap:], logs[:-gap] + logs[gap:])
        m[gap:], logs[gap:], gap = new, sums, 2 * gap
    return m, logs


def suffixes(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products of steps t..n - 1 for each t."""
    back, sums = prefixes(m[::-1].transpose(0, 2, 1), logs[::-1])
    return back[::-1].transpose(0, 2, 1), sums[::-1]


def product(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """The product of all steps, by halves."""
    while len(m) > 1:
        odd = len(m) % 2
        new, sums = scaled(m[: len(m) - odd : 2] @ m[1::2], logs[: len(m) - odd : 2] + logs[1::2])
        m, logs = (np.concatenate([new, m[-1:]]), np.concatenate([sums, logs[-1:]])) if odd else (new, sums)
    return m[0], float(logs[0])


def smoothed(moves: np.ndarray, logp: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(filtered, smoothed, first, pairs) of a block's bars.

    before: probabilities of the states at the bar before the block; after: how likely what follows
    the block is from each state, up to a factor. first: joint probabilities of the state before the
    block and at its first bar; pairs: those of neighbouring bars inside, summed.
    """
    m, logs = steps(moves, logp)
    ahead = before @ prefixes(m, logs)[0]
    kept = ahead / ahead.sum(1, keepdims=True)
    behind = np.empty_like(kept)
    behind[-1] = after
    if len(m) > 1:
        behind[:-1] = suffixes(m[1:], logs[1:])[0] @ after
    behind /= behind.max(1, keepdims=True)
    smooth = kept * behind
    smooth /= smooth.sum(1, keepdims=True)
    joint = np.concatenate([before[None], kept[:-1]])[:, :, None] * m * behind[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return kept, smooth, joint[0], joint[1:].sum(0)


def best_product(move: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The max-plus product of a block's steps: the best score from each state before it to each at its end."""
    m = move[None] + logp[:, None, :]
    while len(m) > 1:
        odd = len(m) % 2
        new = (m[: len(m) - odd : 2, :, :, None] + m[1::2, None, :, :]).max(2)
        m = np.concatenate([new, m[-1:]]) if odd else new
    return m[0]


def best_path(move: np.ndarray, logp: np.ndarray, before: np.ndarray, last: int) -> np.ndarray:
    """The best states of a block's bars that end in `last`, given the best scores before the block; the first of equals."""
    came, best = np.empty(logp.shape, int), before
    for t in range(len(logp)):
        way = best[:, None] + move
        came[t] = way.argmax(0)
        best = way.max(0) + logp[t]
    path = np.empty(len(logp), int)
    path[-1] = last
    for t in range(len(logp) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path
