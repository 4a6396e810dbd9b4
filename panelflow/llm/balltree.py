"""Exact search of the largest inner products, by branch and bound over a ball tree per shard.

Each shard's tree is built once and written, a row for each node; a leaf's row packs its vectors.
A node bounds what its rows can reach: q.centre + |q| * radius. The tree is walked for a block of
queries at once: each query goes first to the child of larger bound, and leaves a node as soon
as its bound is below the query's kth score so far. That score is shared: shards are searched in
phases, and each starts from the kth score of all shards of the phases before; it rises while
leaves are scored. What this saves depends on the vectors: where distances are all alike, no ball
can be left out, and every row is scored, in blocks.

Scores are sums of products of integers. They are computed in double precision where all partial
sums stay below 2**53 and are thus exact, and in 64-bit integers otherwise; a score beyond them
is an error. Cases: vectors that are null or hold null or non-finite components take no part,
vectors of zeros do; equal scores go to the smaller id; repeated rows are candidates each, and
each repeated query row is answered; with fewer candidates than k all are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import shared_dir, written
from panelflow.llm.vectors import in_phases, no_rows, numbered, shard_of, thinned, usable

SHARD_ROWS, LEAF = 8192, 256
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
NODES = "shard int, dim int, node int, right int, centre binary, radius double, top double, row binary, id binary, x binary"


class Tree:
    """Nodes in preorder, as (right child or 0, centre, radius, rows of a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf, self.nodes = x.astype(np.float64), leaf, []
        if len(x):
            self.build(np.arange(len(x)))

    def build(self, rows: np.ndarray) -> None:
        x, own = self.x[rows], len(self.nodes)
        centre = x.mean(0)
        away = np.sqrt(((x - centre) ** 2).sum(1))
        # a little above the largest distance, for what rounding takes
        radius = float(away.max()) * (1 + 1e-9) + 1e-9
        if len(rows) <= self.leaf or radius <= 2e-9:
            self.nodes.append((0, centre, radius, rows))
            return
        self.nodes.append(None)
        far = x[away.argmax()]
        other = x[((x - far) ** 2).sum(1).argmax()]
        side = (x - (far + other) / 2) @ (far - other)
        order = np.argsort(side, kind="stable")
        half = int(np.clip((side < 0).sum(), len(rows) // 8, len(rows) - len(rows) // 8))
        self.build(rows[np.sort(order[:half])])
        self.nodes[own] = (len(self.nodes), centre, radius, None)
        self.build(rows[np.sort(order[half:])])


def node_rows(shard: pd.DataFrame) -> pd.DataFrame:
    """The rows of NODES of a shard's tree."""
    row, ids, x = shard["row"].to_numpy(), shard["id"].to_numpy(), np.stack(shard["x"]).astype(np.int64)
    out = []
    for i, (right, centre, radius, rows) in enumerate(Tree(x).nodes):
        part = x[rows] if rows is not None else x[:0]
        leaf = (row[rows].tobytes(), ids[rows].tobytes(), part.tobytes()) if rows is not None else (b"", b"", b"")
        out.append((shard["shard"].iloc[0], shard["dim"].iloc[0], i, right, centre.tobytes(), radius, float(np.abs(part.astype(float)).max(initial=0)), *leaf))
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


class Search:
    """One shard's tree and the k best of each query of a block."""

    def __init__(self, nodes: pd.DataFrame, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        nodes = nodes.sort_values("node")
        self.right, self.radius = nodes["right"].tolist(), nodes["radius"].tolist()
        self.centre = np.stack([np.frombuffer(c) for c in nodes["centre"]])
        self.rows = [np.frombuffer(r, np.int64) for r in nodes["row"]]
        self.ids = [np.frombuffer(r, np.int64) for r in nodes["id"]]
        self.k, self.own = k, own
        dim = queries.shape[1]
        top = max(nodes["top"].max(), np.abs(queries.astype(float)).max(initial=0))
        self.exact_float = float(top) ** 2 * dim < 2.0**53
        kind = np.float64 if self.exact_float else np.int64
        self.x = [np.frombuffer(b, np.int64).reshape(-1, dim).astype(kind) for b in nodes["x"]]
        self.q, self.q_float = queries.astype(kind), queries.astype(np.float64)
        self.q_norm = np.sqrt((self.q_float**2).sum(1))
        self.floor = floor.copy()
        self.score = np.full((len(queries), k), NONE, np.int64)
        self.found = np.full((len(queries), k), LAST, np.int64)
        self.at = np.full((len(queries), k), LAST, np.int64)
        self.scored = 0
        if len(nodes):
            everyone = np.arange(len(queries))
            self.walk(0, everyone, self.bound(0, everyone))

    def bound(self, node: int, active: np.ndarray) -> np.ndarray:
        reach = self.q_float[active] @ self.centre[node] + self.q_norm[active] * self.radius[node]
        return reach + 1e-9 * np.abs(reach) + 1e-6

    def walk(self, node: int, active: np.ndarray, bound: np.ndarray) -> None:
        active = active[bound >= self.floor[active]]
        if not len(active):
            return
        if not self.right[node]:
            self.take(node, active)
            return
        left, right = node + 1, self.right[node]
        to_left, to_right = self.bound(left, active), self.bound(right, active)
        first = to_left >= to_right
        self.walk(left, active[first], to_left[first])
        self.walk(right, active[~first], to_right[~first])
        self.walk(right, active[first], to_right[first])
        self.walk(left, active[~first], to_left[~first])

    def take(self, node: int, active: np.ndarray) -> None:
        raw = self.q[active] @ self.x[node].T
        if not self.exact_float and np.abs(self.q_float[active] @ self.x[node].T.astype(float)).max(initial=0) >= 2.0**63:
            raise OverflowError("an inner product is beyond 64-bit integers")
        self.scored += raw.size
        scores, ids = raw.astype(np.int64), np.broadcast_to(self.ids[node], raw.shape)
        mine = ids == self.own[active][:, None]
        some = ((scores >= self.floor[active][:, None]) & ~mine).any(1)
        active, mine = active[some], mine[some]
        if not len(active):
            return
        scores = np.concatenate([self.score[active], np.where(mine, NONE, scores[some])], 1)
        ids = np.concatenate([self.found[active], np.where(mine, LAST, ids[some])], 1)
        at = np.concatenate([self.at[active], np.broadcast_to(self.rows[node], mine.shape)], 1)
        order = np.lexsort((at, ids, ~scores), axis=1)[:, : self.k]  # ~s is -s - 1, without overflow
        for held, new in ((self.score, scores), (self.found, ids), (self.at, at)):
            held[active] = np.take_along_axis(new, order, 1)
        self.floor[active] = np.maximum(self.floor[active], self.score[active][:, -1].astype(np.float64))


def shard_search(k: int):
    def search(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(queries):
            return no_rows("int64")
        own = queries["id"].to_numpy()
        floor = queries["floor"].fillna(-np.inf).to_numpy(np.float64)
        run = Search(nodes, np.stack(queries["x"]), own, floor, k)
        keep = (run.found != LAST) & (run.score >= floor[:, None])
        n = keep.sum(1)
        return pd.DataFrame({"q": np.repeat(queries["row"].to_numpy(), n), "query_id": np.repeat(own, n), "row": run.at[keep], "vec_id": run.found[keep], "score": run.score[keep]})

    return search


def integers(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x, dim): the usable vectors with floor(scale * component) for each component."""
    rows = usable(df, id_col, vec_col, zero=True)
    return rows.select("id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"), "dim")


def largest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k largest inner products, exactly.

    vectors: (id, x, dim), x of integers. is_query: a condition on the column id.
    """
    folder = shared_dir(vectors.sparkSession)
    rows = numbered(vectors, folder)
    n = max(1, -(-rows.count() // SHARD_ROWS))
    trees = thinned(rows, k).select("row", "id", "x", "dim", shard_of(n)).groupBy("shard", "dim").applyInPandas(node_rows, NODES)
    trees = written(trees, folder, "trees")
    found = in_phases(trees, rows.where(is_query), n, shard_search(k), "long", k, folder)
    return found.select("query_id", "rank", "vec_id", "score")
