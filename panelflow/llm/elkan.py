"""Exact integer k-means by cached distance bounds.

Components are turned into integers, so distances, sums and centroids are exact and reruns agree.
Every vector keeps an upper bound of the distance to its centroid and a lower bound of that to each
other one. When the centroids have moved, bounds give way by the moves; a centroid is passed over
where its lower bound, or half its distance from the vector's own centroid, is above the upper
bound. Bounds are rounded away from what they bound and compared strictly, so that a centroid that
could tie is always measured: ties go to the smaller number. Measured distances are integers.

Vectors are packed once into blocks (a row for each Arrow batch) beside their bounds; a round reads
the blocks, and writes them with new bounds and each block's sums of every cluster. So nothing is
shuffled but those sums (a row for each cluster and component of a block, in partial sums), and the
driver holds the centroids alone. A round's table is dropped when the next but one is written.

Cases: vectors of another length than `dim`, null ones and those with null or non-finite components
take no part; rows without an id do, but are first centroids only after all others; repeated rows
count each, and equal vectors may be several first centroids (the smallest number wins, the others
stay empty); with fewer vectors than k there are fewer centroids; an empty table gives no row;
integers beyond 2**27 are refused with an error; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import dropped, shared_dir, written
from panelflow.llm.vectors import usable

#: Integers of 64 components up to this differ by squares whose sum is below 2**63.
MOST = 1 << 27
#: Up to this, such sums are exact in double precision.
MOST_FLOAT = 1 << 22
#: What rounding may take from a bound, relatively and absolutely.
SLACK = 1e-12
BLOCKS = "ids binary, known binary, x binary, own binary, upper binary, lower binary, distance binary, counts array<bigint>, sums array<bigint>, inertia array<bigint>, measured bigint"


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK) - SLACK, 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, as integers."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= MOST_FLOAT else np.int64
    away = x.astype(kind) - c.astype(kind)
    return np.einsum("ij,ij->i", away, away).astype(np.int64)


def reassign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, every: bool) -> tuple[np.ndarray, int]:
    """Brings own, upper and lower up to date, in place; the distances where measured (all if every), else -1; how many were."""
    k = len(centroids)
    apart = np.sqrt(np.stack([squared(centroids, c) for c in centroids]).astype(float))
    half = down(apart / 2)
    np.fill_diagonal(half, np.inf)
    distance, measured = np.full(len(x), -1, np.int64), 0
    open_ = np.flatnonzero(~(half.min(1)[own] > upper) | every)
    distance[open_] = squared(x[open_], centroids[own[open_]])
    measured += len(open_)
    upper[open_] = up(np.sqrt(distance[open_].astype(float)))
    lower[open_, own[open_]] = down(np.sqrt(distance[open_].astype(float)))
    for j in range(k):
        at = open_[(own[open_] != j) & ~(lower[open_, j] > upper[open_]) & ~(half[own[open_], j] > upper[open_])]
        d = squared(x[at], centroids[j])
        measured += len(at)
        lower[at, j] = down(np.sqrt(d.astype(float)))
        nearer = (d < distance[at]) | ((d == distance[at]) & (j < own[at]))
        at, d = at[nearer], d[nearer]
        own[at], distance[at], upper[at] = j, d, up(np.sqrt(d.astype(float)))
    return distance, measured


def packed(vectors: DataFrame, scale: int, dim: int) -> DataFrame:
    """Blocks of the vectors (id, x), not yet assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.floor(float(scale) * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, dim))
            if np.abs(x).max() > MOST:
                raise OverflowError(f"a component is beyond {MOST} after scaling")
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            yield block(ids.tobytes(), known.tobytes(), x.astype(np.int32).tobytes())

    return vectors.select("id", "x").mapInArrow(run, BLOCKS)


def block(ids: bytes, known: bytes, x: bytes, own: bytes = b"", upper: bytes = b"", lower: bytes = b"", distance: bytes = b"", counts=(), sums=(), inertia=(), measured: int = 0) -> pa.RecordBatch:
    blobs = [pa.array([b], pa.binary()) for b in (ids, known, x, own, upper, lower, distance)]
    totals = [pa.array([list(map(int, t))], pa.list_(pa.int64())) for t in (counts, sums, inertia)]
    return pa.RecordBatch.from_arrays([*blobs, *totals, pa.array([measured], pa.int64())], names=[c.split()[0] for c in BLOCKS.split(", ")])


def assigned(blocks: DataFrame, centroids: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """The blocks after one round of assignment. moved: how far each centroid has moved since the round before, or more."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.int32).reshape(-1, dim)
                n = len(x)
                if row["own"]:
                    own = np.frombuffer(row["own"], np.int16).copy()
                    upper = up(np.frombuffer(row["upper"]) + moved[own])
                    lower = down(np.frombuffer(row["lower"]).reshape(n, k) - moved)
                else:
                    own, upper, lower = np.zeros(n, np.int16), np.full(n, np.inf), np.zeros((n, k))
                distance, measured = reassign(x, own, upper, lower, centroids, last)
                sums = [x[own == j].sum(0, dtype=np.int64) for j in range(k)]
                inertia = [distance[own == j].sum() if last else 0 for j in range(k)]
                yield block(row["ids"], row["known"], row["x"], own.tobytes(), upper.tobytes(), lower.tobytes(), distance.tobytes() if last else b"", np.bincount(own, minlength=k), np.concatenate(sums), inertia, measured)

    return blocks.mapInArrow(run, BLOCKS)


def total(blocks: DataFrame, column: str, size: int) -> list[int]:
    """The blocks' arrays added up: `size` numbers, exactly."""
    rows = blocks.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in rows}
    return [found.get(i, 0) for i in range(size)]


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """Those of the k vectors whose ids have the smallest SHA-256 behind the seed, in that order."""
    ticket = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(F.transform("x", lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("x"), ticket.alias("ticket")).orderBy(F.col("ticket").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def kmeans(df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding", folder: str | None = None) -> tuple[DataFrame, np.ndarray, int]:
    """The assigned blocks, the centroids, and the number of distances that were measured."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    vectors = usable(df, id_col, vec_col, zero=True, null_ids=True).where(F.col("dim") == dim)
    blocks = written(packed(vectors, scale, dim), folder, "round0")
    centroids = first_centroids(vectors, k, scale, seed)
    if not len(centroids):
        return blocks, centroids.reshape(0, dim), 0
    moved, measured = np.zeros(len(centroids)), 0
    for turn in range(1, rounds + 2):
        blocks = written(assigned(blocks, centroids, moved, last=turn > rounds), folder, f"round{turn}")
        if turn > 1:
            dropped(spark, f"{folder}/round{turn - 2}")
        measured += blocks.agg(F.sum("measured")).first()[0]
        if turn <= rounds:
            counts = total(blocks, "counts", len(centroids))
            sums = np.array(total(blocks, "sums", centroids.size), object).reshape(centroids.shape)
            new = np.array([s // n if n else c for s, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
            moved, centroids = up(np.sqrt(np.array([squared(a[None], b)[0] for a, b in zip(new, centroids, strict=True)], float))), new
    return blocks, centroids, measured


def clusters(df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    blocks, centroids, _ = kmeans(df, k, rounds, scale, dim, seed, id_col, vec_col)
    inertia = total(blocks, "inertia", len(centroids))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["own"], np.int16)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
                within = np.array(inertia, np.int64)[own]
                columns = [ids, pa.array(own.astype(np.int32)), pa.array(np.frombuffer(row["distance"], np.int64)), pa.array(within), pa.array(np.full(len(own), sum(inertia))), pa.array([shas[j] for j in own.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.select("ids", "known", "own", "distance").mapInArrow(rows, f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
