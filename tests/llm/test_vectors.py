import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.llm import additive, balltree, queries


def brute(ids, x, k):
    out = set()
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            ranked = sorted((-(a @ q), j) for j, a in zip(ids, x, strict=True) if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(ranked, 1)}
    return out


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # a common vector, and ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [float("nan")] * 16, 1), (2040, [None] + [1.0] * 15, 1), (2060, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, shard int"), x


def test_ball_tree_is_exact(points, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 128)
    df, x = points
    got = {tuple(r) for r in balltree.largest(balltree.integers(df), F.col("id") % 20 == 0).collect()}
    assert got == {(i, n, j, int(s)) for i, n, j, s in brute(np.arange(len(x)), np.floor(64 * x.astype(float)), 20)}


def search(ids, x, queries, own, k, leaf=64):
    shard = pd.DataFrame({"row": ids, "id": ids, "x": list(x), "shard": 0, "dim": x.shape[1]})
    return balltree.Search(balltree.node_rows(shard), queries, own, np.full(len(queries), -np.inf), k)


def test_ball_tree_leaves_nodes_out_and_stays_exact_with_large_integers(monkeypatch):
    monkeypatch.setattr(balltree.Tree.__init__, "__defaults__", (64,))
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (500, 4)), rng.integers(1000, 1010, (500, 4))])
    ids = np.arange(1000)
    run = search(ids, x, x[950:], ids[950:], 5)
    scores = x[950:] @ x.T
    scores[np.arange(50), np.arange(950, 1000)] = -(1 << 60)
    assert (run.score == -np.sort(-scores, 1)[:, :5]).all() and run.scored < 50 * 600
    big = x.astype(np.int64) * (1 << 20)
    run = search(ids, big, big[950:], ids[950:], 5)
    assert not run.exact_float
    assert (run.score == -np.sort(-(scores.clip(0) << 40), 1)[:, :5]).all()
    with pytest.raises(OverflowError):
        search(ids, big * 1024, big[950:] * 1024, ids[950:], 5)


def test_additive_recall_and_scores(points):
    df, x = points
    got = additive.nearest(df, F.col("id") % 20 == 0).collect()
    truth = brute(np.arange(len(x)), x.astype(float), 20)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(i, j) for i, _, j, _ in truth}) >= 0.9 * len(truth)
    assert all(abs(r["score"] - float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float))) < 1e-9 for r in got)
    rows = sorted((r["query_id"], r["rank"], -r["score"], r["vec_id"]) for r in got)
    assert all(a[0] != b[0] or a[2:] < b[2:] for a, b in zip(rows, rows[1:], strict=False))


def test_additive_in_shards(points, monkeypatch):
    """Small shards, searched in phases: as good, and no vector goes to the search."""
    monkeypatch.setattr(additive, "SHARD_ROWS", 128)
    df, x = points
    got = {(r["query_id"], r["vec_id"]) for r in additive.nearest(df, F.col("id") % 20 == 0).collect()}
    truth = {(i, j) for i, _, j, _ in brute(np.arange(len(x)), x.astype(float), 20)}
    assert len(got & truth) >= 0.9 * len(truth)


def test_query_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().dropna()
    x = np.stack(rows["embedding"]).astype(float)
    truth = {(i, j) for i, _, j, _ in brute(rows["vec_id"].to_numpy(), x, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in queries.op5_additive(spark, sf).collect()}
    assert len(got) == len(truth) and len(got & truth) >= 0.9 * len(truth)


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 8))
    books = additive.fit(x, stages=4, words=16)
    error = lambda beam: ((x - books.decode(books.encode(x, beam))) ** 2).sum()
    assert error(8) < error(1) < (x**2).sum()


def recall(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in additive.nearest(df, F.col("id") % 20 == 0).collect()}
    truth = {(i, j) for i, _, j, _ in brute(np.arange(len(x)), x.astype(float), 20)}
    return len(got & truth) / len(truth)


def test_long_vectors_get_long_codes():
    """Rows that the fit hasn't seen come out near whatever their length."""
    x = np.random.default_rng(4).normal(size=(5000, 256))
    books = additive.fit_blocks(x[:4000])
    near = books.decode(books.encode(x[4000:]))
    assert ((x[4000:] - near) ** 2).sum() < 0.2 * (x[4000:] ** 2).sum()


def test_additive_recall_in_dense_groups(spark):
    """Half of the rows lie scattered, the others in groups whose rows differ by less than their codes do."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 64))
    x = np.concatenate([centres[rng.integers(8, size=4000)] + 0.001 * rng.normal(size=(4000, 64)), rng.normal(size=(4000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x[rng.permutation(len(x))].astype(np.float32)) >= 0.9


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (3, [-1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in additive.nearest(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 3, -1.0)]
    # a repeated query row is answered each time
    twice = spark.createDataFrame([*rows, (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    again = sorted(tuple(r) for r in additive.nearest(twice, F.col("id") % 20 == 0).collect())
    assert again == sorted(2 * got)
    got = sorted(tuple(r) for r in balltree.largest(balltree.integers(df, 1), F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 2), (0, 2, 1, 2), (0, 3, 20, 0), (0, 4, 3, -1), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 1, 0), (20, 4, 3, 0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert additive.nearest(empty, F.col("id") % 20 == 0).collect() == []
    assert balltree.largest(balltree.integers(empty), F.col("id") % 20 == 0).collect() == []


def test_rows_that_repeat_one_id_hide_no_other(spark):
    """More equal rows of one id than a query wants, and than it may leave out."""
    v, w = [1.0, 0.0], [0.5, 0.5]
    rows = [(0, v)] * 25 + [(1, v)] + [(2, w)] + [(3, v)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = [(0, 1, 1, 1.0)] + [(0, n, 3, 1.0) for n in range(2, 21)]
    got = {tuple(r) for r in additive.nearest(df, F.col("id") % 20 == 0).collect()}
    assert got == set(want)
    got = {tuple(r) for r in balltree.largest(balltree.integers(df), F.col("id") % 20 == 0).collect()}
    assert got == {(q, n, i, 4096) for q, n, i, _ in want}
    few = spark.createDataFrame(rows[:27], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in balltree.largest(balltree.integers(few), F.col("id") % 20 == 0).collect()} == {(0, 1, 1, 4096), (0, 2, 2, 2048)}
    assert {tuple(r) for r in additive.nearest(few, F.col("id") % 20 == 0).collect()} == {(0, 1, 1, 1.0), (0, 2, 2, 0.5)}
