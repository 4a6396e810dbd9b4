import hashlib

import duckdb
import numpy as np
import pytest

from panelflow.llm import elkan, queries

SCHEMA = "vec_id long, embedding array<double>, cluster int, ids string"


def brute(ids, x, k, rounds):
    """Plain integer k-means; ties go to the smaller number."""
    x = np.asarray(x, np.int64)
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[order].astype(object)
    for turn in range(rounds + 1):
        d = np.array([[int(((v.astype(object) - w) ** 2).sum()) for w in c] for v in x])
        own = d.argmin(1)
        if turn < rounds:
            c = np.array([x[own == j].astype(object).sum(0) // int((own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
    near = d[np.arange(len(x)), own]
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((ids[i], int(own[i]), int(near[i]), int(near[own == own[i]].sum()), int(near.sum()), sha[own[i]]) for i in range(len(x))), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in row], 1, "x") for i, row in zip(ids, x, strict=True)], SCHEMA)


def test_agrees_with_plain_rounds_where_ties_abound(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 3))
    ids = [*range(298), None, 5]
    assert rows_of(elkan.clusters(table(spark, ids, x).repartition(5), k=5, rounds=4, scale=1, dim=3)) == brute(ids, x, 5, 4)


@pytest.mark.parametrize("size", [1, 1 << 24])
def test_bounds_save_distances_and_change_nothing(spark, size):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-9, 9, (150, 4)) + c for c in rng.integers(-500, 500, (6, 4))]) * (size // 128 or 1)
    ids = list(range(len(x)))
    df = table(spark, ids, x)
    assert rows_of(elkan.clusters(df, k=6, rounds=8, scale=1, dim=4)) == brute(ids, x, 6, 8)
    _, _, measured = elkan.kmeans(df, k=6, rounds=8, scale=1, dim=4)
    assert measured < 0.4 * len(x) * 6 * 9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (1, [0.5, -0.25]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = rows_of(elkan.clusters(df, k=8, rounds=2, scale=4, dim=2))
    assert got == brute([1, 1, None], [[2, -1], [2, -1], [36, 36]], 8, 2) and {r[1] for r in got} == {0, 2}
    assert elkan.clusters(df.limit(0), dim=2).collect() == []
    with pytest.raises(Exception, match="beyond"):
        elkan.clusters(table(spark, [1], [[1e9, 0.0]]), scale=1, dim=2).collect()


def test_query_agrees_with_its_sql_and_plain_rounds(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = rows_of(queries.op12_elkan(spark, sf))
    assert got == sorted(db.sql(queries.clusters_sql()).fetchall(), key=str)
    rows = [r for r in db.sql("select vec_id, embedding from embeddings").fetchall() if r[1] is not None]
    assert got == brute([r[0] for r in rows], np.floor(1024 * np.array([r[1] for r in rows], float)), 8, 10)
