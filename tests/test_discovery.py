import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.functions.numeric import digamma_table
from panelflow.operators import discovery as d
from panelflow.operators import pairs


def planted(n=400, lag=1, strength=0.7, noise=0.3, seed=0):
    rng = np.random.default_rng(seed)
    a, e = rng.normal(size=n), rng.normal(size=n)
    b = noise * e
    b[lag:] += strength * a[:-lag]
    return a, b


def panel_of(spark, **series):
    return spark.createDataFrame([(s, i, float(x)) for s, xs in series.items() for i, x in enumerate(xs)], "series string, bar long, ret double")


def slow_entropy(s, t, lag, k, h):
    """Point by point, as the formula is written."""
    rows = [(t[i + lag], t[i - np.arange(h)], s[i - np.arange(h)]) for i in range(h, len(t) - lag)]
    psi, total = digamma_table(len(rows) + 1), 0.0
    for f, a, b in rows:
        own = np.array([np.abs(a - x).max() for _, x, _ in rows])
        fut = np.maximum(own, [abs(f - y) for y, _, _ in rows])
        oth = np.maximum(own, [np.abs(b - x).max() for _, _, x in rows])
        e = np.sort(np.maximum(fut, oth))[k] - 1e-15
        total += psi[max((own <= e).sum(), 1)] - psi[max((fut <= e).sum(), 1)] - psi[max((oth <= e).sum(), 1)]
    return max(0.0, psi[k] + total / len(rows))


@pytest.mark.parametrize("block", [37, 512])
def test_kernel_agrees_with_the_formula(monkeypatch, block):
    """By the index, and by all distances at once."""
    monkeypatch.setattr(d, "BLOCK", block)
    a, b = planted(120)
    assert d.transfer_entropy(a, b, 2, 4, 2, noise=0) == pytest.approx(slow_entropy(a, b, 2, 4, 2), abs=1e-12)


def test_direction_lag_and_short_series():
    a, b = planted(500, strength=0.6)
    assert d.transfer_entropy(a, b) > d.transfer_entropy(b, a) + 0.02
    assert d.transfer_entropy(a, b, 1) >= d.transfer_entropy(a, b, 5)
    c = np.random.default_rng(5).normal(size=500)
    assert d.transfer_entropy(c, b) < 0.05 and d.transfer_entropy(a[:40], b[:40]) == 0
    gap = a.copy()
    gap[::7] = np.nan
    assert d.transfer_entropy(gap, b) >= 0


def test_mutual_information():
    a, b = planted(500)
    assert d.lagged_information(a, b, 1) > 0.3 > d.lagged_information(b, a, 1)
    assert d.lagged_information(b, a, -1) == pytest.approx(d.lagged_information(a, b, 1), abs=0.02)
    assert d.lagged_information(a, b, 500) == 0 and d.mutual_information(a[:10], b[:10]) == 0
    assert d.mutual_information(a, a + 1e-3 * b, strict=True) > d.mutual_information(a, a + 1e-3 * b)


def test_effective_entropy():
    a, b = planted()
    raw, effective, p = d.effective_entropy(a, b, surrogates=20)
    assert 0.05 < effective <= raw and p < 0.1
    c = np.random.default_rng(8).normal(size=400)
    _, effective, p = d.effective_entropy(c, b, surrogates=20)
    assert effective < 0.02 and p > 0.05


def test_best_lag_finds_the_planted_one():
    a, b = planted(600, 5, 0.9, 0.15)
    found = d.best_lag(a, b, [1, 3, 5, 8], history=1, surrogates=5)
    assert found["best_lag"] == 5 and found["stability_cv"] >= 0 and set(found["all_lags"]) == {1, 3, 5, 8}


def test_significance():
    a, b = planted(150)
    found = d.bootstrap_significance(a, b, count=30)
    assert 0 <= found["p_value"] <= 1 and found["low"] <= found["high"]
    for method in ("shuffle", "phase"):
        found = d.surrogate_significance(a, b, count=20, method=method)
        assert found["te"] > found["mean"] and found["p_value"] < 0.1
    with pytest.raises(ValueError, match="method"):
        d.surrogate_significance(a, b, method="other")


def test_matrix_has_every_ordered_pair(spark):
    a, b = planted(200)
    panel = panel_of(spark, A=a, B=b, C=np.random.default_rng(2).normal(size=200))
    rows = {(r["source"], r["target"], r["lag"]): r["te"] for r in d.entropy_matrix(panel, [1, 3]).collect()}
    assert len(rows) == 12 and max(rows, key=rows.get) == ("A", "B", 1)
    assert rows["A", "B", 1] == pytest.approx(d.transfer_entropy(a, b))
    few = d.entropy_matrix(panel, [1], targets=["B"]).collect()
    assert {(r["source"], r["target"]) for r in few} == {("A", "B"), ("C", "B")}


def test_missing_bars_are_deleted_pairwise(spark):
    a, b = planted(200)
    panel = panel_of(spark, A=a, B=b).where("not (series = 'A' and bar in (3, 50))")
    keep = [i for i in range(200) if i not in (3, 50)]
    got = {(r["source"]): r["te"] for r in d.entropy_matrix(panel, [1], noise=0.0).collect()}
    assert got["A"] == pytest.approx(d.transfer_entropy(a[keep], b[keep], noise=0))


def test_decay_categories(spark):
    edges = [("a", "b", lag, te) for lag, te in ((1, 1.0), (2, 0.6), (3, 0.4))] + [("c", "b", lag, te) for lag, te in ((1, 1.0), (2, 0.2), (3, 0.1))] + [("d", "b", 1, 0.5), ("e", "b", 1, 1.0), ("e", "b", 10, 0.9), ("f", "b", 1, 1.0), ("f", "b", 20, 0.9)]
    edges = spark.createDataFrame(edges, "source string, target string, lag int, te double")
    corr = spark.createDataFrame([("a", "b", 1, -0.2)], "source string, target string, lag int, corr double")
    rows = {r["source"]: r for r in d.decay(edges, corr).where("lag = 1").collect()}
    assert {k: (r["half_life"], r["category"]) for k, r in rows.items()} == {"a": (3, "Next-day tradable"), "c": (2, "Short-term"), "d": (1, "HFT only"), "e": (10, "Swing (tradable)"), "f": (20, "Slow decay (tradable)")}
    assert rows["a"]["direction"] == "inverse" and rows["c"]["direction"] == "same"


def test_regimes_with_few_bars_are_left_out(spark):
    a, b = planted(200)
    panel = panel_of(spark, A=a, B=b)
    regimes = spark.range(200).select(F.col("id").alias("bar"), (F.col("id") >= 170).cast("int").alias("regime"))
    assert {r["regime"] for r in d.regime_entropy(panel, regimes, [1]).collect()} == {0}


def test_pairs(spark):
    a, b = planted(300)
    panel = panel_of(spark, A=a, B=b)
    corr = {r["source"]: r["corr"] for r in pairs.lagged_correlation(panel, [1]).collect()}
    assert corr["A"] == pytest.approx(np.corrcoef(a[:-1], b[1:])[0, 1])
    beta = {r["source"]: r["beta"] for r in pairs.regression(panel).collect()}
    assert beta["A"] == pytest.approx(np.polyfit(a[:-1], b[1:], 1)[0])
    hit = {r["source"]: r["rate"] for r in pairs.hit_rate(panel).collect()}
    assert hit["A"] > 0.75
    negative = {r["source"]: r["corr"] for r in pairs.lagged_correlation(panel, [-1]).collect()}
    assert negative["B"] == pytest.approx(corr["A"])
    edges = spark.createDataFrame([("A", "B", 0.2), ("B", "C", 0.04), ("C", "A", 0.2)], "source string, target string, te double")
    assert [r["source"] for r in pairs.network(edges, 0.05, 1).collect()] == ["A"]
    assert {r["series"] for r in pairs.isolates(spark.createDataFrame([("A",), ("D",)], "series string"), edges).collect()} == {"D"}
    assert pairs.tidy(pairs.wide(edges)).where("te > 0").count() == 3


def ties(n, seed=0):
    """A series of few values: most distances are equal."""
    return np.random.default_rng(seed).integers(0, 4, n).astype(float)


@pytest.mark.parametrize("make", [lambda: planted(2000), lambda: (ties(1500), ties(1500, 1)), lambda: (ties(900), planted(900)[0])])
@pytest.mark.parametrize("lag", [1, 7])
def test_index_agrees_with_all_distances_to_the_last_tie(monkeypatch, make, lag):
    a, b = make()
    want = []
    for block in (10**9, 16):
        monkeypatch.setattr(d, "BLOCK", block)
        want.append((d.transfer_entropy(a, b, lag, noise=0), [d.entropy_terms(a, b, lag, noise=0, piece=i, pieces=3) for i in range(3)]))
    (one, parts), (two, few) = want
    assert two == pytest.approx(one, abs=1e-12) and sum(n for _, n in few) == sum(n for _, n in parts) == len(a) - 3 - lag
    assert sum(t for t, _ in few) == pytest.approx(sum(t for t, _ in parts), abs=1e-9)


def slow_information(x, y, k):
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    e = np.sort(np.maximum(dx, dy), 1)[:, k : k + 1] - 1e-15
    psi = digamma_table(len(x) + 2)
    return max(0.0, psi[k] - np.mean(psi[np.maximum((dx <= e).sum(1), 1) + 1] + psi[np.maximum((dy <= e).sum(1), 1) + 1]) + psi[len(x)])


def test_information_agrees_with_all_distances():
    for x, y in (planted(1200), (ties(700), ties(700, 3)), (ties(300), planted(300)[1])):
        assert d.mutual_information(x, y, 5, noise=0) == pytest.approx(slow_information(x, y, 5), abs=1e-12)


def test_index_looks_at_a_part_of_the_points():
    """At 16,000 points a part of the pairs, which shrinks as points are added."""
    shares = []
    for n in (4_000, 16_000):
        a, b = planted(n)
        future, own, other = d.embed(a, b, 1, 3)
        cells = d.Cells(own)
        some = range(0, len(cells), 16)
        looked = sum(x.size for _, _, x, _ in cells.searched(np.column_stack([future, other]), 5, some))
        shares.append(looked / (sum(len(cells.rows[c]) for c in some) * len(own)))
    assert shares[1] < 0.3 and shares[1] < 0.7 * shares[0]


def test_a_long_pair_is_dealt_to_pieces(spark, monkeypatch):
    a, b = planted(700)
    panel = panel_of(spark, A=a, B=b)
    monkeypatch.setattr(d, "PIECE_POINTS", 100)
    assert d.pieces_for(panel) == 7
    rows = {(r["source"], r["lag"]): r["te"] for r in d.entropy_matrix(panel, [1, 2], noise=0.0).collect()}
    assert len(rows) == 4 and rows["A", 2] == pytest.approx(d.transfer_entropy(a, b, 2, noise=0), abs=1e-12)
    mi = {r["source"]: r["mi"] for r in d.information_matrix(panel, [1], noise=0.0).collect()}
    assert mi["A"] == pytest.approx(slow_information(a[:-1], b[1:], 5), abs=1e-12)


def test_draws_are_rows_equal_to_a_serial_run(spark, monkeypatch):
    monkeypatch.setattr(d, "PIECE_DRAWS", 4)
    a, b = planted(150)
    panel, names = panel_of(spark, A=a, B=b), ("A", "B")
    for method in ("shift", "bootstrap", "shuffle", "phase"):
        raw, want = d.drawn_entropies(a, b, method, 1, 10, names=names)
        rows = d.draws(panel, method, [1], 10).where("source = 'A'").collect()
        assert {r["draw"]: r["te"] for r in rows} == {-1: raw, **dict(enumerate(want))}
    later = d.draws(panel, "shuffle", [1], 5, first=6).where("source = 'A' and draw >= 0").collect()
    assert sorted(r["draw"] for r in later) == [6, 7, 8, 9, 10]
    got = d.significance(panel, "bootstrap", 1, 10).where("source = 'A'").first().asDict()
    want = d.bootstrap_significance(a, b, count=10, names=names)
    assert got.pop("draws") == 10 and all(got[k] == pytest.approx(v) for k, v in want.items())
    lags = d.variable_lags(panel, [1, 3], surrogates=6).where("source = 'A'").first()
    want = d.best_lag(a, b, [1, 3], surrogates=6, names=names)
    assert all(lags[k] == pytest.approx(v) for k, v in want.items())
    with pytest.raises(ValueError, match="method"):
        d.significance(panel, "other")


def test_sequential_draws_stop_where_nothing_is_to_be_found(spark, monkeypatch):
    monkeypatch.setattr(d, "PIECE_DRAWS", 5)
    a, b = planted(150, strength=0.9)
    panel = panel_of(spark, A=a, B=b, C=np.random.default_rng(9).normal(size=150))
    whole = {(r["source"], r["target"]): r for r in d.significance(panel, "shuffle", 1, 40).collect()}
    few = {(r["source"], r["target"]): r for r in d.significance(panel, "shuffle", 1, 40, stop=4).collect()}
    assert few["A", "B"]["draws"] == 40 and few["A", "B"]["p_value"] == whole["A", "B"]["p_value"] == 0
    serial = {pair: d.drawn_entropies(*(dict(A=a, B=b, C=np.random.default_rng(9).normal(size=150))[x] for x in pair), "shuffle", 1, 40, names=pair) for pair in few}
    for pair, (raw, found) in serial.items():
        reached = np.cumsum(found >= raw)
        used = int((reached < 4).sum()) + 1 if reached[-1] >= 4 else 40
        assert few[pair]["draws"] == used and few[pair]["p_value"] == pytest.approx(reached[used - 1] / used)
    assert min(r["draws"] for r in few.values()) < 40
