from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.functions.numeric import deflated_sharpe, expected_max_sharpe
from panelflow.operators import backtest, cv, monitor, pairs, portfolio, robustness, signals


def panel_of(spark, x, names="ABCDE"):
    rows = [(names[j], i, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "series string, bar long, ret double").withColumn("ts", F.timestamp_seconds(F.col("bar") * 86400).cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def returns(spark):
    return panel_of(spark, np.random.default_rng(1).normal(0, 0.01, (150, 5))).cache()


def slow_walk(x, weights, init, step, tc, lag):
    """The loop that the join by a computed key replaces."""
    out, last = {}, np.zeros(x.shape[1])
    for t in range(init, len(x), step):
        w = weights[t]
        cost = tc / 2 / 1e4 * np.abs(w - last).sum()
        last = w
        for k, u in enumerate(range(t + lag, min(t + step + lag, len(x)))):
            out[u] = float(w @ x[u]) - (cost if k == 0 else 0)
    return out


@pytest.mark.parametrize(("step", "lag", "tc"), [(21, 1, 10.0), (1, 1, 5.0), (13, 3, 0.0)])
def test_walk_forward_agrees_with_the_loop(spark, returns, step, lag, tc):
    x = np.random.default_rng(1).normal(0, 0.01, (150, 5))
    rows = backtest.momentum_weights(returns, 40, step, 10)
    weights = {}
    for r in rows.collect():
        weights.setdefault(r["rebalance_bar"], np.zeros(5))["ABCDE".index(r["series"])] = r["weight"]
    got = {r["bar"]: r["net"] for r in backtest.walk_forward(returns, rows, 40, step, tc, lag).collect()}
    want = slow_walk(x, weights, 40, step, tc, lag)
    assert set(got) == set(want) and all(got[u] == pytest.approx(want[u]) for u in want)


def test_weights_do_not_see_their_bar(spark):
    x = np.random.default_rng(2).normal(0, 0.01, (120, 5))
    before = backtest.inverse_vol_weights(panel_of(spark, x), 60, 20, 60).where("rebalance_bar <= 80").orderBy("rebalance_bar", "series").collect()
    x[80:] = -9999
    assert backtest.inverse_vol_weights(panel_of(spark, x), 60, 20, 60).where("rebalance_bar <= 80").orderBy("rebalance_bar", "series").collect() == before
    seen = backtest.callback_weights(panel_of(spark, x), lambda past: {"A": float(past.index.max())}, 60, 20).where("series = 'A'")
    assert {(r["rebalance_bar"], r["weight"]) for r in seen.collect()} == {(60, 59.0), (80, 79.0), (100, 99.0)}


def test_failing_strategies_hold_nothing(spark, returns):
    def fails(past):
        raise RuntimeError("no")

    for strategy in (fails, lambda past: "what"):
        assert {r["weight"] for r in backtest.callback_weights(returns, strategy, 60, 40).collect()} == {0.0}
    pnl = backtest.walk_forward(returns, backtest.callback_weights(returns, lambda past: pd.Series(dtype=float), 60, 40), 60, 40)
    assert {r["net"] for r in pnl.collect()} == {0.0}


def test_metrics_agree_with_numpy(spark):
    r = np.random.default_rng(3).normal(0.0005, 0.01, 200)
    pnl = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "bar long, net double")
    m = backtest.metrics(pnl).first()
    curve = np.cumprod(1 + r)
    assert m["sharpe"] == pytest.approx(r.mean() / r.std(ddof=1) * 252**0.5)
    assert m["sortino"] == pytest.approx(r.mean() / r[r < 0].std(ddof=1) * 252**0.5)
    assert m["max_drawdown"] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())
    assert m["total_return"] == pytest.approx(curve[-1] - 1) and m["hit_rate"] == pytest.approx((r > 0).mean())
    flat = spark.createDataFrame([(i, 0.0) for i in range(5)], "bar long, net double")
    assert (backtest.metrics(flat).first()["sharpe"], backtest.metrics(flat).first()["calmar"]) == (0.0, 0.0)
    assert backtest.metrics(flat.limit(0)).collect() == []


def test_costs_lower_returns_and_sweeps_agree(spark, returns):
    weights = backtest.momentum_weights(returns, 40, 10, 10)
    sweep = {r["tc_bps"]: r["total_return"] for r in backtest.metrics(backtest.cost_sweep(returns, weights, [0.0, 5.0, 50.0], 40, 10), ("tc_bps",)).collect()}
    assert sweep[0.0] > sweep[5.0] > sweep[50.0]
    assert backtest.metrics(backtest.walk_forward(returns, weights, 40, 10, 5.0)).first()["total_return"] == pytest.approx(sweep[5.0])


def test_empty_months_give_zero(spark):
    pnl = spark.createDataFrame([(0, "2024-01-05", 0.1), (1, "2024-01-06", 0.1), (2, "2024-03-01", -0.5)], "bar long, d string, net double").select("bar", F.col("d").cast("timestamp_ntz").alias("ts"), "net")
    assert [(r["month"], round(r["ret"], 9)) for r in backtest.monthly(pnl).orderBy("month").collect()] == [(1, 0.21), (2, 0.0), (3, -0.5)]


def test_folds(spark):
    rows = cv.purged_folds(spark, 103, 5, 4, 3).toPandas()
    tested = rows[rows.role == "test"]
    assert sorted(tested.bar) == list(range(103))
    for _, fold in rows.groupby("fold"):
        test, train = set(fold[fold.role == "test"].bar), set(fold[fold.role == "train"].bar)
        assert not test & train and not train & set(range(min(test) - 4, max(test) + 1 + 7))
    assert cv.combinatorial_folds(spark, 120, 6, 2).select("fold").distinct().count() == comb(6, 2)
    for bad in ({"groups": 1}, {"horizon": 0}):
        with pytest.raises(ValueError, match="at least"):
            cv.purged_folds(spark, 50, **bad)


def test_overfitting(spark):
    def pbo(edge, seed):
        x = np.random.default_rng(seed).normal(0, 0.01, (240, 6))
        x[:, 0] += edge
        rows = [(f"t{j}", i, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
        return robustness.overfitting_probability(spark.createDataFrame(rows, "trial string, bar long, ret double")).first()

    noise, skill = pbo(0, 4), pbo(0.004, 4)
    assert noise["splits"] == comb(16, 8) and skill["pbo"] < 0.1 < noise["pbo"]
    short = spark.createDataFrame([("a", 0, 0.1), ("b", 0, 0.1)], "trial string, bar long, ret double")
    assert robustness.overfitting_probability(short).first()["pbo"] is None


def test_deflated_sharpe():
    assert expected_max_sharpe(1) == 0 and expected_max_sharpe(100) > expected_max_sharpe(10) > 0
    low, high = deflated_sharpe(0.1, 50, 500, trial_std=0.05), deflated_sharpe(0.3, 50, 500, trial_std=0.05)
    assert low["deflated"] < high["deflated"] and high["passes"] and low["p_value"] == pytest.approx(1 - low["deflated"])
    assert deflated_sharpe(0.1, 5, 1)["passes"] is False


def test_sharpe_intervals():
    r = np.random.default_rng(0).normal(0.001, 0.01, 500)
    own, low, high = robustness.sharpe_interval(r)
    assert low < own < high
    _, l2, h2 = robustness.sharpe_interval(r[:100])
    assert h2 - l2 > high - low and np.isnan(robustness.sharpe_interval(r[:20])[0])


def test_sharpe_intervals_of_several_strategies(spark):
    """Equal to the plain draws; too few bars give nulls, and a flat strategy 0."""
    rng = np.random.default_rng(1)
    held = {"a": rng.normal(0.001, 0.01, 300), "b": rng.normal(0, 0.02, 77), "c": np.zeros(50), "d": rng.normal(size=12)}
    rows = [(k, 5 * i, float(v)) for k, x in held.items() for i, v in enumerate(x)]
    got = {r["strategy"]: (r["sharpe"], r["low"], r["high"]) for r in robustness.sharpe_intervals(spark.createDataFrame(rows, "strategy string, bar long, net double"), count=60).collect()}
    assert got["d"] == (None, None, None) and got["c"] == (0, 0, 0)
    for k in "ab":
        assert got[k] == pytest.approx(robustness.sharpe_interval(held[k], 60, name=k))


def test_portfolios(spark, returns):
    cov = np.cov(np.random.default_rng(42).normal(size=(100, 3)).T) * [[1], [1], [1]]
    w = portfolio.equal_risk(cov)
    part = w * (cov @ w)
    assert w.sum() == pytest.approx(1) and (w > 0).all() and np.allclose(part, part.mean(), rtol=1e-5)
    k = portfolio.kelly(np.array([5.0, -3.0, 1.0]), cov, 2.0)
    assert np.abs(k).sum() == pytest.approx(2.0)
    weights = spark.createDataFrame([("A", 0.9), ("B", -0.3), ("C", 0.05), ("D", 0.1)], "series string, weight double")
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "series string, sector string")
    out = {r["series"]: r for r in portfolio.constrained(weights, sectors).collect()}
    assert sum(abs(r["weight"]) for r in out.values()) == pytest.approx(1) and out["D"]["sector"] == "other" and out["B"]["weight"] < 0
    inverse = portfolio.inverse_volatility(returns, 60).collect()
    assert sum(r["weight"] for r in inverse) == pytest.approx(1)
    none = spark.createDataFrame([("all", "Z", 0.1)], "portfolio string, series string, mu double")
    cov_rows = spark.createDataFrame([("all", "A", "A", 1.0)], "portfolio string, a string, b string, cov double")
    assert portfolio.risk_parity(none, cov_rows).collect() == []


def test_signals(spark):
    edges = spark.createDataFrame([("A", "C", 1, 0.3), ("B", "C", 1, 0.1), ("C", "A", 1, 0.005), ("A", "A", 1, 0.9)], "source string, target string, lag int, te double")
    coefs = spark.createDataFrame([(0, "A", "C", 2.0), (1, "A", "C", 3.0)], "regime int, source string, target string, coefficient double")
    latest = spark.createDataFrame([("A", 0.01)], "series string, ret double")
    rows = {r["leader"]: r for r in signals.generate(edges, coefs, latest, 1).collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["raw_signal"] == pytest.approx(0.03) and rows["B"]["raw_signal"] == 0
    assert 0.5 < rows["B"]["confidence"] < rows["A"]["confidence"] < 1
    mean = signals.averaged(signals.generate(edges, coefs, latest, 7)).first()  # no such regime: the first
    assert mean["expected_return"] == pytest.approx(0.75 * 0.02) and mean["dominant_leader"] == "A" and sum(x["weight"] for x in mean["leaders"]) == pytest.approx(1)
    by_regime = edges.withColumn("regime", F.lit(2))
    got = signals.regime_weights(by_regime, 5, 2).collect()
    assert sum(r["weight"] for r in got) == pytest.approx(1) and len(got) == 2
    assert signals.regime_weights(by_regime, 5).collect() == []


def test_breaks(spark):
    values = [0.05, 0.051, 0.049, 0.05, 0.0505, 0.2, 0.05, 0.01]
    updates = spark.createDataFrame([("A", "B", i, v) for i, v in enumerate(values)], "source string, target string, bar long, te double")
    events = monitor.breaks(updates).collect()
    assert [(r["bar"], r["event_type"]) for r in sorted(events, key=lambda r: r["bar"])] == [(5, "te_spike"), (7, "te_decay")]
    text = monitor.alert_text(monitor.breaks(updates)).first()["text"]
    assert text.startswith("2 structural breaks\n[SPIKE] A > B")
    assert monitor.alert_text(monitor.breaks(updates.limit(0))).first()["text"] == "No structural breaks."
    assert "## te_spike (1)" in monitor.daily_report(monitor.breaks(updates)).first()["text"]
    probs = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.2, 0.8]), (2, [0.3, 0.7])], "bar long, prob array<double>")
    assert [r["bar"] for r in monitor.regime_changes(monitor.most_likely(probs)).collect()] == [1]
    one = spark.createDataFrame([("te_spike", "A", "B", 0.1, 0.2, "")], "k string, l string, f string, o double, n double, t string")
    assert one.select(monitor.described(*[F.col(c) for c in "klfont"])).first()[0] == "te_spike: A > B from 0.1000 to 0.2000"
    assert monitor.post_webhook("x", "") is False and monitor.send_mail("x", "", 1, "a@b.example") is False
    assert monitor.narrate("x").startswith("No narrative") and "boom" in monitor.narrate("x", "key", lambda p, k: (_ for _ in ()).throw(OSError("boom")))


def test_timing_rules(spark):
    """The rule of every two kinds of market."""
    late = {"weekly_macro"}
    kinds = ["equity", "fx", "crypto", "commodity", "bond", "credit", "weekly_macro", "other"]
    want = {(a, b): "actionable" for a in kinds for b in kinds}
    want |= {(a, "crypto"): "likely priced" for a in kinds}
    want |= {(a, "fx"): "likely priced" for a in ("equity", "fx", "bond", "credit")}
    want |= {(a, b): "delayed data" for a in late for b in kinds}
    rows = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    assert {(r["a"], r["b"]): r["t"] for r in rows.select("a", "b", signals.timing(F.col("a"), F.col("b")).alias("t")).collect()} == want
    named = spark.createDataFrame([("SPX",), ("DXY",), ("ETH",), ("BRENT",), ("MOVE",), ("CCC_OAS",), ("CFNAI",), ("ELSE",)], "s string")
    assert [r[0] for r in named.select(signals.market_of(F.col("s"))).collect()] == kinds


def test_tradable_categories(spark):
    kinds = ["HFT only", "Next-day tradable", "Short-term", "Swing (tradable)", "Slow decay (tradable)"]
    rows = spark.createDataFrame([(k, "x", lag, k) for k in kinds for lag in (1, 2)], "source string, target string, lag int, category string")
    kept = signals.tradable(rows).collect()
    assert sorted(r["category"] for r in kept) == sorted(k for k in kinds if "tradable" in k) and {r["lag"] for r in kept} == {1}


def test_tail_correlation_pairs_places_from_the_end(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=90), rng.normal(size=70)
    rows = [("A", 2 * i, float(x)) for i, x in enumerate(a)] + [("B", 3 * i + 1, float(x)) for i, x in enumerate(b)] + [("A", 1, None), ("C", 0, 1.0)]
    got = {(r["source"], r["target"]): (r["n"], r["corr"]) for r in pairs.tail_correlation(spark.createDataFrame(rows, "series string, bar long, ret double")).collect()}
    assert got["A", "B"] == (70, pytest.approx(np.corrcoef(a[-71:-1], b)[0, 1]))
    assert got["B", "A"] == (69, pytest.approx(np.corrcoef(b[:-1], a[-69:])[0, 1]))
    assert got["A", "C"] == (1, 0.0)


def test_panels_are_cached_in_few_partitions(spark):
    """Whatever the number of shuffle partitions, a stage over the panel has a task for each core at most."""
    from panelflow.plans import base

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        for rows in (base.levels(spark, "/root/testdata/sf0.001"), base.full_panel(spark, "/root/testdata/sf0.001")):
            assert rows.count() and rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.catalog.clearCache()
