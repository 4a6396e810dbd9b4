import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.functions import scans
from panelflow.functions.prefix import ordinals, previous, running
from panelflow.operators import chains, varmodels
from panelflow.sources import store


def random_chain(rng, regimes, d):
    moves = rng.dirichlet(np.ones(regimes) * 2, regimes)
    a = rng.normal(size=(regimes, d, d))
    return chains.Chain(moves, rng.dirichlet(np.ones(regimes)), rng.normal(size=(regimes, 1, d)), a @ a.transpose(0, 2, 1) + 0.3 * np.eye(d), 1)


def plain(chain, x):
    """The recursions bar by bar, in logs."""
    model = varmodels.GaussianHmm(len(chain.start))
    model.moves, model.start, model.mean, model.cov = chain.moves, chain.start, chain.coef[:, 0], chain.cov
    forward, ahead, total = varmodels.SwitchingVar.filtered(model, model.density(x))
    smooth, pairs = varmodels.SwitchingVar.smoothed(model, forward, ahead)
    return np.exp(forward), smooth, pairs, total, model.viterbi(x)


def tidy(spark, panels):
    rows = [(k, i, f"f{j}", float(v)) for k, x in panels.items() for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "panel string, bar long, feature string, value double")


@pytest.mark.parametrize("block_bars", [1, 2, 7, 50, 4096])
@pytest.mark.parametrize("regimes", [2, 3])
def test_blocks_agree_with_the_plain_recursion(spark, block_bars, regimes):
    rng = np.random.default_rng(block_bars)
    panels = {"a": rng.normal(size=(101, 2)) * 2, "b": rng.normal(size=(50, 2)), "c": rng.normal(size=(1, 2))}
    models = {k: random_chain(rng, regimes, 2) for k in panels}
    blocks = chains.gaussian_blocks(tidy(spark, panels), "panel", store.scratch(spark), block_bars)
    assert blocks.rows.count() == sum(-(-len(x) // block_bars) for x in panels.values())
    prob = {(r["panel"], r["bar"]): r for r in chains.probabilities(blocks, models).collect()}
    path = {(r["panel"], r["bar"]): r["regime"] for r in chains.best_states(blocks, models).collect()}
    assert len(prob) == len(path) == 152
    for k, x in panels.items():
        forward, smooth, _, total, best = plain(models[k], x)
        assert np.allclose([prob[k, i]["prob"] for i in range(len(x))], forward, atol=1e-10)
        assert np.allclose([prob[k, i]["smoothed"] for i in range(len(x))], smooth, atol=1e-10)
        assert models[k].loglik == pytest.approx(total, abs=1e-9) and [path[k, i] for i in range(len(x))] == best.tolist()


def test_a_task_gets_blocks_only_and_pairs_are_counted_across_them(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    chain = random_chain(rng, 2, 2)
    blocks = chains.gaussian_blocks(tidy(spark, {"a": x}), "panel", store.scratch(spark), 8)
    assert max(len(r["bars"]) for r in blocks.rows.collect()) == 8 * 8
    before, after, _ = chains.expected(blocks, {"a": chain})
    pairs = blocks.summed(lambda p, b, z: chains.block_states(chain, p, z, before["a", p.block], after["a", p.block])[2].ravel())["a"]
    assert np.allclose(pairs.reshape(2, 2), plain(chain, x)[2], atol=1e-10)


def test_long_products_stay_in_range():
    rng = np.random.default_rng(2)
    moves, logp = rng.dirichlet([1, 1], 2), rng.normal(size=(20_000, 2)) * 30 - 400
    m, log = scans.product(*scans.steps(moves, logp))
    p, total = np.full(2, 0.5), 0.0
    for row in logp:
        p = p @ moves * np.exp(row - row.max())
        total += np.log(p.sum()) + row.max()
        p /= p.sum()
    assert log + np.log((np.full(2, 0.5) @ m).sum()) == pytest.approx(total, rel=1e-12)


def regime_rows(rng, n=300):
    state = (np.arange(n) // 60) % 2
    return rng.normal(size=(n, 2)) * np.where(state[:, None] == 1, 0.8, 0.2)


@pytest.mark.parametrize("block_bars", [32, None])
def test_fits_agree_with_those_in_memory(spark, block_bars):
    rng = np.random.default_rng(3)
    panels = {"a": regime_rows(rng), "b": 3 + 2 * regime_rows(rng, 200)}
    got = varmodels.hmm_regimes(tidy(spark, panels), block_bars=block_bars).toPandas()
    for k, x in panels.items():
        model = varmodels.GaussianHmm().fit(x)
        own = got[got["panel"] == k].sort_values("bar")
        assert (own["regime"].to_numpy() == model.labels).all() and np.allclose(np.stack(own["prob"]), model.prob, atol=1e-6)
    returns = tidy(spark, panels).select("panel", F.col("feature").alias("series"), "bar", F.col("value").alias("ret"))
    for compat in (False, True):
        rows = varmodels.switching_var(returns, lags=2, max_iter=12, compat=compat, block_bars=block_bars).toPandas()
        for k, x in panels.items():
            model = varmodels.SwitchingVar(lags=2, max_iter=12, compat=compat).fit(x)
            own = rows[rows["panel"] == k].sort_values("bar")
            assert own["bar"].tolist() == list(range(2, len(x)))
            assert np.allclose(np.stack(own["prob"]), model.filter, atol=1e-6) and np.allclose(np.stack(own["smoothed"]), model.smooth, atol=1e-6)
    coefs = {(r["panel"], r["regime"], r["source"], r["target"], r["lag"]): r["coefficient"] for r in varmodels.switching_coefficients(returns, lags=2, max_iter=12, block_bars=block_bars).collect()}
    ahead = {(r["panel"], r["series"], r["step"]): r["value"] for r in varmodels.switching_forecast(returns, 3, lags=2, max_iter=12, block_bars=block_bars).collect()}
    for k, x in panels.items():
        model = varmodels.SwitchingVar(lags=2, max_iter=12).fit(x)
        assert coefs[k, 1, "f0", "f1", 2] == pytest.approx(model.coef[1][3, 1], abs=1e-6) and coefs[k, 0, None, "f0", 0] == pytest.approx(model.coef[0][0, 0], abs=1e-6)
        assert np.allclose([[ahead[k, f"f{j}", s] for j in range(2)] for s in (1, 2, 3)], model.predict(x, 3), atol=1e-6)


def test_prefix_scans(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(b), float(v)) for k in ("x", None) for b, v in zip(np.sort(rng.choice(60_000, 400, replace=False)), rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "k string, bar long, v double").repartition(7)
    for keys in ((), ("k",)):
        part = df if keys else df.where("k = 'x'")
        got = ordinals(part, "bar", keys)
        got = running(got, "bar", keys, {"total": F.col("v"), "below": F.when(F.col("v") < 0, 1)}, {"top": F.col("v")})
        got = previous(got, "bar", {"last": "v"}, keys).toPandas()
        for k in ("x", None) if keys else ("x",):
            own = got[got["k"].isna() if k is None else got["k"] == k].sort_values("bar")
            v = np.array([r[2] for r in rows if r[0] == k])
            assert own["number"].tolist() == list(range(400)) and np.allclose(own["total"], np.cumsum(v)) and np.allclose(own["top"], np.maximum.accumulate(v))
            assert np.allclose(own["below"].fillna(0), np.cumsum(v < 0)) and np.isnan(own["last"].iloc[0]) and np.allclose(own["last"].iloc[1:], v[:-1])
    assert ordinals(df.limit(0), "bar").count() == 0
