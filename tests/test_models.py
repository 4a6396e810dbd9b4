import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.config import Settings
from panelflow.functions.numeric import kmeans, lasso
from panelflow.operators import neural, unitroot, varmodels


def panel_of(spark, x, names="ABCD"):
    return spark.createDataFrame([(names[j], i, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "series string, bar long, ret double")


@pytest.fixture(scope="module")
def sparse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)) * 0.1
    for t in range(1, 500):
        x[t, 1] += 0.5 * x[t - 1, 0] + 0.2 * x[t - 1, 1]
    return x


def test_stationarity(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=300), rng.normal(size=300).cumsum()])
    rows = {r["series"]: r for r in unitroot.stationarity(panel_of(spark, x)).collect()}
    assert rows["A"]["stationary"] and not rows["B"]["stationary"] and rows["A"]["adf_p"] < 0.05 < rows["B"]["adf_p"]
    assert unitroot.stationarity(panel_of(spark, x[:10])).first()["stationary"] is None


def test_lasso_var_finds_the_planted_link(spark, sparse):
    coefs = varmodels.lasso_var(panel_of(spark, sparse), lags=2)
    lead = {(r["source"], r["target"]): r["lead"] for r in varmodels.lead_matrix(coefs).collect()}
    assert len(lead) == 16 and max((k for k in lead if k[0] != k[1]), key=lead.get) == ("A", "B")
    assert coefs.where("target = 'B' and source = 'A' and lag = 1").first()["coef"] == pytest.approx(0.5, abs=0.15)  # a knot of the path: shrunk until the first noise column enters
    fixed = varmodels.lasso_var(panel_of(spark, sparse), lags=1, alpha=10.0)
    assert {r["coef"] for r in fixed.collect()} == {0.0}


def test_lasso_optimality():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    y = x @ np.array([1, 0, 0, -2, 0, 0]) + 0.1 * rng.normal(size=200)
    b = lasso(x, y, 0.1)
    grad = x.T @ (y - x @ b) / 200
    assert np.allclose(grad[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(grad[b == 0]) <= 0.1 + 1e-6).all()


def test_forecast():
    coef = np.array([[[0.5, 0.0], [1.0, 0.0]]])
    assert varmodels.forecast(coef, np.array([[2.0, 0.0]]), 2).tolist() == [[1.0, 2.0], [0.5, 1.0]]


@pytest.fixture(scope="module")
def regimes():
    rng = np.random.default_rng(3)
    state = (np.arange(400) // 80) % 2
    return state, rng.normal(size=(400, 2)) * np.where(state[:, None] == 1, 0.8, 0.2)


def test_hmm_recovers_regimes(spark, regimes):
    state, x = regimes
    model = varmodels.GaussianHmm().fit(x)
    assert (model.labels == state).mean() > 0.95 and np.allclose(model.prob.sum(1), 1)
    assert np.trace(model.cov[0]) < np.trace(model.cov[1])
    rows = [("p", i, f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    features = spark.createDataFrame(rows, "panel string, bar long, feature string, value double")
    got = varmodels.hmm_regimes(features).toPandas().sort_values("bar")
    assert (got["regime"].to_numpy() == model.labels).all()
    assert varmodels.hmm_regimes(features, method="kmeans").count() == 400
    with pytest.raises(ValueError, match="method"):
        varmodels.hmm_regimes(features, method="other")


@pytest.mark.parametrize("compat", [False, True])
def test_switching_var(spark, regimes, compat):
    state, x = regimes
    model = varmodels.SwitchingVar(lags=1, max_iter=30, compat=compat).fit(x)
    assert np.allclose(model.smooth.sum(1), 1) and model.predict(x, 3).shape == (3, 2) and model.current() in (0, 1)
    if not compat:
        agree = (model.smooth.argmax(1) == state[1:]).mean()
        assert max(agree, 1 - agree) > 0.9
    panel = panel_of(spark, x).selectExpr("'p' panel", "*")
    assert varmodels.switching_var(panel, lags=1, max_iter=5).count() == 399
    assert varmodels.switching_coefficients(panel, lags=1, max_iter=5).count() == 2 * (2 + 4)


def test_attention_finds_the_planted_lag(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    y = 0.2 * rng.normal(size=600)
    y[3:] += 0.8 * x[:-3, 0]
    model = neural.LagAttention(4, 6).fit(x, y, epochs=120)
    assert model.scale().argmax() == 0 and model.lags()[0] == 3 and model.ic > 0.7
    few = neural.LagAttention(4, 6, top=2).fit(x, y, epochs=5)
    assert (np.count_nonzero(few.attention(), axis=1) == 2).all() and few.lags()[0] == 3
    assert (neural.LagAttention(4, 6, temperature=0.5).fit(x, y, epochs=120).lags()[0], neural.LagAttention(4, 6).fit(x, y, epochs=120).loss) == (3, model.loss)
    strong = neural.LagAttention(4, 6).fit(x, y, epochs=120, l1=1.0)
    assert strong.scale().sum() < model.scale().sum()
    with pytest.raises(ValueError, match="few"):
        model.fit(x[:12], y[:12])
    with pytest.raises(ValueError, match="tensor"):
        model.predict(np.zeros((5, 3, 6)))
    edges = neural.attention_edges(panel_of(spark, np.column_stack([x[:, :3], y])), ["D"], max_lag=5, epochs=80).collect()
    assert max(edges, key=lambda r: r["weight"])["source"] == "A"


def test_rank_loss_gradient():
    rng = np.random.default_rng(5)
    guess, y = rng.normal(size=8), rng.normal(size=8)
    _, g = neural.rank_loss(guess, y)
    for i in range(8):
        step = np.eye(8)[i] * 1e-6
        assert g[i] == pytest.approx((neural.rank_loss(guess + step, y)[0] - neural.rank_loss(guess - step, y)[0]) / 2e-6, abs=1e-6)
    assert neural.rank_loss(guess, np.ones(8))[0] == 0


def test_recurrent_gradients():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(5, 4, 3)), rng.normal(size=5)
    net = neural.RecurrentNet(3, 2, 4, dropout=0.0)
    assert {"w0", "w1", "u1", "b1"} <= set(net.p)
    dropping = neural.RecurrentNet(3, 2, 4, dropout=0.5)
    drawn = [dropping.forward(x, np.random.default_rng(s))[0] for s in (0, 0, 1)]
    assert (drawn[0] == drawn[1]).all() and (drawn[0] != drawn[2]).any() and (dropping.forward(x)[0] == dropping.forward(x)[0]).all()
    _, grads = net.gradient(x, y)
    for name, p in net.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        held = p[at]
        values = []
        for step in (1e-6, -1e-6):
            p[at] = held + step
            values.append(((net.forward(x)[0] - y) ** 2).mean())
        p[at] = held
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-6), name


def test_granger_scores():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    x[1:, 0] = 0.9 * x[:-1, 1] + 0.1 * rng.normal(size=399)
    scores = neural.granger_scores(x, history=3, epochs=25, hidden=8, embed=2, rate=1e-2)
    assert (scores >= 0).all() and scores[0] > scores[1]


def test_kmeans_and_settings(tmp_path):
    x = np.concatenate([np.zeros((20, 2)), np.ones((20, 2)) * 9])
    labels = kmeans(x, 2)
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1]
    (tmp_path / ".env").write_text("TC_BPS=3\n# no\nte_lags=[1, 4]\nother=1\n")
    s = Settings.load({"Te_K_Neighbors": "7"}, str(tmp_path / ".env"))
    assert (s.te_k_neighbors, s.tc_bps, s.te_lags, s.n_regimes) == (7, 3.0, (1, 4), 2)


def test_lasso_path_and_criterion():
    """Each knot satisfies the lasso's conditions at its penalty; the criterion finds the planted columns."""
    from panelflow.functions.numeric import lasso_ic, lasso_path

    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 8)) @ (np.eye(8) + 0.3 * rng.normal(size=(8, 8)))
    x, y = x - x.mean(0), x @ np.array([1.0, 0, -0.5, 0, 0, 0.2, 0, 0]) + 0.3 * rng.normal(size=150)
    y = y - y.mean()
    path = lasso_path(x, y)
    assert [a for a, _ in path] == sorted((a for a, _ in path), reverse=True) and path[-1][0] == pytest.approx(0, abs=1e-12)
    for alpha, b in path:
        assert np.allclose(b, lasso(x, y, alpha, max_iter=100_000, tol=1e-13), atol=1e-7)
    assert np.allclose(path[-1][1], np.linalg.lstsq(x, y, rcond=None)[0])
    b, alpha = lasso_ic(x, y)
    assert {0, 2, 5} <= set(np.flatnonzero(b)) and alpha > 0
    assert np.count_nonzero(lasso_ic(x, y, "aic")[0]) >= np.count_nonzero(b)
    assert not lasso_ic(x, np.zeros(150))[0].any()


def test_lasso_var_keeps_the_scale_and_forecasts(spark, sparse):
    """The penalty is on coefficients of the series as they are; forecasts are those of the plain recursion."""
    scaled = sparse * np.array([1.0, 10.0, 1.0, 1.0]) + np.array([0.0, 5.0, 0.0, 0.0])
    coefs = varmodels.lasso_var(panel_of(spark, scaled), lags=2, alpha=0.05)
    rows = coefs.collect()
    x = np.column_stack([scaled[1:-1], scaled[:-2]])
    want = lasso(x - x.mean(0), scaled[2:, 1] - scaled[2:, 1].mean(), 0.05)
    got = sorted((r["lag"], r["source"], r["coef"]) for r in rows if r["target"] == "B")
    assert np.allclose([g[2] for g in got], want, atol=1e-9)
    names = sorted({r["target"] for r in rows})
    coef = np.zeros((2, 4, 4))
    for r in rows:
        coef[r["lag"] - 1, names.index(r["target"]), names.index(r["source"])] = r["coef"]
    constant = np.array([next(r["intercept"] for r in rows if r["target"] == n) for n in names])
    want = varmodels.forecast(coef, scaled, 3, constant)
    got = {(r["series"], r["step"]): r["value"] for r in varmodels.lasso_forecast(panel_of(spark, scaled), coefs, 3).collect()}
    assert got == {(n, k + 1): pytest.approx(want[k, i]) for i, n in enumerate(names) for k in range(3)}


def test_regimes_of_new_rows(spark):
    rng = np.random.default_rng(12)
    old = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 1.0, (60, 2))])
    new = np.concatenate([rng.normal(0, 0.2, (10, 2)), rng.normal(3, 1.0, (10, 2))])
    tidy = lambda x: spark.createDataFrame([("p", i, f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "panel string, bar long, feature string, value double")
    got = [r["regime"] for r in varmodels.predicted_regimes(tidy(old), tidy(new)).orderBy("bar").collect()]
    assert got == [0] * 10 + [1] * 10
    got = [r["regime"] for r in varmodels.predicted_regimes(tidy(old), tidy(new), method="kmeans").orderBy("bar").collect()]
    assert len(set(got[:10])) == len(set(got[10:])) == 1 and got[0] != got[-1]
    ahead = varmodels.switching_forecast(panel_of(spark, old[:, :2] * 0.01).withColumn("panel", F.lit("p")), 2, max_iter=5).collect()
    assert sorted((r["series"], r["step"]) for r in ahead) == [("A", 1), ("A", 2), ("B", 1), ("B", 2)]
