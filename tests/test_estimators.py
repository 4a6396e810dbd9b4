import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from panelflow.operators import varmodels
from panelflow.operators.estimators import LassoVarEstimator, LassoVarModel, RegimeEstimator, RegimeFeatures
from panelflow.operators.regimes import regime_features

ROLES = [("vol", ["NOT", "A"], "volatility"), ("drift", ["B"], "mean"), ("nobody", ["X", "Y"], "mean")]


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(2)
    state = (np.arange(260) // 65) % 2
    x = rng.normal(size=(260, 2)) * np.where(state[:, None] == 1, 3.0, 0.5)
    rows = [("AB"[j], i, None if (i, j) == (40, 1) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "series string, bar long, ret double")


def test_features_of_roles(returns):
    import pandas as pd

    wide = returns.toPandas().pivot(index="bar", columns="series", values="ret").sort_index()
    want = pd.DataFrame({"vol": wide["A"].rolling(21).std() * np.sqrt(252), "drift": wide["B"].rolling(21).mean()}).dropna()
    want = (want - want.mean()) / want.std()
    got = regime_features(returns, ROLES).toPandas().pivot(index="bar", columns="feature", values="value").sort_index()
    assert list(got.columns) == ["drift", "vol"] and got.index.tolist() == want.index.tolist() and 45 not in got.index
    assert np.allclose(got[["vol", "drift"]], want[["vol", "drift"]])
    assert regime_features(returns).count() == 0  # nobody plays the usual roles here
    flat = returns.selectExpr("series", "bar", "1.0 ret")
    assert {r["value"] for r in regime_features(flat, ROLES[1:2]).collect()} == {1.0}


def test_pipeline_is_fitted_saved_and_loaded(spark, returns, tmp_path):
    pipeline = Pipeline(stages=[RegimeFeatures(roles=json.dumps(ROLES)), RegimeEstimator(blockBars=50)])
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(returns)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    key = lambda df: sorted((r["bar"], r["regime"], *np.round(r["prob"], 9)) for r in df.collect())
    features = RegimeFeatures(roles=json.dumps(ROLES)).transform(returns)
    want = key(varmodels.hmm_regimes(features))
    assert key(model.transform(returns)) == key(loaded.transform(returns)) == want and len({w[1] for w in want}) == 2
    assert loaded.stages[1].getOrDefault("blockBars") == 50


def test_sparse_autoregression(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[1:, 2] += 0.9 * x[:-1, 0]
    returns = spark.createDataFrame([("ABC"[j], i, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "series string, bar long, ret double")
    model = LassoVarEstimator(lags=2).fit(returns)
    model.save(str(tmp_path / "var"))
    loaded = LassoVarModel.load(str(tmp_path / "var"))
    loaded.set(loaded.steps, 2)
    want = {(r["series"], r["step"]): r["value"] for r in varmodels.lasso_forecast(returns, varmodels.lasso_var(returns, 2), 2).collect()}
    got = {(r["series"], r["step"]): r["value"] for r in loaded.transform(returns).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
