"""Models of the engine as pyspark.ml estimators: parameters, pipelines, and models that are saved and loaded.

A fitted model's numbers are a parameter like others (JSON text), so the library's own writers keep
them. All work on tidy tables, as the operators do.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators import chains, regimes, varmodels
from panelflow.sources import store


class _Regimes(Params):
    regimes = Param(Params._dummy(), "regimes", "number of regimes", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the first centres", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds at most", TypeConverters.toInt)
    blockBars = Param(Params._dummy(), "blockBars", "bars of a block", TypeConverters.toInt)
    panelCol = Param(Params._dummy(), "panelCol", "column that parts panels", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(regimes=2, seed=42, maxIter=200, blockBars=chains.BLOCK_BARS, panelCol="panel")

    def blocks(self, features: DataFrame) -> chains.Blocks:
        key = self.getOrDefault(self.panelCol)
        return chains.gaussian_blocks(features, key, store.scratch(features.sparkSession), self.getOrDefault(self.blockBars))


class RegimeFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Returns (series, bar, ret) to the features of their roles (panel, bar, feature, value)."""

    roles = Param(Params._dummy(), "roles", "[[feature, [series, ...], kind], ...] as JSON", TypeConverters.toString)
    window = Param(Params._dummy(), "window", "bars of the rolling windows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, roles: str | None = None, window: int | None = None):
        super().__init__()
        self._setDefault(roles=json.dumps(regimes.ROLES), window=21)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        roles = [tuple(r) for r in json.loads(self.getOrDefault(self.roles))]
        found = regimes.regime_features(dataset, roles, self.getOrDefault(self.window))
        return found.withColumn("panel", F.lit("market"))


class RegimeEstimator(Estimator, _Regimes, DefaultParamsReadable, DefaultParamsWritable):
    """Hidden Markov regimes of features (panel, bar, feature, value)."""

    @keyword_only
    def __init__(self, *, regimes: int | None = None, seed: int | None = None, maxIter: int | None = None, blockBars: int | None = None, panelCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RegimeModel:
        get = self.getOrDefault
        found = chains.gaussian_chains(self.blocks(dataset), get(self.regimes), get(self.maxIter), seed=get(self.seed))
        numbers = {str(k): {n: getattr(c, n).tolist() for n in ("moves", "start", "coef", "cov")} for k, c in found.items()}
        return self._copyValues(RegimeModel(chains=json.dumps(numbers)))


class RegimeModel(Model, _Regimes, DefaultParamsReadable, DefaultParamsWritable):
    """(panel, bar, regime, prob) of features under the regimes of their panel."""

    chains = Param(Params._dummy(), "chains", "each panel's parameters as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, chains: str | None = None):
        super().__init__()
        self._setDefault(chains="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def parameters(self) -> dict:
        held = json.loads(self.getOrDefault(self.chains))
        return {k: chains.Chain(*[np.array(v[n]) for n in ("moves", "start", "coef", "cov")], 1) for k, v in held.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, models = self.getOrDefault(self.panelCol), self.parameters()
        blocks = self.blocks(dataset.withColumn(key, F.col(key).cast("string")).where(F.col(key).isin(list(models))))
        prob = chains.probabilities(blocks, models).select(key, "bar", F.col("smoothed").alias("prob"))
        return chains.best_states(blocks, models).join(prob, [key, "bar"]).select(key, "bar", "regime", "prob")


class LassoVarEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse vector autoregression of returns (series, bar, ret), which have a row for each series and bar."""

    lags = Param(Params._dummy(), "lags", "number of lags", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "penalty; below 0: chosen by the criterion", TypeConverters.toFloat)
    criterion = Param(Params._dummy(), "criterion", "bic or aic", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, lags: int | None = None, alpha: float | None = None, criterion: str | None = None):
        super().__init__()
        self._setDefault(lags=5, alpha=-1.0, criterion="bic")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LassoVarModel:
        alpha = self.getOrDefault(self.alpha)
        rows = varmodels.lasso_var(dataset, self.getOrDefault(self.lags), None if alpha < 0 else alpha, self.getOrDefault(self.criterion))
        # what isn't zero: a model's own size
        kept = rows.where("coef <> 0 or lag = 1").select("target", "source", "lag", "coef", "alpha", "intercept").collect()
        return self._copyValues(LassoVarModel(coefficients=json.dumps([list(r) for r in kept])))


class LassoVarModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """(series, step, value): forecasts `steps` bars ahead of returns."""

    coefficients = Param(Params._dummy(), "coefficients", "[[target, source, lag, coef, alpha, intercept], ...] as JSON", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "bars ahead", TypeConverters.toInt)
    lags = Param(Params._dummy(), "lags", "number of lags", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, coefficients: str | None = None, steps: int | None = None):
        super().__init__()
        self._setDefault(coefficients="[]", steps=1, lags=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def table(self, dataset: DataFrame) -> DataFrame:
        rows = [tuple(r) for r in json.loads(self.getOrDefault(self.coefficients))]
        return dataset.sparkSession.createDataFrame(rows, "target string, source string, lag int, coef double, alpha double, intercept double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return varmodels.lasso_forecast(dataset, self.table(dataset), self.getOrDefault(self.steps))
