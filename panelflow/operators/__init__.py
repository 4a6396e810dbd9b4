"""The operators, by what they are about; the names most often used."""

from panelflow.operators.backtest import cost_sweep, inverse_vol_weights, lead_weights, metrics, refresh_edges, walk_forward
from panelflow.operators.cv import combinatorial_folds, fold_roles, purged_folds
from panelflow.operators.discovery import best_lag, bootstrap_significance, draws, effective_entropy, entropy_decay, entropy_matrix, information_matrix, lagged_information, mutual_information, regime_entropy, significance, surrogate_significance, transfer_entropy, variable_lags
from panelflow.operators.estimators import LassoVarEstimator, LassoVarModel, RegimeEstimator, RegimeFeatures, RegimeModel
from panelflow.operators.gram import gram_cells
from panelflow.operators.monitor import alert_text, breaks, daily_report, regime_changes
from panelflow.operators.neural import LagAttention, RecurrentNet, attention_edges, neural_granger
from panelflow.operators.panel import align, covered, filled, observed_returns, winsorize
from panelflow.operators.portfolio import constrained, inverse_volatility, kelly_weights, risk_parity
from panelflow.operators.regimes import regime_features
from panelflow.operators.robustness import deflated, overfitting_probability, sharpe_intervals
from panelflow.operators.signals import averaged, board, generate, regime_weights
from panelflow.operators.unitroot import stationarity
from panelflow.operators.varmodels import GaussianHmm, SwitchingVar, hmm_regimes, lasso_forecast, lasso_var, lead_matrix, predicted_regimes, switching_coefficients, switching_forecast, switching_var

__all__ = [
    "alert_text",
    "align",
    "attention_edges",
    "averaged",
    "best_lag",
    "board",
    "bootstrap_significance",
    "breaks",
    "combinatorial_folds",
    "constrained",
    "cost_sweep",
    "covered",
    "daily_report",
    "deflated",
    "draws",
    "effective_entropy",
    "entropy_decay",
    "entropy_matrix",
    "filled",
    "fold_roles",
    "GaussianHmm",
    "generate",
    "gram_cells",
    "hmm_regimes",
    "information_matrix",
    "inverse_vol_weights",
    "inverse_volatility",
    "kelly_weights",
    "LagAttention",
    "lagged_information",
    "lasso_forecast",
    "lasso_var",
    "LassoVarEstimator",
    "LassoVarModel",
    "lead_matrix",
    "lead_weights",
    "metrics",
    "mutual_information",
    "neural_granger",
    "observed_returns",
    "overfitting_probability",
    "predicted_regimes",
    "purged_folds",
    "RecurrentNet",
    "refresh_edges",
    "regime_changes",
    "regime_entropy",
    "regime_features",
    "regime_weights",
    "RegimeEstimator",
    "RegimeFeatures",
    "RegimeModel",
    "risk_parity",
    "sharpe_intervals",
    "significance",
    "stationarity",
    "surrogate_significance",
    "switching_coefficients",
    "switching_forecast",
    "switching_var",
    "SwitchingVar",
    "transfer_entropy",
    "variable_lags",
    "walk_forward",
    "winsorize",
]
