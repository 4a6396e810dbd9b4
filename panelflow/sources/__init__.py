"""Where panels come from: tables, caches, HTTP, the universe."""

from panelflow.sources.adapters import LEVELS
from panelflow.sources.http import HttpLevels, register
from panelflow.sources.store import cached_scan, demo_matrix, fetch, matrix_lags, optional, save_matrices
from panelflow.sources.universe import load, transforms

__all__ = ["cached_scan", "demo_matrix", "fetch", "HttpLevels", "LEVELS", "load", "matrix_lags", "optional", "register", "save_matrices", "transforms"]
