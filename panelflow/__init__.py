"""Directed influence between series, as Spark jobs."""

from panelflow.config import Settings
from panelflow.session import session

__all__ = ["session", "Settings"]
