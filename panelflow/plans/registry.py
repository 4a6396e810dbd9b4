"""All registered queries: importing the modules that define them fills the registry."""

from panelflow.plans import graphs, panels, strategies  # noqa: F401
from panelflow.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
