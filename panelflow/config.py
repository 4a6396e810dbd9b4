"""Settings with typed defaults; the environment overrides them, in any letter case."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data/raw"
    output_dir: str = "data/outputs"
    start_date: str = "2005-01-01"
    te_k_neighbors: int = 5
    te_history: int = 3
    te_lags: tuple[int, ...] = (1, 2, 3, 5)
    n_regimes: int = 2
    significance_alpha: float = 0.05
    bootstrap_samples: int = 1000
    tc_bps: float = 1.0
    execution_lag: int = 1
    webhook_url: str = ""
    smtp_host: str = ""
    smtp_port: int = 587
    smtp_user: str = ""
    smtp_password: str = ""
    series_api_key: str = ""

    @classmethod
    def load(cls, env: dict[str, str] | None = None, dotenv: str | None = None) -> Settings:
        """Defaults, then the .env file's lines, then the environment; unknown names are ignored."""
        held: dict[str, str] = {}
        if dotenv and os.path.exists(dotenv):
            with open(dotenv) as f:
                held |= dict(line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        held |= dict(os.environ if env is None else env)
        given = {k.strip().lower(): v.strip() for k, v in held.items()}
        out = {}
        for f in fields(cls):
            if f.name in given:
                kind = type(f.default)
                value = given[f.name]
                out[f.name] = tuple(int(x) for x in value.strip("[]").split(",")) if kind is tuple else kind(value)
        return cls(**out)
