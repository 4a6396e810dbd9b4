"""The batch pipeline: `python -m panelflow.cli --sf-dir DIR --out DIR [flags]`, or through spark-submit."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators import backtest, discovery, pairs, panel, robustness, varmodels
from panelflow.plans.panels import features
from panelflow.session import session
from panelflow.sources import adapters, store

log = logging.getLogger("panelflow")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelflow", description=__doc__)
    p.add_argument("--sf-dir", default="", help="folder of the driver's tables")
    p.add_argument("--levels", default="", help="folder of cached levels (cls=…/), used with --skip-fetch")
    p.add_argument("--adapter", default="weekly_lineitem", choices=sorted(adapters.LEVELS))
    p.add_argument("--out", required=True)
    p.add_argument("--skip-fetch", action="store_true", help="read cached levels")
    p.add_argument("--te-only", action="store_true")
    p.add_argument("--lags", type=int, nargs="+", default=[1, 2, 3, 5])
    p.add_argument("--n-regimes", type=int, default=2)
    p.add_argument("--backtest", action="store_true")
    p.add_argument("--recent-window", type=int, default=750)
    p.add_argument("--tc-bps", type=float, default=1.0)
    p.add_argument("--execution-lag", type=int, default=1)
    p.add_argument("--te-refresh-freq", type=int, default=63)
    p.add_argument("--te-lookback", type=int, default=750)
    p.add_argument("--init", type=int, default=252)
    p.add_argument("--step", type=int, default=21)
    p.add_argument("--tc-sweep", type=float, nargs="*", default=None, metavar="BPS", help="costs to run the weights over again; without values 0, 1, 2 and 5")
    return p


def save(df: DataFrame, out: str, name: str) -> DataFrame:
    """Writes an artefact and gives it as read back."""
    df.write.mode("overwrite").parquet(f"{out}/{name}")
    log.info("wrote %s", name)
    return df.sparkSession.read.parquet(f"{out}/{name}")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    levels = store.cached_scan(spark, a.levels) if a.skip_fetch else adapters.LEVELS[a.adapter](spark, a.sf_dir)
    returns = panel.filled(panel.winsorize(panel.observed_returns(levels, panel.observed_calendar(levels))))
    returns = save(returns, a.out, "returns_panel")

    recent = panel.covered(panel.recent(returns, a.recent_window))
    edges = discovery.entropy_matrix(recent, a.lags)
    store.save_matrices(edges, f"{a.out}/te_matrix")
    edges = spark.read.parquet(f"{a.out}/te_matrix").withColumn("lag", F.col("lag").cast("int"))
    top = pairs.top_edges(edges.where(F.col("lag") == min(a.lags)), 40).select("source", "target")
    save(discovery.entropy_decay(recent, top), a.out, "te_decay")
    if a.te_only:
        return

    save(varmodels.lead_matrix(varmodels.lasso_var(recent)), a.out, "lasso_var_matrix")
    leaders = pairs.strength(edges).orderBy(F.desc("strength"), "series").limit(8).select("series")
    few = recent.join(leaders, "series", "left_semi").withColumn("panel", F.lit("top"))
    save(varmodels.switching_var(few, regimes=a.n_regimes, max_iter=50), a.out, "ms_var_probs")
    market = features(returns).groupBy("bar").agg(F.avg("zvol").alias("vol"), F.avg("zmean").alias("mean"))
    tidy = market.unpivot(["bar"], ["vol", "mean"], "feature", "value").withColumn("panel", F.lit("market"))
    regimes = save(varmodels.hmm_regimes(tidy, regimes=a.n_regimes), a.out, "regime_probs")
    save(regimes.select("bar", "regime"), a.out, "regime_labels")
    if not a.backtest:
        return

    def evaluated(name: str, weights: DataFrame, step: int) -> DataFrame:
        pnl = save(backtest.walk_forward(returns, weights, a.init, step, a.tc_bps, a.execution_lag), a.out, f"backtest_{name}pnl")
        save(backtest.equity(pnl), a.out, f"backtest_{name}equity")
        save(backtest.metrics(pnl, change=backtest.turnover(weights)), a.out, f"backtest_{name}metrics")
        return pnl

    evaluated("benchmark_", backtest.inverse_vol_weights(returns, a.init, a.step), a.step)
    refreshed = save(backtest.refresh_edges(returns, None, a.init, a.te_refresh_freq, a.te_lookback), a.out, "te_refreshes")
    weights = save(backtest.lead_weights(returns, refreshed, a.init, 1, a.te_refresh_freq), a.out, "backtest_weights")
    pnl = evaluated("", weights, 1)
    save(backtest.turnover(weights), a.out, "backtest_turnover")
    save(robustness.by_regime(pnl, regimes), a.out, "backtest_per_regime")
    chosen = pairs.top_per(refreshed.withColumn("tie", F.concat_ws("|", "source", "target")), "refresh_bar", 30, tie="tie").where("te > 0")
    save(robustness.churn(chosen, a.te_refresh_freq), a.out, "backtest_pair_churn")
    trials = backtest.walk_forward(returns, backtest.momentum_trials(returns, [5, 10, 21, 63], a.init, a.step), a.init, a.step, a.tc_bps, a.execution_lag, ("trial",))
    save(trials.select("trial", (F.col("bar") - a.init - a.execution_lag).alias("bar"), F.col("net").alias("ret")), a.out, "backtest_trial_returns")
    if a.tc_sweep is not None:
        sweep = backtest.cost_sweep(returns, weights, a.tc_sweep or [0.0, 1.0, 2.0, 5.0], a.init, 1, a.execution_lag)
        save(backtest.metrics(sweep, ("tc_bps",)), a.out, "backtest_tc_sensitivity")


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    args = parser().parse_args(argv)
    run(session(), args)


if __name__ == "__main__":
    main()
