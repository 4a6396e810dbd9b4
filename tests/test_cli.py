from panelflow import cli


def test_pipeline_writes_its_artefacts(spark, tmp_path):
    args = ["--sf-dir", "/root/testdata/sf0.001", "--out", str(tmp_path), "--lags", "1", "2", "--recent-window", "120", "--backtest", "--tc-sweep", "--init", "250", "--step", "26", "--te-refresh-freq", "52", "--te-lookback", "120"]
    cli.run(spark, cli.parser().parse_args(args))
    names = {p.name for p in tmp_path.iterdir()}
    assert {"returns_panel", "te_matrix", "te_decay", "lasso_var_matrix", "regime_probs", "regime_labels", "backtest_metrics", "backtest_turnover", "backtest_per_regime", "backtest_pair_churn", "backtest_trial_returns", "backtest_tc_sensitivity"} <= names
    assert spark.read.parquet(str(tmp_path / "backtest_tc_sensitivity")).count() == 4
