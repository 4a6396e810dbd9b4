"""Queries about signals, portfolios, backtests, robustness and breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.functions.numeric import expected_max_sharpe
from panelflow.operators import backtest, chains, cv, discovery, monitor, neural, pairs, portfolio, robustness, signals, unitroot, varmodels
from panelflow.plans.base import CORR, EDGES, SLOPE, H, K, edges, entropy_sql, full_panel, pair_sql, panel_sql, query, r, sql_r, with_
from panelflow.plans.graphs import _DECAYED, _HITS, _SIGMA, PARTED, _decay
from panelflow.plans.panels import _FEATURES, _REGIMES, market_regimes, named_features
from panelflow.sources import store
from panelflow.sources.adapters import table

P1 = [*panel_sql(), pair_sql(1)]
GRAPH = [*P1, EDGES]
INIT, STEP = 104, 13

# -- signals --------------------------------------------------------------------------------------

_LATEST = "latest AS (SELECT series, ret FROM panel WHERE bar = (SELECT max(bar) FROM panel))"


def latest(rows):
    return rows.join(F.broadcast(rows.agg(F.max("bar").alias("m"))), F.col("bar") == F.col("m")).select("series", "ret")


_NOW = "now_ AS (SELECT regime FROM regimes ORDER BY bar DESC LIMIT 1)"
_BY_REGIME = [_FEATURES, _REGIMES, _NOW]
_SIGNALS = f"""coefs AS (SELECT source, target, coalesce({SLOPE}, 0.0) AS coefficient FROM pairs JOIN regimes USING (bar) WHERE regime = (SELECT regime FROM now_) GROUP BY source, target),
signals AS (SELECT e.source AS leader, e.target AS follower, e.lag, e.te AS te_score, coalesce(c.coefficient, 0.0) AS coefficient, l.ret AS leader_return, coalesce(c.coefficient, 0.0) * l.ret AS raw_signal, 1 / (1 + exp(-10 * e.te)) AS confidence
FROM edges e LEFT JOIN coefs c ON c.source = e.source AND c.target = e.target JOIN latest l ON l.series = e.source WHERE e.te >= 0.01 ORDER BY e.te DESC, e.source, e.target LIMIT 12)"""


def current_regime(rows) -> int:
    """The regime of the last bar: one number."""
    last = market_regimes(rows).agg(F.max_by("regime", "bar")).first()[0]
    return 0 if last is None else int(last)


def _signals(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    coefficients = pairs.regime_regression(rows, market_regimes(rows), 1, 0).select("regime", "source", "target", F.coalesce("beta", F.lit(0.0)).alias("coefficient"))
    return signals.generate(edges(spark, sf_dir), coefficients, latest(rows), regime=current_regime(rows), threshold=0.01, top=12)


@query(with_(*GRAPH, _LATEST, *_BY_REGIME, _SIGNALS, last=f"SELECT leader, follower, lag, {sql_r('te_score')} AS te_score, (SELECT regime FROM now_) AS regime, {sql_r('coefficient')} AS coefficient, {sql_r('leader_return')} AS leader_return, {sql_r('raw_signal')} AS raw_signal, {sql_r('confidence')} AS confidence FROM signals"))
def lead_signals(spark, sf_dir):
    return _signals(spark, sf_dir).withColumns({c: r(c) for c in ("te_score", "coefficient", "leader_return", "raw_signal", "confidence")})


@query(with_(*GRAPH, _LATEST, *_BY_REGIME, _SIGNALS, "w AS (SELECT *, te_score / sum(te_score) OVER (PARTITION BY follower) AS w FROM signals)", last=f"SELECT follower, {sql_r('sum(w * raw_signal)')} AS expected_return, {sql_r('sum(w * confidence)')} AS confidence, arg_min(leader, (-w, leader)) AS dominant_leader, string_agg(leader, ',' ORDER BY leader) AS leaders FROM w GROUP BY follower"))
def model_average(spark, sf_dir):
    out = signals.averaged(_signals(spark, sf_dir))
    return out.select("follower", r("expected_return").alias("expected_return"), r("confidence").alias("confidence"), "dominant_leader", F.array_join("leaders.name", ",").alias("leaders"))


@query(
    with_(
        *panel_sql(), *_BY_REGIME, PARTED, *entropy_sql([1], "parted"),
        "by_regime AS (SELECT split_part(source, ':', 1)::INT AS regime, split_part(source, ':', 2) AS source, split_part(target, ':', 2) AS target, te FROM te)",
        "chosen AS (SELECT coalesce(max(CASE WHEN regime = (SELECT regime FROM now_) THEN regime END), max(CASE WHEN regime = 0 THEN regime END)) AS r FROM by_regime)",
        "top AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY te DESC, source) AS k FROM by_regime WHERE te >= 0.01 AND regime = (SELECT r FROM chosen))",
        last=f"SELECT target AS follower, source AS leader, {sql_r('te / sum(te) OVER (PARTITION BY target)')} AS weight FROM top WHERE k <= 3",
    )
)
def regime_weights(spark, sf_dir):
    """Leaders by the entropies of the current regime's bars; of regime 0's where the current one has too few."""
    rows = full_panel(spark, sf_dir)
    by_regime = discovery.regime_entropy(rows, market_regimes(rows), [1], 60, k=K, history=H, noise=0.0)
    return signals.regime_weights(by_regime, current_regime(rows), 0).withColumn("weight", r("weight"))


#: Stand-in markets of the adapters' series, one of each kind; RO is of none that is known.
_KINDS = {"AF": "equity", "AO": "bond", "NF": "fx", "NO": "crypto", "RF": "weekly_macro"}
_MARKETS = "markets AS (SELECT series, CASE series " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in _KINDS.items()) + " ELSE 'other' END AS market FROM (SELECT DISTINCT series FROM panel))"
_TIMING = """CASE WHEN lm = 'weekly_macro' THEN 'delayed data' WHEN fm = 'equity' THEN 'actionable' WHEN lm = 'equity' AND fm IN ('fx', 'crypto') THEN 'likely priced' WHEN lm = 'fx' AND fm = 'fx' THEN 'likely priced'
WHEN fm = 'crypto' THEN 'likely priced' WHEN lm IN ('bond', 'credit') AND fm = 'fx' THEN 'likely priced' ELSE 'actionable' END"""


def _market():
    found = F.lit("other")
    for name, market in _KINDS.items():
        found = F.when(F.col("series") == name, market).otherwise(found)
    return found.alias("market")


@query(with_(*GRAPH, _MARKETS, last=f"SELECT source, target, {_TIMING} AS timing FROM (SELECT e.*, a.market AS lm, b.market AS fm FROM edges e JOIN markets a ON a.series = e.source JOIN markets b ON b.series = e.target)"))
def timing_class(spark, sf_dir):
    markets = full_panel(spark, sf_dir).select("series").distinct().select("series", _market())
    left = markets.select(F.col("series").alias("source"), F.col("market").alias("lm"))
    right = markets.select(F.col("series").alias("target"), F.col("market").alias("fm"))
    rows = edges(spark, sf_dir).join(left, "source").join(right, "target")
    return rows.select("source", "target", signals.timing(F.col("lm"), F.col("fm")).alias("timing"))


_KNOWN = [(s, m) for m, names in signals.MARKETS.items() for s in names.split()]


_TICKERS = [s for s, _ in _KNOWN] + ["NEW"]
_LISTED = f"""listed AS (SELECT DISTINCT p_size AS size, ([{', '.join(repr(s) for s in _TICKERS)}])[p_size % {len(_TICKERS)} + 1] AS ticker FROM part),
known AS (SELECT size, ticker, coalesce(m, 'other') AS market FROM listed LEFT JOIN (VALUES {', '.join(map(str, _KNOWN))}) AS t(s, m) ON s = ticker)"""


@query(with_(_LISTED, last=f"SELECT source, target, ls, fs, {_TIMING} AS timing FROM (SELECT a.ticker AS source, b.ticker AS target, a.size AS ls, b.size AS fs, a.market AS lm, b.market AS fm FROM known a JOIN known b ON a.size <> b.size)"))
def market_timing(spark, sf_dir):
    """The rule for every two sizes of part, which stand for series of known markets and for one that isn't."""
    ticker = F.element_at(F.array(*map(F.lit, _TICKERS)), (F.col("p_size") % len(_TICKERS) + 1).cast("int"))
    listed = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), ticker.alias("ticker")).distinct()
    left = listed.select(F.col("ticker").alias("source"), F.col("size").alias("ls"))
    right = listed.select(F.col("ticker").alias("target"), F.col("size").alias("fs"))
    rows = left.join(right, F.col("ls") != F.col("fs"))
    return rows.select("source", "target", "ls", "fs", signals.timing(signals.market_of(F.col("source")), signals.market_of(F.col("target"))).alias("timing"))


def _split_sql(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS side, leader, follower, {sql_r('te')} AS te, {_TIMING} AS timing FROM board WHERE {_TIMING} {condition}"


_BOARD = f"""cc AS (SELECT source, target, CASE WHEN count(*) > 20 THEN coalesce({CORR}, 0.0) ELSE 0.0 END AS corr FROM pairs GROUP BY source, target),
bb AS (SELECT source, target, corr, CASE WHEN a.s > 0 THEN corr * b.s / a.s END AS beta FROM cc JOIN sig a ON a.series = source JOIN sig b ON b.series = target),
top AS (SELECT * FROM edges ORDER BY te DESC, source, target LIMIT 20),
board AS (SELECT top.source AS leader, top.target AS follower, lag, te, least(te / max(te) OVER (), 1.0) AS te_strength, corr, beta, coalesce(beta, 0.0) * latest.ret AS expected_return, rate AS hit_rate, rates.n AS hit_n, a.market AS lm, b.market AS fm
FROM top JOIN bb ON bb.source = top.source AND bb.target = top.target JOIN rates ON rates.source = top.source AND rates.target = top.target JOIN latest ON latest.series = top.source JOIN markets a ON a.series = top.source JOIN markets b ON b.series = top.target)"""
_BOARDED = [*GRAPH, _SIGMA, _HITS, _LATEST, _MARKETS, _BOARD]


def _board(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    markets = rows.select("series").distinct().select("series", _market())
    beta = pairs.scaled_beta(rows)
    return signals.board(edges(spark, sf_dir), beta, beta, pairs.hit_rate(rows), latest(rows), markets)


@query(with_(*_BOARDED, last=f"SELECT leader, follower, lag, {sql_r('te')} AS te, {sql_r('te_strength', 6)} AS te_strength, {sql_r('corr')} AS corr, {sql_r('beta')} AS beta, {sql_r('expected_return')} AS expected_return, {sql_r('hit_rate', 6)} AS hit_rate, hit_n, {_TIMING} AS timing FROM board"))
def signal_board(spark, sf_dir):
    return _board(spark, sf_dir).withColumns({"te": r("te"), "te_strength": r("te_strength", 6), "corr": r("corr"), "beta": r("beta"), "expected_return": r("expected_return"), "hit_rate": r("hit_rate", 6)})


@query(with_(*_BOARDED, last=_split_sql("actionable", "= 'actionable'") + " UNION ALL " + _split_sql("other", "<> 'actionable'")))
def actionable_split(spark, sf_dir):
    first, rest = signals.split_actionable(_board(spark, sf_dir))
    rows = first.withColumn("side", F.lit("actionable")).union(rest.withColumn("side", F.lit("other")))
    return rows.select("side", "leader", "follower", r("te").alias("te"), "timing")


@query(with_(*_BOARDED, last=f"SELECT count(*) AS signals, arg_min(leader || ' > ' || follower, (-abs(expected_return), leader || ' > ' || follower)) AS strongest, {sql_r('avg(abs(expected_return))')} AS mean_abs_return, {sql_r('max(hit_rate)', 6)} AS best_hit_rate FROM board"))
def signal_summary(spark, sf_dir):
    return signals.summary(_board(spark, sf_dir)).withColumns({"mean_abs_return": r("mean_abs_return"), "best_hit_rate": r("best_hit_rate", 6)})


@query(with_(*_DECAYED, last=f"SELECT source, target, lag, {sql_r('te')} AS te, category FROM (SELECT *, min(lag) OVER (PARTITION BY source, target) AS m FROM decay) WHERE lag = m AND category IN ('Next-day tradable', 'Swing (tradable)', 'Slow decay (tradable)')"))
def tradable_board(spark, sf_dir):
    return signals.tradable(_decay(spark, sf_dir)).select("source", "target", "lag", r("te").alias("te"), "category")


# -- portfolios -----------------------------------------------------------------------------------

_INVERSE = "iv AS (SELECT series, (1.0 / s) / sum(1.0 / s) OVER () AS weight FROM sig WHERE s > 0)"


@query(with_(*panel_sql(), _SIGMA, _INVERSE, last=f"SELECT series, {sql_r('weight')} AS weight FROM iv"))
def inverse_vol_weights(spark, sf_dir):
    return portfolio.inverse_volatility(full_panel(spark, sf_dir)).withColumn("weight", r("weight"))


@query(with_(*panel_sql(), _SIGMA, _INVERSE, """c1 AS (SELECT series, CASE WHEN series LIKE 'A%' THEN 'a' WHEN series LIKE 'N%' THEN 'n' ELSE 'other' END AS sector, least(greatest(weight, -0.15), 0.15) AS w FROM iv),
c2 AS (SELECT *, sum(abs(w)) OVER (PARTITION BY sector) AS g FROM c1), c3 AS (SELECT series, sector, CASE WHEN g > 0.25 THEN w * 0.25 / g ELSE w END AS w FROM c2)""", last=f"SELECT series, sector, {sql_r('w / sum(abs(w)) OVER ()')} AS weight FROM c3"))
def constrained_weights(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    sectors = rows.select("series").distinct().select("series", F.when(F.col("series").startswith("A"), "a").when(F.col("series").startswith("N"), "n").alias("sector"))
    return portfolio.constrained(portfolio.inverse_volatility(rows), sectors, 0.15, 0.25).withColumn("weight", r("weight"))


def _forecasts(rows):
    mu = rows.groupBy("series").agg(F.avg("ret").alias("mu")).select(F.lit("all").alias("portfolio"), "series", "mu")
    cov = pairs.correlation_matrix(rows).select(F.lit("all").alias("portfolio"), "a", "b", "cov")
    return mu, cov


@query()
def risk_parity(spark, sf_dir):
    return portfolio.risk_parity(*_forecasts(full_panel(spark, sf_dir)))


@query()
def kelly(spark, sf_dir):
    return portfolio.kelly_weights(*_forecasts(full_panel(spark, sf_dir)))


# -- folds ----------------------------------------------------------------------------------------

_PLACES = "bars_ AS (SELECT bar, row_number() OVER (ORDER BY bar) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT bar FROM panel))"


def _bounds_sql(groups: int) -> str:
    return f"g AS (SELECT i AS grp, (n * i // {groups})::BIGINT AS a, (n * (i + 1) // {groups})::BIGINT AS b FROM range({groups}) t(i) CROSS JOIN (SELECT count(*) AS n FROM bars_))"


@query(with_(*panel_sql(), _PLACES, _bounds_sql(5), last="SELECT grp::INT AS fold, bar, CASE WHEN pos >= a AND pos < b THEN 'test' ELSE 'train' END AS role FROM g CROSS JOIN bars_ WHERE (pos >= a AND pos < b) OR pos < a - 2 OR pos >= b + 2 + 3"))
def purged_folds(spark, sf_dir):
    return cv.fold_roles(full_panel(spark, sf_dir), 5, 1, 2, 3)


_CHOICES = """f AS (SELECT row_number() OVER (ORDER BY x.grp, y.grp) - 1 AS fold, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM g x JOIN g y ON x.grp < y.grp),
m AS (SELECT fold, bar, (pos >= a1 AND pos < b1) OR (pos >= a2 AND pos < b2) AS t, (pos >= a1 - 1 AND pos < b1 + 2) OR (pos >= a2 - 1 AND pos < b2 + 2) AS near FROM f CROSS JOIN bars_)"""


@query(with_(*panel_sql(), _PLACES, _bounds_sql(6), _CHOICES, last="SELECT fold::INT AS fold, bar, CASE WHEN t THEN 'test' ELSE 'train' END AS role FROM m WHERE t OR NOT near"))
def cpcv_folds(spark, sf_dir):
    return cv.fold_roles(full_panel(spark, sf_dir), 6, 2, 1, 1)


# -- backtests ------------------------------------------------------------------------------------

_BOOK = f"""dates AS (SELECT unnest(generate_series({INIT}, (SELECT max(bar) FROM panel)::BIGINT, {STEP})) AS rebalance_bar),
sg AS (SELECT series, bar, stddev_samp(ret) OVER (PARTITION BY series ORDER BY bar ROWS BETWEEN {INIT} PRECEDING AND 1 PRECEDING) AS s FROM panel),
weights AS (SELECT bar AS rebalance_bar, series, coalesce(CASE WHEN s > 0 THEN 1.0 / s END / sum(CASE WHEN s > 0 THEN 1.0 / s END) OVER (PARTITION BY bar), 0.0) AS weight FROM sg WHERE bar IN (SELECT rebalance_bar FROM dates)),
moved AS (SELECT rebalance_bar, abs(weight - coalesce(lag(weight) OVER (PARTITION BY series ORDER BY rebalance_bar), 0.0)) AS m FROM weights),
turn AS (SELECT rebalance_bar, sum(m) AS turnover, CASE WHEN rebalance_bar > {INIT} THEN sum(m) ELSE 0.0 END AS change FROM moved GROUP BY rebalance_bar),
pnl AS (SELECT p.bar, w.rebalance_bar, sum(w.weight * p.ret) AS gross FROM panel p JOIN weights w ON w.series = p.series AND w.rebalance_bar = {INIT} + {STEP} * ((p.bar - 1 - {INIT}) // {STEP}) WHERE p.bar >= {INIT} + 1 GROUP BY p.bar, w.rebalance_bar),
net AS (SELECT bar, pnl.rebalance_bar, gross, CASE WHEN bar = pnl.rebalance_bar + 1 THEN 10.0 / 2 / 1e4 * turnover ELSE 0.0 END AS cost FROM pnl JOIN turn USING (rebalance_bar)),
wf AS (SELECT *, gross - cost AS net FROM net)"""

def _compound_sql(over: str = "") -> str:
    size, negative, zero = (f"{x}{over}" for x in ("sum(CASE WHEN 1 + net <> 0 THEN ln(abs(1 + net)) ELSE 0.0 END)", "sum(CASE WHEN 1 + net < 0 THEN 1 ELSE 0 END)", "max(CASE WHEN 1 + net = 0 THEN 1 ELSE 0 END)"))
    return f"CASE WHEN {zero} = 1 THEN 0.0 WHEN {negative} % 2 = 1 THEN -exp({size}) ELSE exp({size}) END"


_EQUITY = f"eq AS (SELECT *, {_compound_sql(' OVER w')} AS equity FROM wf WINDOW w AS (ORDER BY bar ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, equity / max(equity) OVER (ORDER BY bar ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"
_RUN = [*panel_sql(), _BOOK]


def _book(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    weights = backtest.inverse_vol_weights(rows, INIT, STEP, INIT)
    return rows, weights, backtest.walk_forward(rows, weights, INIT, STEP, 10.0, 1)


@query(with_(*_RUN, last=f"SELECT rebalance_bar, series, {sql_r('weight')} AS weight FROM weights"))
def wf_weights(spark, sf_dir):
    return _book(spark, sf_dir)[1].withColumn("weight", r("weight"))


@query(with_(*_RUN, last=f"SELECT bar, rebalance_bar, {sql_r('gross')} AS gross, {sql_r('cost')} AS cost, {sql_r('net')} AS net FROM wf"))
def wf_portfolio(spark, sf_dir):
    return _book(spark, sf_dir)[2].select("bar", "rebalance_bar", r("gross").alias("gross"), r("cost").alias("cost"), r("net").alias("net"))


@query(with_(*_RUN, last=f"SELECT rebalance_bar, {sql_r('turnover')} AS turnover, {sql_r('change')} AS change FROM turn"))
def turnover(spark, sf_dir):
    return backtest.turnover(_book(spark, sf_dir)[1]).select("rebalance_bar", r("turnover").alias("turnover"), r("change").alias("change"))


def _metrics_sql(source: str, key: str = "", extra: str = "") -> str:
    group = f"GROUP BY {key}" if key else ""
    safe = lambda s: f"CASE WHEN {s} > 1e-10 THEN mu / {s} * sqrt(252.0) ELSE 0.0 END"
    k = f"{key}, " if key else ""
    return f"""SELECT {k}n, {sql_r('max_drawdown', 6)} AS max_drawdown, {sql_r('hit_rate', 6)} AS hit_rate, {sql_r('total_return', 6)} AS total_return, {sql_r('annual_return', 4)} AS annual_return, {sql_r(safe('sd'), 5)} AS sharpe, {sql_r(f"coalesce({safe('down')}, 0.0)", 5)} AS sortino, {sql_r('CASE WHEN abs(max_drawdown) > 1e-10 THEN annual_return / abs(max_drawdown) ELSE 0.0 END', 4)} AS calmar{extra} FROM (
  SELECT {k}count(*) AS n, avg(net) AS mu, stddev_samp(net) AS sd, stddev_samp(net) FILTER (WHERE net < 0) AS down, min(drawdown) AS max_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, max_by(equity, bar) - 1 AS total_return, pow(1 + avg(net), 252) - 1 AS annual_return FROM {source} {group})"""


def _rounded_metrics(df, *keys):
    digits = {"max_drawdown": 6, "hit_rate": 6, "total_return": 6, "annual_return": 4, "sharpe": 5, "sortino": 5, "calmar": 4}
    extra = [r("avg_turnover", 6).alias("avg_turnover")] if "avg_turnover" in df.columns else []
    return df.select(*keys, "n", *[r(c, d).alias(c) for c, d in digits.items()], *extra)


@query(with_(*_RUN, _EQUITY, last=_metrics_sql("dd", extra=f", {sql_r('(SELECT avg(change) FROM turn)', 6)} AS avg_turnover")))
def perf_metrics(spark, sf_dir):
    _, weights, pnl = _book(spark, sf_dir)
    return _rounded_metrics(backtest.metrics(pnl, change=backtest.turnover(weights)))


@query(with_(*_RUN, _EQUITY, last=f"SELECT bar, {sql_r('equity', 6)} AS equity, {sql_r('drawdown', 6)} AS drawdown FROM dd"))
def equity_drawdown(spark, sf_dir):
    return backtest.equity(_book(spark, sf_dir)[2]).select("bar", r("equity", 6).alias("equity"), r("drawdown", 6).alias("drawdown"))


@query(with_(*_RUN, last=f"SELECT bar, {sql_r('CASE WHEN count(*) OVER w >= 26 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(252.0) END', 5)} AS sharpe FROM wf WINDOW w AS (ORDER BY bar ROWS 25 PRECEDING)"))
def rolling_sharpe(spark, sf_dir):
    return backtest.rolling_sharpe(_book(spark, sf_dir)[2], 26).withColumn("sharpe", r("sharpe", 5))


_MONTHS = f"""tsd AS (SELECT wf.*, b.ts FROM wf JOIN (SELECT DISTINCT bar, ts FROM panel) b USING (bar)),
grown AS (SELECT date_trunc('month', ts) AS m, {_compound_sql()} - 1 AS ret FROM tsd GROUP BY 1),
months AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM grown),
monthly AS (SELECT year(months.m)::INT AS year, month(months.m)::INT AS month, coalesce(ret, 0.0) AS ret FROM months LEFT JOIN grown ON grown.m = months.m)"""


def _dated(spark, sf_dir):
    rows, _, pnl = _book(spark, sf_dir)
    return pnl.join(F.broadcast(rows.select("bar", "ts").distinct()), "bar")


@query(with_(*_RUN, _MONTHS, last=f"SELECT year, month, {sql_r('ret', 6)} AS ret FROM monthly"))
def monthly_returns(spark, sf_dir):
    return backtest.monthly(_dated(spark, sf_dir)).withColumn("ret", r("ret", 6))


@query(with_(*_RUN, _MONTHS, last="SELECT year, " + ", ".join(f"(round(max(CASE WHEN month = {m} THEN ret END), 6) + 0.0) AS m{m:02d}" for m in range(1, 13)) + " FROM monthly GROUP BY year"))
def monthly_table(spark, sf_dir):
    return backtest.monthly_table(_dated(spark, sf_dir)).select("year", *[r(str(m), 6).alias(f"m{m:02d}") for m in range(1, 13)])


_SWEEP = f"sweep AS (SELECT tc_bps, bar, gross - cost / 10.0 * tc_bps AS net FROM wf CROSS JOIN (VALUES (0.0::DOUBLE), (1.0), (2.0), (5.0)) AS t(tc_bps)), seq AS (SELECT *, {_compound_sql(' OVER (PARTITION BY tc_bps ORDER BY bar ROWS UNBOUNDED PRECEDING)')} AS equity FROM sweep), sdd AS (SELECT *, equity / max(equity) OVER (PARTITION BY tc_bps ORDER BY bar ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM seq)"


@query(with_(*_RUN, _SWEEP, last=_metrics_sql("sdd", "tc_bps")))
def tc_sweep(spark, sf_dir):
    rows, weights, _ = _book(spark, sf_dir)
    return _rounded_metrics(backtest.metrics(backtest.cost_sweep(rows, weights, [0.0, 1.0, 2.0, 5.0], INIT, STEP), ("tc_bps",)), "tc_bps")


@query(with_(*_RUN, _FEATURES, _REGIMES, last=f"SELECT regime, count(*) AS n, {sql_r('avg(net)')} AS mean, {sql_r('CASE WHEN stddev_samp(net) > 1e-10 THEN avg(net) / stddev_samp(net) * sqrt(252.0) ELSE 0.0 END', 5)} AS sharpe FROM wf JOIN regimes USING (bar) GROUP BY regime"))
def regime_attribution(spark, sf_dir):
    rows, _, pnl = _book(spark, sf_dir)
    return robustness.by_regime(pnl, market_regimes(rows)).select("regime", "n", r("mean").alias("mean"), r("sharpe", 5).alias("sharpe"))


_MOMENTS = "mm AS (SELECT count(*) AS n, avg(net) AS m, stddev_samp(net) AS s FROM wf), mo AS (SELECT avg((net - m) ** 2) AS m2, avg((net - m) ** 3) AS m3, avg((net - m) ** 4) AS m4 FROM wf, mm)"


@query(with_(*_RUN, _MOMENTS, last=f"SELECT n, {sql_r('CASE WHEN s > 1e-10 THEN m / s ELSE 0.0 END', 6)} AS sharpe, {sql_r('m3 / (pow(m2, 1.5) + 1e-12)', 6)} AS skew, {sql_r('m4 / (m2 * m2 + 1e-12)', 6)} AS kurtosis FROM mm, mo"))
def return_moments(spark, sf_dir):
    return robustness.moments(_book(spark, sf_dir)[2]).select("n", r("sharpe", 6).alias("sharpe"), r("skew", 6).alias("skew"), r("kurtosis", 6).alias("kurtosis"))


#: The normal distribution's function by its series, near enough up to 5 deviations.
_PHI = "0.5 + list_sum(list_transform(range(0, 80), lambda i: pow(-0.5::DOUBLE, i) * pow(z, 2 * i + 1) / (gamma(i + 1.0) * (2 * i + 1)))) / sqrt(2 * pi())"
_DEFLATED = f"""ds AS (SELECT n, CASE WHEN s > 1e-10 THEN m / s ELSE 0.0 END AS sharpe, m3 / (pow(m2, 1.5) + 1e-12) AS skew, m4 / (m2 * m2 + 1e-12) AS kurtosis, 0.1 * {expected_max_sharpe(12)!r}::DOUBLE AS benchmark FROM mm, mo),
dz AS (SELECT *, (sharpe - benchmark) / sqrt((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1)) AS z FROM ds), dp AS (SELECT *, {_PHI} AS deflated FROM dz)"""


@query(with_(*_RUN, _MOMENTS, _DEFLATED, last=f"SELECT n, {sql_r('sharpe', 6)} AS sharpe, {sql_r('deflated', 6)} AS deflated, {sql_r('1 - deflated', 6)} AS p_value, {sql_r('benchmark', 6)} AS benchmark, deflated >= 0.95 AS passes FROM dp"))
def deflated_sharpe(spark, sf_dir):
    rows = robustness.deflated(robustness.moments(_book(spark, sf_dir)[2]), 12, 0.1)
    return rows.select("n", *[r(c, 6).alias(c) for c in ("sharpe", "deflated", "p_value", "benchmark")], "passes")


_INTERVAL = f"""placed_ AS (SELECT net AS x, row_number() OVER (ORDER BY bar) - 1 AS pos FROM wf),
size_ AS (SELECT t, size, t // size AS blocks, mean, spread FROM (SELECT count(*) AS t, greatest(5, round_even(sqrt(count(*)), 0)::BIGINT) AS size, avg(x) AS mean, stddev_samp(x) AS spread FROM placed_)),
sums_ AS (SELECT pos // size AS block, sum(x) AS a, sum(x * x) AS b FROM placed_ CROSS JOIN size_ WHERE pos // size < blocks GROUP BY ALL),
picks AS (SELECT draw, size * blocks AS n, ('0x' || md5('0:inverse_vol:' || draw || ':' || place)[:12])::BIGINT % blocks AS block FROM size_ CROSS JOIN (SELECT unnest(range(1000)) AS draw) JOIN (SELECT unnest(range(100000)) AS place) ON place < blocks),
drawn_ AS (SELECT draw, any_value(n) AS n, sum(a) AS a, sum(b) AS b FROM picks JOIN sums_ USING (block) GROUP BY draw),
sharpes AS (SELECT CASE WHEN sd > 1e-12 THEN a / n / sd * sqrt(252.0) ELSE 0.0 END AS sharpe FROM (SELECT *, sqrt(greatest((b - a * a / n) / (n - 1), 0.0)) AS sd FROM drawn_))"""


@query(with_(*_RUN, _INTERVAL, last=f"SELECT 'inverse_vol' AS strategy, {sql_r('mean / spread * sqrt(252.0)', 6)} AS sharpe, {sql_r('(SELECT quantile_cont(sharpe, 0.025) FROM sharpes)', 6)} AS low, {sql_r('(SELECT quantile_cont(sharpe, 0.975) FROM sharpes)', 6)} AS high FROM size_"))
def sharpe_ci(spark, sf_dir):
    out = robustness.sharpe_intervals(_book(spark, sf_dir)[2].withColumn("strategy", F.lit("inverse_vol")))
    return out.select("strategy", *[r(c, 6).alias(c) for c in ("sharpe", "low", "high")])


_SIZES = ", ".join(f"({n}, {expected_max_sharpe(n)!r}::DOUBLE)" for n in range(1, 51))


@query(f"SELECT brand, trials::INT AS trials, {sql_r('v')} AS expected FROM (SELECT p_brand AS brand, count(DISTINCT p_size) AS trials FROM part GROUP BY p_brand) JOIN (VALUES {_SIZES}) AS t(n, v) ON n = trials")
def expected_max(spark, sf_dir):
    """What the best of as many trials as a brand has sizes would show by luck."""
    trials = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("p_size").cast("int").alias("trials"))
    return robustness.expected_best(trials).withColumn("expected", r("expected"))


# trials: momentum of several look-backs
LOOKBACKS = (3, 8, 13, 26)


def _momentum_sql(rows: int) -> str:
    k = f"_{rows}"
    return f"""ms{k} AS (SELECT series, bar, sign(avg(ret) OVER (PARTITION BY series ORDER BY bar ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)) AS s FROM panel),
mw{k} AS (SELECT bar AS rebalance_bar, series, CASE WHEN sum(abs(s)) OVER (PARTITION BY bar) > 0 THEN s / sum(abs(s)) OVER (PARTITION BY bar) ELSE 0.0 END AS weight FROM ms{k} WHERE bar IN (SELECT rebalance_bar FROM dates)),
mt{k} AS (SELECT rebalance_bar, sum(abs(weight - p)) AS turnover FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY series ORDER BY rebalance_bar), 0.0) AS p FROM mw{k}) GROUP BY rebalance_bar),
mp{k} AS (SELECT p.bar, w.rebalance_bar, sum(w.weight * p.ret) AS gross FROM panel p JOIN mw{k} w ON w.series = p.series AND w.rebalance_bar = {INIT} + {STEP} * ((p.bar - 1 - {INIT}) // {STEP}) WHERE p.bar >= {INIT} + 1 GROUP BY p.bar, w.rebalance_bar),
trial{k} AS (SELECT 'm{rows:02d}' AS trial, bar - {INIT} - 1 AS bar, gross - CASE WHEN bar = p.rebalance_bar + 1 THEN 10.0 / 2 / 1e4 * turnover ELSE 0.0 END AS ret FROM mp{k} p JOIN mt{k} USING (rebalance_bar))"""


_TRIALS = ",\n".join([_BOOK, *map(_momentum_sql, LOOKBACKS), "trials AS (" + " UNION ALL ".join(f"SELECT * FROM trial_{k}" for k in LOOKBACKS) + ")"])


def _trials(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    pnl = backtest.walk_forward(rows, backtest.momentum_trials(rows, list(LOOKBACKS), INIT, STEP), INIT, STEP, 10.0, 1, ("trial",))
    return pnl.select("trial", (F.col("bar") - INIT - 1).alias("bar"), F.col("net").alias("ret"))


@query(with_(*panel_sql(), _TRIALS, last=f"SELECT trial, bar, {sql_r('ret')} AS ret FROM trials"))
def trial_returns(spark, sf_dir):
    return _trials(spark, sf_dir).withColumn("ret", r("ret"))


_PBO = """tm AS (SELECT max(bar) + 1 AS t FROM trials), sz AS (SELECT t, greatest(4, least(16, 2 * (t // 30)) // 2 * 2) AS s FROM tm),
blocks AS (SELECT trial, least(bar * s // t, s - 1) AS block, count(*) AS n, sum(ret) AS s1, sum(ret * ret) AS s2 FROM trials, sz GROUP BY ALL),
masks AS (SELECT i AS mask FROM sz, range(65536) q(i) WHERE i < (1 << s::INT) AND bit_count(i) = s // 2),
ins AS (SELECT mask, trial, sum(n) FILTER (WHERE (mask >> block::INT) & 1 = 1) AS n, sum(s1) FILTER (WHERE (mask >> block::INT) & 1 = 1) AS a1, sum(s2) FILTER (WHERE (mask >> block::INT) & 1 = 1) AS a2,
  sum(n) FILTER (WHERE (mask >> block::INT) & 1 = 0) AS m, sum(s1) FILTER (WHERE (mask >> block::INT) & 1 = 0) AS b1, sum(s2) FILTER (WHERE (mask >> block::INT) & 1 = 0) AS b2 FROM masks, blocks GROUP BY mask, trial),
sh AS (SELECT mask, trial, CASE WHEN (a2 - a1 * a1 / n) / (n - 1) > 1e-24 THEN a1 / n / sqrt((a2 - a1 * a1 / n) / (n - 1)) ELSE 0.0 END AS a, CASE WHEN (b2 - b1 * b1 / m) / (m - 1) > 1e-24 THEN b1 / m / sqrt((b2 - b1 * b1 / m) / (m - 1)) ELSE 0.0 END AS b FROM ins),
win AS (SELECT mask, trial, b FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY a DESC, trial) AS k FROM sh) WHERE k = 1),
rk AS (SELECT win.mask, 1 + count(*) FILTER (WHERE sh.b > win.b) AS rank, count(*) AS trials FROM sh JOIN win ON sh.mask = win.mask GROUP BY win.mask),
lg AS (SELECT ln((rank / (trials + 1.0)) / (1 - rank / (trials + 1.0))) AS logit FROM rk)"""


@query(with_(*panel_sql(), _TRIALS, _PBO, last=f"SELECT {sql_r('avg(CASE WHEN logit > 0 THEN 1.0 ELSE 0.0 END)', 6)} AS pbo, count(*) AS splits FROM lg"))
def pbo(spark, sf_dir):
    return robustness.overfitting_probability(_trials(spark, sf_dir)).select(r("pbo", 6).alias("pbo"), "splits")


#: Bars between two refreshes of the edges, and that an entropy looks back on at most.
REFRESH, LOOKBACK = 63, 750
_REFRESHED = ",\n".join([
    f"rd AS (SELECT unnest(generate_series({INIT}, (SELECT max(bar) FROM panel)::BIGINT, {REFRESH})) AS refresh_bar)",
    # a panel for each refresh, told apart by the bars' numbers and the series' names
    f"past_panel AS (SELECT refresh_bar || ':' || series AS series, refresh_bar * 1000000 + bar AS bar, ret FROM panel JOIN rd ON bar < refresh_bar AND bar >= refresh_bar - {LOOKBACK})",
    *entropy_sql([1], "past_panel"),
    "re AS (SELECT split_part(source, ':', 1)::BIGINT AS refresh_bar, split_part(source, ':', 2) AS source, split_part(target, ':', 2) AS target, te FROM te)",
    "chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY refresh_bar ORDER BY te DESC, source, target) AS k FROM re) WHERE k <= 10 AND te > 0)",
])


def _refreshed(rows):
    return backtest.refresh_edges(rows, None, INIT, REFRESH, LOOKBACK, k=K, history=H, noise=0.0)


@query(with_(*panel_sql(), _REFRESHED, last=f"SELECT c.refresh_bar, count(*) AS active, count(*) FILTER (WHERE p.source IS NULL) AS new FROM chosen c LEFT JOIN chosen p ON p.refresh_bar + {REFRESH} = c.refresh_bar AND p.source = c.source AND p.target = c.target GROUP BY c.refresh_bar"))
def pair_churn(spark, sf_dir):
    top = pairs.top_per(_refreshed(full_panel(spark, sf_dir)).withColumn("tie", F.concat_ws("|", "source", "target")), "refresh_bar", 10, tie="tie").where("te > 0")
    return robustness.churn(top, REFRESH)


_LEAD = f"""ld AS (SELECT unnest(generate_series({INIT}, (SELECT max(bar) FROM panel)::BIGINT, {STEP})) AS rebalance_bar),
lr AS (SELECT rebalance_bar, {INIT} + {REFRESH} * ((rebalance_bar - {INIT}) // {REFRESH}) AS refresh_bar FROM ld),
lp AS (SELECT a.series AS source, b.series AS target, a.bar, a.ret AS now, a.l, b.ret AS f FROM (SELECT series, bar, ret, lag(ret) OVER (PARTITION BY series ORDER BY bar) AS l FROM panel) a JOIN panel b ON a.bar = b.bar AND a.series <> b.series),
lb AS (SELECT source, target, bar + 1 AS rebalance_bar, now, count(l) OVER w AS n, sum(l) OVER w AS sl, sum(CASE WHEN l IS NOT NULL THEN f END) OVER w AS sf, sum(l * l) OVER w AS sll, sum(l * f) OVER w AS slf FROM lp WINDOW w AS (PARTITION BY source, target ORDER BY bar ROWS 103 PRECEDING)),
beta AS (SELECT source, target, rebalance_bar, now, CASE WHEN n >= 30 AND sll - sl * sl / n > 1e-18 THEN (slf - sl * sf / n) / (sll - sl * sl / n) END AS beta FROM lb),
lu AS (SELECT lr.rebalance_bar, c.target, sum(te * beta * now) / sum(te) AS p FROM chosen c JOIN lr USING (refresh_bar) JOIN beta USING (source, target, rebalance_bar) WHERE beta IS NOT NULL GROUP BY lr.rebalance_bar, c.target),
l1 AS (SELECT rebalance_bar, target, least(greatest(p / nullif(sum(abs(p)) OVER (PARTITION BY rebalance_bar), 0), -0.15), 0.15) AS w FROM lu),
l2 AS (SELECT rebalance_bar, target, w / nullif(sum(abs(w)) OVER (PARTITION BY rebalance_bar), 0) AS w FROM l1),
lead AS (SELECT ld.rebalance_bar, s.series, coalesce(w, 0.0) AS weight FROM ld CROSS JOIN (SELECT DISTINCT series FROM panel) s LEFT JOIN l2 ON l2.rebalance_bar = ld.rebalance_bar AND l2.target = s.series)"""


@query(with_(*panel_sql(), _REFRESHED, _LEAD, last=f"SELECT rebalance_bar, series, {sql_r('weight', 6)} AS weight FROM lead"))
def lead_strategy_weights(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    return backtest.lead_weights(rows, _refreshed(rows), INIT, STEP, REFRESH, rows=104, top=10).withColumn("weight", r("weight", 6))


def _net_sql(weights: str, p: str, bps: float) -> str:
    """{p}net(bar, net): the walk-forward result of a table of weights."""
    return f"""{p}turn AS (SELECT rebalance_bar, sum(abs(weight - q)) AS turnover FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY series ORDER BY rebalance_bar), 0.0) AS q FROM {weights}) GROUP BY rebalance_bar),
{p}gross AS (SELECT x.bar, y.rebalance_bar, sum(y.weight * x.ret) AS gross FROM panel x JOIN {weights} y ON y.series = x.series AND y.rebalance_bar = {INIT} + {STEP} * ((x.bar - 1 - {INIT}) // {STEP}) WHERE x.bar >= {INIT} + 1 GROUP BY x.bar, y.rebalance_bar),
{p}net AS (SELECT x.bar, x.rebalance_bar, gross, CASE WHEN x.bar = x.rebalance_bar + 1 THEN {bps} / 2 / 1e4 * turnover ELSE 0.0 END AS cost FROM {p}gross x JOIN {p}turn USING (rebalance_bar))"""


_TWO = f"""two AS (SELECT 'lead' AS strategy, bar, gross - cost AS net FROM leadnet UNION ALL SELECT 'benchmark', bar, net FROM wf),
twoeq AS (SELECT *, {_compound_sql(' OVER (PARTITION BY strategy ORDER BY bar ROWS UNBOUNDED PRECEDING)')} AS equity FROM two),
twodd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY bar ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM twoeq)"""


@query(with_(*_RUN, _REFRESHED, _LEAD, _net_sql("lead", "lead", 1.0), _TWO, last=_metrics_sql("twodd", "strategy")))
def lead_strategy_metrics(spark, sf_dir):
    """The whole strategy on transfer entropies, against the inverse-volatility benchmark."""
    rows, _, benchmark = _book(spark, sf_dir)
    lead = backtest.lead_weights(rows, _refreshed(rows), INIT, STEP, REFRESH, rows=104, top=10)
    own = backtest.walk_forward(rows, lead, INIT, STEP, 1.0, 1)
    both = own.select(F.lit("lead").alias("strategy"), "bar", "net").union(benchmark.select(F.lit("benchmark").alias("strategy"), "bar", "net"))
    return _rounded_metrics(backtest.metrics(both, ("strategy",)), "strategy")


_CALLBACK = f"""cm AS (SELECT series, bar, avg(ret) OVER (PARTITION BY series ORDER BY bar ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS m, count(*) OVER (PARTITION BY bar) AS width FROM panel),
cw AS (SELECT bar AS rebalance_bar, series, rank() OVER (PARTITION BY bar ORDER BY m) / width / 6.0 AS weight FROM cm WHERE bar IN (SELECT unnest(generate_series({INIT}, (SELECT max(bar) FROM panel)::BIGINT, {STEP})))),
{_net_sql('cw', 'cb', 1.0)}"""


@query(with_(*panel_sql(), _CALLBACK, last=f"SELECT bar, rebalance_bar, {sql_r('gross')} AS gross, {sql_r('cost')} AS cost, {sql_r('gross - cost')} AS net FROM cbnet"))
def callback_strategy(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    weights = backtest.callback_weights(rows, lambda past: past.tail(13).mean().rank() / len(past.columns) / 6, INIT, STEP)
    return backtest.walk_forward(rows, weights, INIT, STEP, 1.0, 1).select("bar", "rebalance_bar", r("gross").alias("gross"), r("cost").alias("cost"), r("net").alias("net"))


# -- models ---------------------------------------------------------------------------------------


@query()
def adf_kpss(spark, sf_dir):
    return unitroot.stationarity(full_panel(spark, sf_dir))


#: Bars of a block in these queries: their panels lie in several.
BLOCK_BARS = 64


def _features(spark, sf_dir):
    rows = named_features(full_panel(spark, sf_dir)).withColumn("panel", F.lit("market"))
    return store.kept(rows, store.scratch(spark), "features")  # a row for each bar and role, read many times


@query()
def hmm_regimes(spark, sf_dir):
    return varmodels.hmm_regimes(_features(spark, sf_dir), block_bars=BLOCK_BARS)


@query()
def hmm_new_rows(spark, sf_dir):
    """Regimes of the last 40 bars under the model of the bars before them."""
    rows = _features(spark, sf_dir)
    last = rows.agg(F.max("bar").alias("last"))
    new = F.col("bar") > F.col("last") - 40
    both = rows.crossJoin(F.broadcast(last))
    return varmodels.predicted_regimes(both.where(~new).drop("last"), both.where(new).drop("last"), block_bars=BLOCK_BARS)


@query()
def msvar_ahead(spark, sf_dir):
    return varmodels.switching_forecast(full_panel(spark, sf_dir).withColumn("panel", F.lit("all")), 5, max_iter=20, block_bars=BLOCK_BARS)


@query()
def msvar_probs(spark, sf_dir):
    rows = full_panel(spark, sf_dir).withColumn("panel", F.lit("all"))
    return varmodels.switching_var(rows, max_iter=20, block_bars=BLOCK_BARS)


@query()
def msvar_coefficients(spark, sf_dir):
    rows = full_panel(spark, sf_dir).withColumn("panel", F.lit("all"))
    return varmodels.switching_coefficients(rows, max_iter=20, block_bars=BLOCK_BARS)


_MOMENTS_SQL = """places AS (SELECT bar, row_number() OVER (ORDER BY bar) - 1 AS pos FROM (SELECT DISTINCT bar FROM panel)),
placed AS (SELECT series, p.bar, pos, ret FROM panel p JOIN places ON places.bar = p.bar),
cells AS (SELECT t.bar, k || ':' || s.series AS name, s.ret AS v FROM places t CROSS JOIN (VALUES (0), (1), (2)) AS l(k) JOIN placed s ON s.pos = t.pos - k WHERE t.pos >= 2 UNION ALL SELECT bar, '1', 1.0 FROM places WHERE pos >= 2)"""


@query(with_(*panel_sql(), _FEATURES, _REGIMES, _MOMENTS_SQL, last=f"SELECT regime, a.name AS a, b.name AS b, {sql_r('sum(a.v * b.v)')} AS value FROM cells a JOIN cells b ON a.bar = b.bar JOIN regimes ON regimes.bar = a.bar GROUP BY regime, a.name, b.name"))
def msvar_moments(spark, sf_dir):
    """What the maximisation sees: each regime's sums of products of the constant, the series and their lags."""
    rows = full_panel(spark, sf_dir)
    return chains.regime_moments(rows, market_regimes(rows), 2, BLOCK_BARS).withColumn("value", r("value"))


@query()
def attention_edges(spark, sf_dir):
    return neural.attention_edges(full_panel(spark, sf_dir), max_lag=5, epochs=60)


@query()
def neural_gc(spark, sf_dir):
    return neural.neural_granger(full_panel(spark, sf_dir), history=5, epochs=5, hidden=8, embed=2)


# -- breaks ---------------------------------------------------------------------------------------

_UPDATES = f"""up AS (SELECT a.series AS source, b.series AS target, b.bar, abs(a.ret * b.ret) AS te FROM panel a JOIN panel b ON a.bar + 1 = b.bar AND a.series <> b.series),
st AS (SELECT *, count(te) OVER w AS n, avg(te) OVER w AS m, stddev_pop(te) OVER w AS s FROM up WINDOW w AS (PARTITION BY source, target ORDER BY bar ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING))"""


def updates(rows):
    """A stream-like series of edge strengths: the product of neighbouring returns."""
    return pairs.lagged(rows, [1]).select("source", "target", "bar", F.abs(F.col("l") * F.col("f")).alias("te"))


def _events(spark, sf_dir):
    return monitor.breaks(updates(full_panel(spark, sf_dir)))


@query(with_(*panel_sql(), _UPDATES, last=f"SELECT bar, source AS leader, target AS follower, {sql_r('m')} AS old_value, {sql_r('te')} AS new_value FROM st WHERE n + 1 >= 5 AND s > 1e-10 AND (te - m) / s > 2.0"))
def monitor_spikes(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'te_spike'").select("bar", "leader", "follower", r("old_value").alias("old_value"), r("new_value").alias("new_value"))


@query(with_(*panel_sql(), _UPDATES, last=f"SELECT bar, source AS leader, target AS follower, {sql_r('m')} AS old_value, {sql_r('te')} AS new_value FROM st WHERE n + 1 >= 5 AND m > 1e-10 AND te < 0.5 * m"))
def monitor_decays(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'te_decay'").select("bar", "leader", "follower", r("old_value").alias("old_value"), r("new_value").alias("new_value"))


_CHANGES = "ch AS (SELECT * FROM (SELECT bar, regime, lag(regime) OVER (ORDER BY bar) AS last FROM regimes) WHERE last <> regime)"


@query(with_(*panel_sql(), _FEATURES, _REGIMES, _CHANGES, last="SELECT bar, 'regime_change' AS event_type, last::DOUBLE AS old_value, regime::DOUBLE AS new_value, 'regime ' || last || ' became ' || regime AS description FROM ch"))
def regime_changes(spark, sf_dir):
    return monitor.regime_changes(market_regimes(full_panel(spark, sf_dir))).drop("leader", "follower")


@query(with_(*panel_sql(), _FEATURES, _REGIMES, _CHANGES, last="SELECT CASE WHEN count(*) = 0 THEN 'No structural breaks.' ELSE count(*) || ' structural breaks' || chr(10) || string_agg('[REGIME] regime ' || last || ' became ' || regime, chr(10) ORDER BY bar) END AS text FROM ch"))
def alert_text(spark, sf_dir):
    return monitor.alert_text(monitor.regime_changes(market_regimes(full_panel(spark, sf_dir))))


_LINE = "'regime ' || last || ' became ' || regime"


@query(with_(*panel_sql(), _FEATURES, _REGIMES, _CHANGES, last=f"SELECT '# Daily report' || chr(10) || chr(10) || CASE WHEN count(*) = 0 THEN 'Nothing happened.' ELSE '## regime_change (' || count(*) || ')' || chr(10) || string_agg('- ' || {_LINE}, chr(10) ORDER BY bar) END AS text FROM ch"))
def daily_report(spark, sf_dir):
    return monitor.daily_report(monitor.regime_changes(market_regimes(full_panel(spark, sf_dir))))


@query(with_(*panel_sql(), _FEATURES, _REGIMES, _CHANGES, last=f"SELECT 'These breaks in lead-lag relations were found:' || chr(10) || coalesce(string_agg('REGIME_CHANGE: ' || {_LINE}, chr(10) ORDER BY bar) || chr(10), '') || 'Context: weekly panel' || chr(10) || 'Explain in three sentences what may link them, and what to watch next.' AS text FROM ch"))
def narrative_prompt(spark, sf_dir):
    return monitor.narrative_prompt(monitor.regime_changes(market_regimes(full_panel(spark, sf_dir))), "weekly panel")
