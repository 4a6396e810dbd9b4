"""Queries about panels: sources, calendars, returns, coverage, embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelflow.functions.columns import by, full, ratio, rolling
from panelflow.operators import pairs, panel, regimes, robustness
from panelflow.plans.base import BARS, full_panel, levels, panel_sql, query, r, returns, sql_r, with_
from panelflow.sources import store, universe
from panelflow.sources.adapters import LEVELS_SQL

W = "weekly_lineitem"


_CATALOG = [W, "weekly_orders", "monthly_discount"]


def catalog(spark, sf_dir):
    """The universe of three panels' series."""
    rows = [levels(spark, sf_dir, name).select("cls", "series", "ts", "level") for name in _CATALOG]
    return universe.derived(rows[0].union(rows[1]).union(rows[2]), frequencies={"lineitem": "weekly", "orders": "weekly", "macro": "monthly"})


_UNIVERSE = [LEVELS_SQL[name].replace("levels AS", f"l{i} AS", 1) for i, name in enumerate(_CATALOG)]


@query(with_(*_UNIVERSE, last="SELECT DISTINCT series, CASE WHEN cls = 'macro' THEN 'diff' ELSE 'log_return' END AS transform FROM (SELECT cls, series FROM l0 UNION ALL SELECT cls, series FROM l1 UNION ALL SELECT cls, series FROM l2)"))
def universe_transforms(spark, sf_dir):
    return universe.transforms(catalog(spark, sf_dir))


@query(with_(LEVELS_SQL[W], last=f"SELECT cls, series, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_ts, strftime(max(ts), '%Y-%m-%d') AS last_ts, {sql_r('avg(level)', 4)} AS mean_level FROM levels GROUP BY cls, series"))
def level_scan(spark, sf_dir):
    rows = levels(spark, sf_dir)
    return rows.groupBy("cls", "series").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_ts"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_ts"), r(F.avg("level"), 4).alias("mean_level"))


@query(with_(LEVELS_SQL[W], last=f"SELECT cls, series, ts, {sql_r('level', 7)} AS level FROM levels"))
def cached_levels(spark, sf_dir):
    """Levels fetched at once, kept by class, and read back from the cache by a second fetch and a scan."""
    folder = store.scratch(spark)
    rows = levels(spark, sf_dir)
    source = store.AtOnce(lambda s, keys: rows.where(F.col("series").isin(keys)).select(F.col("series").alias("source_key"), "ts", "level"))
    listed = universe.derived(rows)
    store.fetch(spark, listed, folder, {"table": source})
    store.fetch(spark, listed, folder, {})  # nothing is left to fetch
    return store.cached_scan(spark, folder).select("cls", "series", "ts", r("level", 7).alias("level"))


_PAIR_LAGS = "edges AS (SELECT a.series AS source, b.series AS target, lag FROM (SELECT DISTINCT series FROM panel) a JOIN (SELECT DISTINCT series FROM panel) b ON a.series <> b.series CROSS JOIN (VALUES (1), (2), (5)) AS l(lag))"


def _kept_matrices(spark, sf_dir, path):
    """The panel's lagged correlations, kept by lag."""
    found = pairs.lagged_correlation(full_panel(spark, sf_dir), [1, 5, 2]).select("source", "target", "lag", "corr")
    store.save_matrices(found, path)


@query(with_(*panel_sql(), _PAIR_LAGS, last="SELECT DISTINCT lag::INT AS lag FROM edges"))
def artefact_lags(spark, sf_dir):
    """The lags whose matrices a folder holds, as the panel's own pairs were saved there."""
    folder = f"{store.scratch(spark)}/matrix"
    _kept_matrices(spark, sf_dir, folder)
    return store.matrix_lags(spark, folder)


@query(with_(*panel_sql(), _PAIR_LAGS, last="SELECT 'absent' AS kind, 0::BIGINT AS n UNION ALL SELECT 'kept', count(*) FROM edges"))
def optional_scan(spark, sf_dir):
    """An artefact that isn't there has no rows; one that is has its own."""
    folder = store.scratch(spark)
    ddl = "source string, target string, corr double, lag int"
    absent = store.optional(spark, f"{folder}/absent", ddl)
    _kept_matrices(spark, sf_dir, f"{folder}/kept")
    kept = store.optional(spark, f"{folder}/kept", ddl)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(absent, "absent").union(count(kept, "kept"))


_BUSINESS = """days AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM levels),
cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS bar FROM days WHERE isodow(day) < 6)"""


@query(with_(LEVELS_SQL["daily_brand"], _BUSINESS, last="SELECT strftime(day, '%Y-%m-%d') AS day, bar FROM cal"))
def business_calendar(spark, sf_dir):
    rows = panel.business_calendar(levels(spark, sf_dir, "daily_brand"))
    return rows.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "bar")


_ALIGNED = """grid AS (SELECT s.cls, s.series, cal.bar, l.level FROM (SELECT DISTINCT cls, series FROM levels) s CROSS JOIN cal LEFT JOIN levels l ON l.series = s.series AND l.ts::DATE = cal.day),
held AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN bar END) OVER w AS seen_at, last_value(level IGNORE NULLS) OVER w AS seen FROM grid WINDOW w AS (PARTITION BY series ORDER BY bar ROWS UNBOUNDED PRECEDING)),
aligned AS (SELECT cls, series, bar, CASE WHEN bar - seen_at <= 3 THEN seen END AS level FROM held)"""


@query(with_(LEVELS_SQL["daily_brand"], _BUSINESS, _ALIGNED, last="SELECT series, bar, level FROM aligned WHERE level IS NOT NULL"))
def calendar_align(spark, sf_dir):
    rows = levels(spark, sf_dir, "daily_brand")
    return panel.align(rows, panel.business_calendar(rows)).where("level is not null").select("series", "bar", "level")


_HOURS = """grid AS (SELECT s.series, b.bar, l.level FROM (SELECT DISTINCT series FROM levels) s CROSS JOIN bars b LEFT JOIN levels l ON l.series = s.series AND l.ts = b.ts),
held AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN bar END) OVER w AS seen_at, last_value(level IGNORE NULLS) OVER w AS seen FROM grid WINDOW w AS (PARTITION BY series ORDER BY bar ROWS UNBOUNDED PRECEDING)),
ff AS (SELECT series, bar, CASE WHEN bar - seen_at <= 2 THEN seen END AS level FROM held)"""


@query(with_(LEVELS_SQL["hourly_events"], BARS, _HOURS, last="SELECT series, bar, level FROM ff"))
def bounded_ffill(spark, sf_dir):
    rows = levels(spark, sf_dir, "hourly_events")
    return panel.forward_fill(panel.grid(rows, panel.observed_calendar(rows)), 2).select("series", "bar", "level")


@query(with_(LEVELS_SQL["hourly_events"], BARS, _HOURS, last="SELECT series, count(*) FILTER (WHERE level IS NULL) AS gaps, count(*) AS bars FROM ff GROUP BY series"))
def gap_report(spark, sf_dir):
    rows = levels(spark, sf_dir, "hourly_events")
    return panel.gap_report(panel.forward_fill(panel.grid(rows, panel.observed_calendar(rows)), 2))


@query(with_(*panel_sql(), last=f"SELECT series, bar, {sql_r('ret')} AS ret FROM rets"))
def observed_returns(spark, sf_dir):
    return returns(spark, sf_dir).select("series", "bar", r("ret").alias("ret"))


@query(with_(LEVELS_SQL["monthly_discount"], BARS, last=f"SELECT series, bar, {sql_r('ret')} AS ret FROM (SELECT series, bar, level - lag(level) OVER (PARTITION BY series ORDER BY bar) AS ret FROM levels JOIN bars ON levels.ts = bars.ts) WHERE ret IS NOT NULL"))
def difference_returns(spark, sf_dir):
    rows = levels(spark, sf_dir, "monthly_discount")
    out = panel.observed_returns(rows, panel.observed_calendar(rows), universe.transforms(catalog(spark, sf_dir)))
    return out.select("series", "bar", r("ret").alias("ret"))


@query(with_(*panel_sql("weekly_orders"), last=f"SELECT series, bar, {sql_r('ret')} AS ret FROM panel"))
def filled_panel(spark, sf_dir):
    return full_panel(spark, sf_dir, "weekly_orders").select("series", "bar", r("ret").alias("ret"))


_WINSOR = "wins AS (SELECT series, bar, CASE WHEN s > 0 THEN least(greatest(ret, m - 2.0 * s), m + 2.0 * s) ELSE ret END AS ret FROM (SELECT *, avg(ret) OVER (PARTITION BY series) AS m, stddev_samp(ret) OVER (PARTITION BY series) AS s FROM rets))"


@query(with_(*panel_sql("daily_brand"), _WINSOR, last=f"SELECT series, bar, {sql_r('ret')} AS ret FROM wins"))
def winsorized_returns(spark, sf_dir):
    return panel.winsorize(returns(spark, sf_dir, "daily_brand"), 2.0).select("series", "bar", r("ret").alias("ret"))


@query(with_(*panel_sql("daily_brand"), last=f"SELECT series, {sql_r('avg(CASE WHEN ret <> 0 THEN 1.0 ELSE 0.0 END)', 6)} AS coverage FROM panel GROUP BY series HAVING avg(CASE WHEN ret <> 0 THEN 1.0 ELSE 0.0 END) >= 0.10"))
def coverage_filter(spark, sf_dir):
    kept = panel.covered(full_panel(spark, sf_dir, "daily_brand"), 0.10)
    return panel.coverage(kept).select("series", r("coverage", 6).alias("coverage"))


@query(with_(*panel_sql(), last=f"SELECT series, bar, {sql_r('ret')} AS ret FROM panel WHERE bar > (SELECT max(bar) FROM panel) - 50"))
def recent_window(spark, sf_dir):
    return panel.recent(full_panel(spark, sf_dir), 50).select("series", "bar", r("ret").alias("ret"))


@query(with_(*panel_sql(), last=f"""SELECT series, bar, {sql_r('future')} AS future, {sql_r('h0')} AS h0, {sql_r('h1')} AS h1, {sql_r('h2')} AS h2 FROM (
  SELECT series, bar, row_number() OVER w - 1 AS i, lead(ret, 2) OVER w AS future, ret AS h0, lag(ret, 1) OVER w AS h1, lag(ret, 2) OVER w AS h2 FROM panel WINDOW w AS (PARTITION BY series ORDER BY bar)) WHERE i >= 3 AND future IS NOT NULL"""))
def delay_embedding(spark, sf_dir):
    rows = panel.embedding(full_panel(spark, sf_dir), 2, 3)
    return rows.select("series", "bar", r("future").alias("future"), *[r(F.col("past")[k]).alias(f"h{k}") for k in range(3)])


@query(with_(*panel_sql(), last=f"""SELECT a.series AS target, a.bar, {sql_r('a.ret')} AS y, count(*) AS n_features, {sql_r('sum(b.ret * (a.bar - b.bar))', 6)} AS weighted
FROM panel a JOIN panel b ON b.bar BETWEEN a.bar - 2 AND a.bar - 1 WHERE a.bar >= (SELECT min(bar) FROM panel) + 2 GROUP BY a.series, a.bar, a.ret"""))
def var_design(spark, sf_dir):
    rows = panel.lag_design(full_panel(spark, sf_dir), 2)
    n = F.size("x")
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (F.floor(i / (n / 2)) + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("target", "bar", r("y").alias("y"), n.cast("long").alias("n_features"), r(weighted, 6).alias("weighted"))


@query(with_(*panel_sql(), last=f"""SELECT a.bar, {sql_r('a.ret')} AS y, count(*) AS cells, {sql_r('sum(b.ret)', 6)} AS total FROM panel a JOIN panel b ON b.bar BETWEEN a.bar - 5 AND a.bar - 1
WHERE a.series = 'AF' AND a.bar >= (SELECT min(bar) FROM panel) + 5 GROUP BY a.bar, a.ret"""))
def window_stack(spark, sf_dir):
    rows = panel.window_stack(full_panel(spark, sf_dir), "AF", 5)
    flat = F.flatten("x")
    return rows.select("bar", r("y").alias("y"), F.size(flat).cast("long").alias("cells"), r(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(with_(*panel_sql("daily_brand"), """act AS (SELECT bar, avg(CASE WHEN abs(ret) > 1e-10 THEN 1.0 ELSE 0.0 END) AS active FROM panel GROUP BY bar ORDER BY bar DESC LIMIT 5)""", last="SELECT coalesce(max(CASE WHEN active > 0.4 THEN bar END), min(bar)) AS bar FROM act"))
def latest_active_bar(spark, sf_dir):
    return panel.latest_active_bar(full_panel(spark, sf_dir, "daily_brand")).select("bar")


@query(with_(*panel_sql(), last="SELECT count(DISTINCT series) AS series, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM panel"))
def panel_stats(spark, sf_dir):
    return full_panel(spark, sf_dir).agg(F.count_distinct("series").alias("series"), F.count(F.lit(1)).alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


_FEATURES = f"""feat AS (SELECT series, bar, ret, CASE WHEN count(*) OVER w >= 21 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS vol, CASE WHEN count(*) OVER w >= 21 THEN avg(ret) OVER w END AS mean FROM panel WINDOW w AS (PARTITION BY series ORDER BY bar ROWS 20 PRECEDING)),
z AS (SELECT series, bar, (vol - avg(vol) OVER p) / nullif(stddev_samp(vol) OVER p, 0) AS zvol, (mean - avg(mean) OVER p) / nullif(stddev_samp(mean) OVER p, 0) AS zmean FROM feat WHERE vol IS NOT NULL WINDOW p AS (PARTITION BY series))"""


def features(rows):
    """(series, bar, zvol, zmean): rolling volatility and mean, standardised over the whole sample."""
    w, every = rolling(by("series"), 21), Window.partitionBy("series")
    rows = rows.withColumns({"vol": full(F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0)), w, 21), "mean": full(F.avg("ret").over(w), w, 21)}).where("vol is not null")
    z = lambda c: ratio(F.col(c) - F.avg(c).over(every), F.stddev_samp(c).over(every))
    return rows.select("series", "bar", z("vol").alias("zvol"), z("mean").alias("zmean"))


@query(with_(*panel_sql(), _FEATURES, last=f"SELECT series, bar, {sql_r('zvol', 6)} AS zvol, {sql_r('zmean', 6)} AS zmean FROM z"))
def regime_features(spark, sf_dir):
    return features(full_panel(spark, sf_dir)).select("series", "bar", r("zvol", 6).alias("zvol"), r("zmean", 6).alias("zmean"))


#: Roles played by the adapter's series: a first choice that isn't there, and one that nobody plays.
_ROLES = [("equity_vol", ["AF"], "volatility"), ("credit_stress", ["XX", "NO", "AO"], "mean"), ("curve_slope", ["XY"], "mean"), ("fear", ["RO"], "mean")]
_NAMED = f"""cast_ AS (SELECT * FROM (VALUES ('equity_vol', 'AF', 1), ('credit_stress', 'XX', 0), ('credit_stress', 'NO', 0), ('credit_stress', 'AO', 0), ('curve_slope', 'XY', 0), ('fear', 'RO', 0)) AS t(feature, series, vol)),
there AS (SELECT feature, series, vol, row_number() OVER (PARTITION BY feature ORDER BY series = 'NO' DESC) AS k FROM cast_ WHERE series IN (SELECT series FROM panel)),
nf AS (SELECT feature, bar, count(*) OVER w AS n, CASE WHEN vol = 1 THEN stddev_samp(ret) OVER w * sqrt(252.0) ELSE avg(ret) OVER w END AS value FROM panel JOIN there ON there.series = panel.series AND k = 1 WINDOW w AS (PARTITION BY feature ORDER BY bar ROWS 20 PRECEDING)),
whole AS (SELECT * FROM nf WHERE n = 21 AND bar IN (SELECT bar FROM nf WHERE n = 21 GROUP BY bar HAVING count(*) = (SELECT count(DISTINCT feature) FROM there))),
named AS (SELECT bar, feature, CASE WHEN s > 0 THEN (value - m) / s ELSE value END AS value FROM (SELECT *, avg(value) OVER p AS m, stddev_samp(value) OVER p AS s FROM whole WINDOW p AS (PARTITION BY feature)))"""


def named_features(rows):
    """(bar, feature, value): the features of the series' roles."""
    return regimes.regime_features(rows, _ROLES)


@query(with_(*panel_sql(), _NAMED, last=f"SELECT bar, feature, {sql_r('value', 6)} AS value FROM named"))
def named_regime_features(spark, sf_dir):
    return named_features(full_panel(spark, sf_dir)).withColumn("value", r("value", 6))


_REGIMES = "mkt AS (SELECT bar, avg(zvol) AS v FROM z GROUP BY bar), regimes AS (SELECT bar, CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS regime, 1 / (1 + exp(-v)) AS p FROM mkt)"


def market_regimes(rows):
    """(bar, regime, p): a threshold on the market's mean standardised volatility."""
    v = features(rows).groupBy("bar").agg(F.avg("zvol").alias("v"))
    return v.select("bar", F.when(F.col("v") > 0.5, 1).otherwise(0).alias("regime"), (1 / (1 + F.exp(-F.col("v")))).alias("p"))


@query(with_(*panel_sql(), _FEATURES, _REGIMES, last=f"""SELECT regime, {sql_r('avg(ret)')} AS mean, {sql_r('stddev_pop(ret)')} AS std, count(DISTINCT bar) AS n, {sql_r('count(DISTINCT bar)::DOUBLE / (SELECT count(*) FROM regimes)', 6)} AS pct FROM panel JOIN regimes USING (bar) GROUP BY regime"""))
def regime_summary(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    out = robustness.regime_summary(rows.withColumnRenamed("ret", "value"), market_regimes(rows))
    return out.select("regime", r("mean").alias("mean"), r("std").alias("std"), "n", r("pct", 6).alias("pct"))


@query(with_(*panel_sql(), _FEATURES, _REGIMES, """flags AS (SELECT bar, (p > 0.5)::INT AS o FROM regimes), marks AS (SELECT *, CASE WHEN o <> coalesce(lag(o) OVER (ORDER BY bar), -1) THEN 1 ELSE 0 END AS c FROM flags),
isl AS (SELECT *, sum(c) OVER (ORDER BY bar ROWS UNBOUNDED PRECEDING) AS g FROM marks)""", last='SELECT min(bar) AS "start", max(bar) AS "end", count(*) AS bars FROM isl WHERE o = 1 GROUP BY g'))
def stress_islands(spark, sf_dir):
    return robustness.stress_blocks(market_regimes(full_panel(spark, sf_dir)).select("bar", "p"))


@query(with_(*panel_sql(), last=f"SELECT series, bar, {sql_r('sum(ret) OVER (PARTITION BY series ORDER BY bar ROWS UNBOUNDED PRECEDING)', 6)} AS total FROM panel"))
def cumulative_returns(spark, sf_dir):
    return robustness.cumulative(full_panel(spark, sf_dir)).select("series", "bar", r("total", 6).alias("total"))


@query(with_(*panel_sql(), last=f"SELECT series, {sql_r('quantile_cont(ret, 0.05)')} AS q05, {sql_r('quantile_cont(ret, 0.5)')} AS q50, {sql_r('quantile_cont(ret, 0.95)')} AS q95 FROM panel GROUP BY series"))
def return_quantiles(spark, sf_dir):
    return full_panel(spark, sf_dir).groupBy("series").agg(*[r(F.percentile("ret", F.lit(q))).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)])
