"""Queries about pairs, influence and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.operators import discovery, gram, pairs, panel, varmodels
from panelflow.plans.base import CORR, EDGES, PSI, SLOPE, H, K, draws_sql, edges, entropy_sql, full_panel, pair_sql, panel_sql, query, r, returns, sql_r, with_
from panelflow.plans.panels import _FEATURES, _REGIMES, market_regimes
from panelflow.sources import store

P1 = [*panel_sql(), pair_sql(1)]
GRAPH = [*P1, EDGES]


@query(with_(*P1, last=f"SELECT source, target, 1 AS lag, count(*) AS n, {sql_r(f'CASE WHEN count(*) > 20 THEN coalesce({CORR}, 0.0) ELSE 0.0 END')} AS corr FROM pairs GROUP BY source, target"))
def lagged_corr(spark, sf_dir):
    return pairs.lagged_correlation(full_panel(spark, sf_dir), [1]).withColumn("corr", r("corr"))


_TAIL = "tail AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY bar DESC) AS k FROM rets), tp AS (SELECT a.series AS source, b.series AS target, a.ret AS l, b.ret AS f FROM tail a JOIN tail b ON a.k = b.k + 1 AND a.series <> b.series)"


@query(with_(*panel_sql("hourly_events"), _TAIL, last=f"SELECT source, target, count(*) AS n, {sql_r(f'CASE WHEN count(*) > 50 THEN coalesce({CORR}, 0.0) ELSE 0.0 END')} AS corr FROM tp GROUP BY source, target"))
def tail_corr(spark, sf_dir):
    return pairs.tail_correlation(returns(spark, sf_dir, "hourly_events")).withColumn("corr", r("corr"))


@query(with_(*P1, last=f"SELECT source, target, count(*) AS n, {sql_r(f'CASE WHEN count(*) >= 30 THEN {SLOPE} END')} AS beta FROM pairs GROUP BY source, target"))
def regression_beta(spark, sf_dir):
    return pairs.regression(full_panel(spark, sf_dir)).withColumn("beta", r("beta"))


_SIGMA = "sig AS (SELECT series, stddev_samp(ret) AS s FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bar DESC) AS k FROM panel) WHERE k <= 252 GROUP BY series)"


@query(with_(*P1, _SIGMA, f"c AS (SELECT source, target, CASE WHEN count(*) > 20 THEN coalesce({CORR}, 0.0) ELSE 0.0 END AS corr FROM pairs GROUP BY source, target)", last=f"SELECT source, target, {sql_r('corr')} AS corr, {sql_r('CASE WHEN a.s > 0 THEN corr * b.s / a.s END')} AS beta FROM c JOIN sig a ON a.series = source JOIN sig b ON b.series = target"))
def scaled_beta(spark, sf_dir):
    return pairs.scaled_beta(full_panel(spark, sf_dir)).select("source", "target", r("corr").alias("corr"), r("beta").alias("beta"))


_HITS = f"""sg AS (SELECT source, target, sign(coalesce({CORR}, 0.0)) AS s FROM pairs GROUP BY source, target),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY bar DESC) AS k FROM pairs) JOIN sg USING (source, target) WHERE k <= 252),
hits AS (SELECT source, target, count(*) FILTER (WHERE abs(l) > 1e-8) AS signals, count(*) FILTER (WHERE abs(l) > 1e-8 AND f <> 0) AS n, count(*) FILTER (WHERE abs(l) > 1e-8 AND f <> 0 AND sign(l * s) = sign(f)) AS hits FROM late GROUP BY source, target),
rates AS (SELECT source, target, hits, n, CASE WHEN signals >= 30 AND n >= 20 THEN hits::DOUBLE / n END AS rate FROM hits)"""


@query(with_(*P1, _HITS, last=f"SELECT source, target, hits, n, {sql_r('rate', 6)} AS rate FROM rates"))
def hit_rate(spark, sf_dir):
    return pairs.hit_rate(full_panel(spark, sf_dir)).withColumn("rate", r("rate", 6))


@query(with_(*panel_sql("weekly_orders"), "both_ AS (SELECT a.series AS a, b.series AS b, a.ret AS l, b.ret AS f FROM panel a JOIN panel b ON a.bar = b.bar)", last=f"SELECT a, b, {sql_r(CORR)} AS corr, {sql_r('covar_samp(l, f)')} AS cov FROM both_ GROUP BY a, b"))
def corr_matrix(spark, sf_dir):
    return pairs.correlation_matrix(full_panel(spark, sf_dir, "weekly_orders")).select("a", "b", r("corr").alias("corr"), r("cov").alias("cov"))


@query(with_(*GRAPH, last=f"SELECT source, target, {sql_r('te')} AS te FROM edges ORDER BY te DESC, source, target LIMIT 10"))
def top_pairs(spark, sf_dir):
    return pairs.top_edges(edges(spark, sf_dir), 10).select("source", "target", r("te").alias("te"))


@query(with_(*GRAPH, last=f"SELECT target, source, {sql_r('te')} AS te, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY te DESC, source)::INT AS k FROM edges) WHERE k <= 2"))
def topk_leaders(spark, sf_dir):
    return pairs.top_per(edges(spark, sf_dir), "target", 2).select("target", "source", r("te").alias("te"), "rank")


_ENDS = "ends AS (SELECT source AS series, te, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, te, 0, 1 FROM edges)"


@query(with_(*GRAPH, _ENDS, last=f"SELECT series, {sql_r('sum(te)')} AS strength FROM ends GROUP BY series"))
def strength_totals(spark, sf_dir):
    return pairs.strength(edges(spark, sf_dir)).select("series", r("strength").alias("strength"))


_KEPT = "kept AS (SELECT * FROM edges WHERE te >= 0.005 ORDER BY te DESC, source, target LIMIT 12), kends AS (SELECT source AS series, 1 AS o, 0 AS i FROM kept UNION ALL SELECT target, 0, 1 FROM kept), deg AS (SELECT series, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM kends GROUP BY series)"


@query(with_(*GRAPH, _KEPT, last="SELECT series, out_degree, in_degree, out_degree + in_degree AS degree, 12 + 2 * (out_degree + in_degree) AS size FROM deg"))
def degree_stats(spark, sf_dir):
    return pairs.degrees(pairs.network(edges(spark, sf_dir), 0.005, 12))


@query(with_(*GRAPH, last="SELECT DISTINCT series FROM panel WHERE series NOT IN (SELECT source FROM edges WHERE te >= 0.02 UNION SELECT target FROM edges WHERE te >= 0.02)"))
def isolated_nodes(spark, sf_dir):
    return pairs.isolates(full_panel(spark, sf_dir), pairs.network(edges(spark, sf_dir), 0.02, 0))


@query(with_(*GRAPH, _KEPT, last="SELECT (SELECT series FROM deg ORDER BY out_degree DESC, series LIMIT 1) AS source_hub, (SELECT series FROM deg ORDER BY in_degree DESC, series LIMIT 1) AS sink_hub"))
def hub_nodes(spark, sf_dir):
    return pairs.hubs(pairs.network(edges(spark, sf_dir), 0.005, 12))


NAMES = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(with_(*GRAPH, last="SELECT source, " + ", ".join(f"(round(coalesce(max(CASE WHEN target = '{s}' THEN te END), 0.0), 8) + 0.0) AS \"{s}\"" for s in NAMES) + " FROM edges GROUP BY source"))
def wide_matrix(spark, sf_dir):
    """The whole matrix; the adapter's series are the columns, whatever the edges hold."""
    return pairs.wide(edges(spark, sf_dir), names=NAMES).select("source", *[r(n).alias(n) for n in NAMES])


@query(with_(*GRAPH, last=f"SELECT source, target, {sql_r('te')} AS te FROM edges"))
def tidy_matrix(spark, sf_dir):
    return pairs.tidy(pairs.wide(edges(spark, sf_dir))).select("source", "target", r("te").alias("te"))


@query(with_(*panel_sql(), *entropy_sql(discovery.LAGS), last=f"SELECT source, target, lag, {sql_r('te')} AS te FROM te"))
def te_matrix(spark, sf_dir):
    rows = panel.covered(full_panel(spark, sf_dir), 0.10)
    return discovery.entropy_matrix(rows, None, K, H, noise=0.0).withColumn("te", r("te"))


@query(with_(*panel_sql("weekly_orders"), *entropy_sql([1]), last=f"SELECT source, target, lag, {sql_r('te')} AS te FROM te"))
def te_matrix_orders(spark, sf_dir):
    return discovery.entropy_matrix(full_panel(spark, sf_dir, "weekly_orders"), [1], K, H, noise=0.0).withColumn("te", r("te"))


_DECAY = f"""dc AS (SELECT *, first_value(te) OVER o AS f, first_value(lag) OVER o AS fl, last_value(lag) OVER o AS ll FROM te WINDOW o AS (PARTITION BY source, target ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
dn AS (SELECT *, te / greatest(f, 1e-10) AS te_norm FROM dc),
dh AS (SELECT *, coalesce(min(CASE WHEN lag > fl AND te < f * 0.5 THEN lag END) OVER p, ll) AS half_life, coalesce(max(CASE WHEN lag = 2 THEN te_norm END) OVER p, 0.0) AS kept FROM dn WINDOW p AS (PARTITION BY source, target)),
lc AS (SELECT source, target, CASE WHEN count(*) > 20 THEN coalesce({CORR}, 0.0) ELSE 0.0 END AS lagged_corr FROM pairs GROUP BY source, target),
decay AS (SELECT dh.source, dh.target, lag, te, te_norm, half_life, CASE WHEN half_life <= 1 THEN 'HFT only' WHEN half_life <= 3 AND kept >= 0.30 THEN 'Next-day tradable' WHEN half_life <= 3 THEN 'Short-term' WHEN half_life <= 10 THEN 'Swing (tradable)' ELSE 'Slow decay (tradable)' END AS category,
CASE WHEN lagged_corr >= 0 THEN 'same' ELSE 'inverse' END AS direction, lagged_corr FROM dh JOIN lc ON dh.source = lc.source AND dh.target = lc.target)"""
_DECAYED = [*P1, *entropy_sql([1, 2, 3, 5]), _DECAY]


def _decay(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    return discovery.decay(discovery.entropy_matrix(rows, [1, 2, 3, 5], K, H, noise=0.0), pairs.lagged_correlation(rows, [1]))


@query(with_(*_DECAYED, last=f"SELECT source, target, lag, {sql_r('te')} AS te, {sql_r('te_norm', 3)} AS te_norm, half_life, category, direction, {sql_r('lagged_corr')} AS lagged_corr FROM decay"))
def te_decay(spark, sf_dir):
    return _decay(spark, sf_dir).withColumns({"te": r("te"), "te_norm": r("te_norm", 3), "lagged_corr": r("lagged_corr")})


@query(with_(*_DECAYED, last="SELECT category, count(DISTINCT source || '>' || target) AS pairs FROM decay GROUP BY category"))
def decay_categories(spark, sf_dir):
    return _decay(spark, sf_dir).groupBy("category").agg(F.count_distinct(F.concat_ws(">", "source", "target")).alias("pairs"))


def information_sql(lags: list[int]) -> list[str]:
    """mi(source, target, lag, mi) by theta self-joins of the pairs' rows."""
    key = "source, target, lag"
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("source", "target", "lag"))
    return [
        f"pr AS (SELECT a.series AS source, b.series AS target, lag, a.bar AS i, a.ret AS x, b.ret AS y FROM panel a CROSS JOIN (VALUES {', '.join(f'({x})' for x in lags)}) AS l(lag) JOIN panel b ON a.bar + lag = b.bar AND a.series <> b.series)",
        f"size AS (SELECT {key}, count(*) AS n FROM pr GROUP BY {key})",
        f"d AS (SELECT a.source, a.target, a.lag, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM pr a JOIN pr b ON {same('a', 'b')})",
        f"eps AS (SELECT {key}, i, list_sort(list(greatest(dx, dy)))[{K + 1}] - 1e-15 AS e FROM d GROUP BY {key}, i)",
        f"c AS (SELECT d.source, d.target, d.lag, d.i, greatest(count(*) FILTER (WHERE dx <= e), 1) + 1 AS nx, greatest(count(*) FILTER (WHERE dy <= e), 1) + 1 AS ny FROM d JOIN eps ON {same('d', 'eps')} AND d.i = eps.i GROUP BY d.source, d.target, d.lag, d.i)",
        PSI,
        f"mi AS (SELECT c.source, c.target, c.lag, CASE WHEN count(*) < 20 THEN 0.0 ELSE greatest(0.0, (SELECT v FROM psi WHERE n = {K}) - avg(p1.v + p2.v) + any_value(p3.v)) END AS mi FROM c JOIN size ON {same('c', 'size')} JOIN psi p1 ON p1.n = nx JOIN psi p2 ON p2.n = ny JOIN psi p3 ON p3.n = size.n GROUP BY c.source, c.target, c.lag)",
    ]


@query(with_(*panel_sql(), *information_sql(discovery.LAGS), last=f"SELECT source, target, lag, {sql_r('mi')} AS mi FROM mi"))
def mi_matrix(spark, sf_dir):
    return discovery.information_matrix(full_panel(spark, sf_dir), None, K, noise=0.0).withColumn("mi", r("mi"))


@query(with_(*panel_sql(), *entropy_sql([1]), last=f"SELECT source, target, lag, {sql_r('te')} AS te FROM te WHERE target IN ('RF', 'RO')"))
def te_of_followers(spark, sf_dir):
    """All leaders of some followers: only the followers' pairs are computed."""
    return discovery.entropy_matrix(full_panel(spark, sf_dir), [1], K, H, noise=0.0, targets=["RF", "RO"]).withColumn("te", r("te"))


#: The panel with each regime's series apart, of regimes with enough bars.
PARTED = "big AS (SELECT regime FROM regimes GROUP BY regime HAVING count(*) >= 60), parted AS (SELECT regime || ':' || series AS series, panel.bar, ret FROM panel JOIN regimes ON panel.bar = regimes.bar WHERE regime IN (SELECT regime FROM big))"


@query(with_(*panel_sql(), _FEATURES, _REGIMES, PARTED, *entropy_sql([1], "parted"), last=f"SELECT split_part(source, ':', 1)::INT AS regime, split_part(source, ':', 2) AS source, split_part(target, ':', 2) AS target, lag, {sql_r('te')} AS te FROM te"))
def te_by_regime(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    out = discovery.regime_entropy(rows, market_regimes(rows), [1], 60, k=K, history=H, noise=0.0)
    return out.withColumn("te", r("te"))


@query(with_(*panel_sql(), *draws_sql([1], 50), last=f"SELECT source, target, lag, {sql_r('te')} AS te, {sql_r('te_effective')} AS te_effective, {sql_r('p_value')} AS p_value FROM effective"))
def te_effective(spark, sf_dir):
    out = discovery.effective_matrix(full_panel(spark, sf_dir), 1, K, H, surrogates=50, noise=0.0)
    return out.withColumns({"te": r("te"), "te_effective": r("te_effective"), "p_value": r("p_value")})


@query()
def te_best_lag(spark, sf_dir):
    return discovery.variable_lags(full_panel(spark, sf_dir), None, None, K, H)


_CHOSEN = """chosen AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY te_effective DESC, lag) AS k FROM effective),
cut AS (SELECT source, target, n // 2 AS half FROM size),
"""


def _halves() -> str:
    """spread(source, target, lag, stability): the entropies of a pair's halves at its chosen lag."""
    near = lambda s: "greatest(" + ", ".join(f"abs(a.{s}{j} - b.{s}{j})" for j in range(H)) + ")"
    key = "source, target, part"
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("source", "target", "part"))
    past = ", ".join(f"lag({s}, {j}) OVER w AS {s}{j}" for s in "st" for j in range(H))
    return _CHOSEN + ",\n".join(
        [
            "hp AS MATERIALIZED (SELECT pr.source, pr.target, (i >= half)::INT AS part, CASE WHEN i >= half THEN i - half ELSE i END AS i, s, t, chosen.lag FROM pr JOIN cut ON cut.source = pr.source AND cut.target = pr.target JOIN chosen ON chosen.source = pr.source AND chosen.target = pr.target AND k = 1 WHERE half >= 50)",
            f"hpast AS (SELECT *, {past} FROM hp WINDOW w AS (PARTITION BY {key} ORDER BY i))",
            f"hem AS MATERIALIZED (SELECT hpast.*, f.t AS f FROM hpast JOIN hp f ON {same('f', 'hpast')} AND f.i = hpast.i + hpast.lag WHERE hpast.i >= {H})",
            f"hd AS (SELECT a.source, a.target, a.part, a.i, {near('t')} AS own, abs(a.f - b.f) AS fut, {near('s')} AS oth FROM hem a JOIN hem b ON {same('a', 'b')})",
            f"heps AS MATERIALIZED (SELECT {key}, i, min(greatest(own, fut, oth), {K + 1})[{K + 1}] - 1e-15 AS e FROM hd GROUP BY {key}, i)",
            f"hc AS (SELECT hd.source, hd.target, hd.part, hd.i, greatest(count(*) FILTER (WHERE own <= e), 1) AS n_own, greatest(count(*) FILTER (WHERE greatest(own, fut) <= e), 1) AS n_fut, greatest(count(*) FILTER (WHERE greatest(own, oth) <= e), 1) AS n_oth FROM hd JOIN heps ON {same('hd', 'heps')} AND hd.i = heps.i GROUP BY hd.source, hd.target, hd.part, hd.i)",
            f"hte AS (SELECT {key}, CASE WHEN count(*) < 50 THEN 0.0 ELSE greatest(0.0, (SELECT v FROM psi WHERE n = {K}) + avg(p1.v) - avg(p2.v) - avg(p3.v)) END AS te FROM hc JOIN psi p1 ON p1.n = n_own JOIN psi p2 ON p2.n = n_fut JOIN psi p3 ON p3.n = n_oth GROUP BY {key})",
            "spread AS (SELECT source, target, CASE WHEN sum(te) / 2 > 1e-10 THEN (max(te) - min(te)) / sum(te) END AS stability FROM hte GROUP BY source, target)",
        ]
    )


@query(with_(*panel_sql(), *draws_sql([1, 2, 3], 15, targets=["RF", "RO"]), _halves(), last=f"SELECT c.source, c.target, lag AS best_lag, {sql_r('te_effective')} AS te_effective, {sql_r('p_value')} AS p_value, {sql_r('stability')} AS stability_cv FROM chosen c LEFT JOIN spread s ON s.source = c.source AND s.target = c.target WHERE k = 1"))
def te_lag_of_followers(spark, sf_dir):
    """Best lags of all leaders of some followers."""
    out = discovery.variable_lags(full_panel(spark, sf_dir), [1, 2, 3], ["RF", "RO"], K, H, surrogates=15, noise=0.0)
    return out.select("source", "target", "best_lag", *[r(c).alias(c) for c in ("te_effective", "p_value", "stability_cv")])


@query()
def te_bootstrap(spark, sf_dir):
    return discovery.significance(full_panel(spark, sf_dir), "bootstrap", 1)


@query()
def te_surrogate(spark, sf_dir):
    return discovery.significance(full_panel(spark, sf_dir), "phase", 1, stop=50)


@query()
def te_shuffled(spark, sf_dir):
    """Draws end for a pair when 50 have reached its own entropy."""
    return discovery.significance(full_panel(spark, sf_dir), "shuffle", 1, stop=50)


@query()
def lasso_var(spark, sf_dir):
    return varmodels.lasso_var(full_panel(spark, sf_dir), lags=5)


@query()
def lasso_ahead(spark, sf_dir):
    rows = full_panel(spark, sf_dir)
    return varmodels.lasso_forecast(rows, varmodels.lasso_var(rows, lags=5), 5)


@query()
def lasso_lead_matrix(spark, sf_dir):
    return varmodels.lead_matrix(varmodels.lasso_var(full_panel(spark, sf_dir), lags=5))


_LAGGED = """places AS (SELECT bar, row_number() OVER (ORDER BY bar) - 1 AS pos FROM (SELECT DISTINCT bar FROM panel)),
placed AS (SELECT series, pos, ret FROM panel p JOIN places ON places.bar = p.bar),
cells AS (SELECT t.pos AS bar, k || ':' || s.series AS name, s.ret AS v FROM places t CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS l(k) JOIN placed s ON s.pos = t.pos - k WHERE t.pos >= 5 UNION ALL SELECT pos, '1', 1.0 FROM places WHERE pos >= 5)"""


@query(with_(*panel_sql(), _LAGGED, last=f"SELECT a.name AS a, b.name AS b, {sql_r('sum(a.v * b.v)')} AS value FROM cells a JOIN cells b ON a.bar = b.bar GROUP BY a.name, b.name"))
def var_gram(spark, sf_dir):
    """What the sparse autoregressions see: the sums of products of all series and their lags."""
    return gram.gram_cells(gram.gram(full_panel(spark, sf_dir), 5)).withColumn("value", r("value"))


_BETAS = ", ".join(f"b{k} AS (SELECT a.series AS source, b.series AS target, {k} AS lag, coalesce({SLOPE}, 0.0) AS coef FROM (SELECT series, bar, ret AS l FROM panel) a JOIN (SELECT series, bar, ret AS f FROM panel) b ON a.bar + {k} = b.bar AND a.series <> b.series GROUP BY ALL)" for k in (1, 2, 3))


@query(with_(*panel_sql(), _BETAS, last=f"SELECT source, target, {sql_r('sum(abs(coef)) / 3')} AS lead FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) GROUP BY source, target"))
def lead_matrix_of_betas(spark, sf_dir):
    """The lead matrix of a written table of coefficients: slopes at three lags."""
    rows = full_panel(spark, sf_dir)
    parts = [pairs.regression(rows, k, 0).select("source", "target", F.lit(k).alias("lag"), F.coalesce("beta", F.lit(0.0)).alias("coef")) for k in (1, 2, 3)]
    kept = store.kept(parts[0].union(parts[1]).union(parts[2]), store.scratch(spark), "coefficients")
    return varmodels.lead_matrix(kept).withColumn("lead", r("lead"))
