"""The registry of queries and the SQL table expressions that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators import panel
from panelflow.sources.adapters import LEVELS, LEVELS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if it can be said in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(column: Column | str, digits: int = 8) -> Column:
    """Rounded, without a negative zero; sql_r is the same in SQL."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def sql_r(text: str, digits: int = 8) -> str:
    return f"(round({text}, {digits}) + 0.0)"


def with_(*parts: str, last: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + last


def held(rows: DataFrame) -> DataFrame:
    """Small rows, cached in no more partitions than there are cores, however many partitions shuffles have.

    A query reads its panel in many stages. Each has a task for each cached partition, and every task
    sends its figures to the driver, so with a shuffle's partitions these would grow with that setting.
    """
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).cache()


def levels(spark: SparkSession, sf_dir: str, name: str = "weekly_lineitem") -> DataFrame:
    """A panel's levels, kept once computed: the tables are scanned once, however often a query needs
    the panel, which is small whatever the tables' size (a row for each series and time). Spark knows
    equal plans again, so a session holds one copy of a folder's panel, however many queries run.
    """
    return held(LEVELS[name](spark, sf_dir))


def returns(spark: SparkSession, sf_dir: str, name: str = "weekly_lineitem") -> DataFrame:
    rows = levels(spark, sf_dir, name)
    return panel.observed_returns(rows, panel.observed_calendar(rows))


def full_panel(spark: SparkSession, sf_dir: str, name: str = "weekly_lineitem") -> DataFrame:
    return held(panel.filled(returns(spark, sf_dir, name)))


BARS = "bars AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM levels))"
RETS = """rets AS (SELECT * FROM (
  SELECT series, bar, ts, CASE WHEN prev > 0 AND level > 0 THEN ln(level / prev) END AS ret FROM (
    SELECT series, bar, levels.ts AS ts, level, lag(level) OVER (PARTITION BY series ORDER BY bar) AS prev FROM levels JOIN bars ON levels.ts = bars.ts)
) WHERE ret IS NOT NULL)"""
PANEL = """panel AS (
  SELECT s.series, b.bar, b.ts, coalesce(rets.ret, 0.0::DOUBLE) AS ret
  FROM (SELECT DISTINCT series FROM rets) s CROSS JOIN (SELECT DISTINCT bar, ts FROM rets) b LEFT JOIN rets ON rets.series = s.series AND rets.bar = b.bar)"""


def panel_sql(name: str = "weekly_lineitem") -> list[str]:
    return [LEVELS_SQL[name], BARS, RETS, PANEL]


def pair_sql(lag: int = 1, source: str = "panel") -> str:
    """pairs(source, target, bar, l, f): the source's return against the target's `lag` bars later."""
    return f"pairs AS (SELECT a.series AS source, b.series AS target, b.bar, a.ret AS l, b.ret AS f FROM {source} a JOIN {source} b ON a.bar + {lag} = b.bar AND a.series <> b.series)"


CORR = "CASE WHEN var_pop(l) > 1e-24 AND var_pop(f) > 1e-24 THEN covar_pop(l, f) / sqrt(var_pop(l) * var_pop(f)) END"
SLOPE = "CASE WHEN sum(l * l) - sum(l) * sum(l) / count(*) > 1e-20 THEN (sum(l * f) - sum(l) * sum(f) / count(*)) / (sum(l * l) - sum(l) * sum(l) / count(*)) END"
K, H = 5, 3
PSI = "psi AS (SELECT g AS n, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / nullif(g - 1, 0)) OVER (ORDER BY g), 0.0) AS v FROM range(1, 4001) t(g))"


def entropy_sql(lags: list[int], source: str = "panel") -> list[str]:
    """te(source, target, lag, te) by theta self-joins of the pairs' embeddings."""
    near = lambda s: "greatest(" + ", ".join(f"abs(a.{s}{j} - b.{s}{j})" for j in range(H)) + ")"
    past = ", ".join(f"lag({s}, {j}) OVER w AS {s}{j}" for s in "st" for j in range(H))
    return [
        f"pr AS (SELECT a.series AS source, b.series AS target, row_number() OVER (PARTITION BY a.series, b.series ORDER BY a.bar) - 1 AS i, a.ret AS s, b.ret AS t FROM {source} a JOIN {source} b ON a.bar = b.bar AND a.series <> b.series)",
        "size AS (SELECT source, target, count(*) AS n FROM pr GROUP BY source, target)",
        f"past AS (SELECT source, target, i, {past} FROM pr WINDOW w AS (PARTITION BY source, target ORDER BY i))",
        f"em AS (SELECT past.*, l.lag, f.t AS f FROM past CROSS JOIN (VALUES {', '.join(f'({x})' for x in lags)}) AS l(lag) JOIN pr f ON f.source = past.source AND f.target = past.target AND f.i = past.i + l.lag WHERE past.i >= {H})",
        f"d AS (SELECT a.source, a.target, a.lag, a.i, {near('t')} AS own, abs(a.f - b.f) AS fut, {near('s')} AS oth FROM em a JOIN em b ON a.source = b.source AND a.target = b.target AND a.lag = b.lag)",
        f"eps AS (SELECT source, target, lag, i, list_sort(list(greatest(own, fut, oth)))[{K + 1}] - 1e-15 AS e FROM d GROUP BY source, target, lag, i)",
        "c AS (SELECT d.source, d.target, d.lag, d.i, greatest(count(*) FILTER (WHERE own <= e), 1) AS n_own, greatest(count(*) FILTER (WHERE greatest(own, fut) <= e), 1) AS n_fut, greatest(count(*) FILTER (WHERE greatest(own, oth) <= e), 1) AS n_oth FROM d JOIN eps ON d.source = eps.source AND d.target = eps.target AND d.lag = eps.lag AND d.i = eps.i GROUP BY d.source, d.target, d.lag, d.i)",
        PSI,
        f"te AS (SELECT c.source, c.target, lag, CASE WHEN count(*) < 50 OR any_value(size.n) < 50 THEN 0.0 ELSE greatest(0.0, (SELECT v FROM psi WHERE n = {K}) + avg(p1.v) - avg(p2.v) - avg(p3.v)) END AS te FROM c JOIN size ON c.source = size.source AND c.target = size.target JOIN psi p1 ON p1.n = n_own JOIN psi p2 ON p2.n = n_fut JOIN psi p3 ON p3.n = n_oth GROUP BY c.source, c.target, lag)",
    ]


def draws_sql(lags: list[int], count: int, source: str = "panel", targets: list[str] | None = None) -> list[str]:
    """te(source, target, lag, draw, te) of each pair (draw -1) and of its circularly shifted sources; the shifts are inline."""
    near = lambda s: "greatest(" + ", ".join(f"abs(a.{s}{j} - b.{s}{j})" for j in range(H)) + ")"
    key, pair = "source, target, lag, draw", lambda a, b: f"{a}.source = {b}.source AND {a}.target = {b}.target"
    same = lambda a, b: f"{pair(a, b)} AND {a}.lag = {b}.lag AND {a}.draw = {b}.draw"
    only = f" AND b.series IN ({', '.join(repr(t) for t in targets)})" if targets else ""
    past = ", ".join(f"lag(turned.s, {j}) OVER w AS s{j}, lag(pr.t, {j}) OVER w AS t{j}" for j in range(H))
    return [
        f"pr AS MATERIALIZED (SELECT a.series AS source, b.series AS target, row_number() OVER (PARTITION BY a.series, b.series ORDER BY a.bar) - 1 AS i, a.ret AS s, b.ret AS t FROM {source} a JOIN {source} b ON a.bar = b.bar AND a.series <> b.series{only})",
        "size AS (SELECT source, target, count(*) AS n FROM pr GROUP BY source, target)",
        f"wanted AS (SELECT *, greatest({2 * H + 1} + lag, 10) AS least FROM size CROSS JOIN (VALUES {', '.join(f'({x})' for x in lags)}) AS l(lag) CROSS JOIN (SELECT unnest(range(-1, {count})) AS draw))",
        "sh AS MATERIALIZED (SELECT source, target, lag, draw, n, CASE WHEN draw < 0 THEN 0 ELSE least + ('0x' || md5('0:' || source || '>' || target || ':' || draw)[:12])::BIGINT % (greatest(least + 1, n - least) - least) END AS shift FROM wanted)",
        f"turned AS (SELECT sh.source, sh.target, lag, draw, (pr.i + shift) % n AS i, pr.s FROM sh JOIN pr ON {pair('pr', 'sh')})",
        f"past AS (SELECT turned.source, turned.target, lag, draw, turned.i, {past} FROM turned JOIN pr ON {pair('pr', 'turned')} AND pr.i = turned.i WINDOW w AS (PARTITION BY turned.source, turned.target, lag, draw ORDER BY turned.i))",
        f"em AS MATERIALIZED (SELECT past.*, f.t AS f FROM past JOIN pr f ON {pair('f', 'past')} AND f.i = past.i + past.lag WHERE past.i >= {H})",
        f"d AS (SELECT a.source, a.target, a.lag, a.draw, a.i, {near('t')} AS own, abs(a.f - b.f) AS fut, {near('s')} AS oth FROM em a JOIN em b ON {same('a', 'b')})",
        f"eps AS MATERIALIZED (SELECT {key}, i, min(greatest(own, fut, oth), {K + 1})[{K + 1}] - 1e-15 AS e FROM d GROUP BY {key}, i)",
        f"c AS (SELECT d.source, d.target, d.lag, d.draw, d.i, greatest(count(*) FILTER (WHERE own <= e), 1) AS n_own, greatest(count(*) FILTER (WHERE greatest(own, fut) <= e), 1) AS n_fut, greatest(count(*) FILTER (WHERE greatest(own, oth) <= e), 1) AS n_oth FROM d JOIN eps ON {same('d', 'eps')} AND d.i = eps.i GROUP BY d.source, d.target, d.lag, d.draw, d.i)",
        PSI,
        f"te AS MATERIALIZED (SELECT c.source, c.target, lag, draw, CASE WHEN count(*) < 50 OR any_value(size.n) < 50 THEN 0.0 ELSE greatest(0.0, (SELECT v FROM psi WHERE n = {K}) + avg(p1.v) - avg(p2.v) - avg(p3.v)) END AS te FROM c JOIN size ON {pair('c', 'size')} JOIN psi p1 ON p1.n = n_own JOIN psi p2 ON p2.n = n_fut JOIN psi p3 ON p3.n = n_oth GROUP BY c.source, c.target, lag, draw)",
        f"effective AS (SELECT d.source, d.target, d.lag, any_value(o.te) AS te, greatest(0.0, any_value(o.te) - avg(d.te)) AS te_effective, avg((d.te >= o.te)::INT) AS p_value FROM te d JOIN te o ON o.draw < 0 AND d.draw >= 0 AND {pair('o', 'd')} AND o.lag = d.lag GROUP BY d.source, d.target, d.lag)",
    ]


#: edges(source, target, lag, te): the transfer entropies at lag 1, for queries about graphs.
EDGES = ",\n".join([*entropy_sql([1]), "edges AS (SELECT source, target, lag, te FROM te)"])


def edges(spark: SparkSession, sf_dir: str, name: str = "weekly_lineitem") -> DataFrame:
    from panelflow.operators.discovery import entropy_matrix

    return entropy_matrix(full_panel(spark, sf_dir, name), [1], K, H, noise=0.0)
