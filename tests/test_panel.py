import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.operators import panel
from panelflow.sources import http, store, universe

DAY = dt.datetime(2024, 1, 1)


def levels(spark, rows):
    return spark.createDataFrame([(c, s, DAY + dt.timedelta(days=d), x) for c, s, d, x in rows], "cls string, series string, ts timestamp_ntz, level double")


def long(spark, **series):
    return spark.createDataFrame([(s, i, float(x)) for s, xs in series.items() for i, x in enumerate(xs) if x is not None], "series string, bar long, ret double")


def test_log_and_difference_returns_skip_gaps(spark):
    df = levels(spark, [("a", "A", 0, 100.0), ("a", "A", 1, None), ("a", "A", 2, 110.0), ("a", "B", 0, 2.0), ("a", "B", 1, 2.5), ("a", "B", 2, -1.0), ("a", "C", 1, float("nan"))])
    transforms = spark.createDataFrame([("B", "diff"), ("A", "something else")], "series string, transform string")
    got = {(r["series"], r["bar"]): r["ret"] for r in panel.observed_returns(df, panel.observed_calendar(df), transforms).collect()}
    assert got == {("A", 2): pytest.approx(np.log(1.1)), ("B", 1): 0.5, ("B", 2): -3.5}
    logs = panel.observed_returns(df, panel.observed_calendar(df)).where("series = 'B'").collect()
    assert [(r["bar"]) for r in logs] == [1]  # no logarithm of a negative ratio


def test_filled_panel_drops_bars_without_any_return(spark):
    df = long(spark, A=[0.1, None, 0.3], B=[0.2, None, None]).withColumn("ts", F.lit(DAY).cast("timestamp_ntz"))
    assert sorted((r["series"], r["bar"], r["ret"]) for r in panel.filled(df).collect()) == [("A", 0, 0.1), ("A", 2, 0.3), ("B", 0, 0.2), ("B", 2, 0.0)]


@pytest.mark.parametrize(("gaps", "limit", "want"), [([1, None, 3, None, None, 6], 1, [1, 1, 3, 3, None, 6]), ([1, None, None, None, None, 6], 2, [1, 1, 1, None, None, 6]), ([None, 2], 3, [None, 2])])
def test_bounded_fill(spark, gaps, limit, want):
    cells = spark.createDataFrame([("a", "A", i, None if x is None else float(x)) for i, x in enumerate(gaps)], "cls string, series string, bar long, level double")
    filled = panel.forward_fill(cells, limit)
    assert [r["level"] for r in filled.orderBy("bar").collect()] == want
    assert panel.gap_report(filled).first()["gaps"] == want.count(None)


def test_calendar_and_limits_by_class(spark):
    df = levels(spark, [("rates", "R", 0, 1.0), ("fx", "X", 0, 1.0), ("macro", "M", 0, 1.0), ("crypto", "C", 5, 3.0), ("rates", "R", 14, 2.0), ("fx", "X", 5, 9.0)])
    week_days = panel.business_calendar(df)
    assert week_days.count() == 11 and panel.business_calendar(df, ("crypto",)).count() == 12
    got = panel.align(df, week_days).where("level is not null").groupBy("series").count().collect()
    assert {r["series"]: r["count"] for r in got} == {"R": 7, "X": 4, "M": 1}


def test_winsorize(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    x[[10, 50]] = [100, -100]
    df = long(spark, A=x, B=[0.5] * 20)
    got = np.array([r["ret"] for r in panel.winsorize(df, 4.0).where("series = 'A'").orderBy("bar").collect()])
    assert np.allclose(got, np.clip(x, x.mean() - 4 * x.std(ddof=1), x.mean() + 4 * x.std(ddof=1)))
    assert {r["ret"] for r in panel.winsorize(df).where("series = 'B'").collect()} == {0.5}


def test_expanding_winsorize_does_not_look_ahead(spark):
    x = np.random.default_rng(1).normal(size=60)
    first = panel.winsorize(long(spark, A=x), 1.0, expanding=True).where("bar < 40").orderBy("bar").collect()
    x[40:] = 9999
    assert panel.winsorize(long(spark, A=x), 1.0, expanding=True).where("bar < 40").orderBy("bar").collect() == first


def test_coverage(spark):
    df = long(spark, A=[0.0] * 95 + [1.0] * 5, B=[0.0] * 80 + [1.0] * 20)
    assert {r["series"] for r in panel.covered(df).collect()} == {"B"}


def test_embeddings(spark):
    df = long(spark, A=range(10), B=range(100, 110))
    rows = panel.embedding(df, 2, 3).where("series = 'A'").orderBy("bar").collect()
    assert [(r["bar"], r["future"], r["past"]) for r in rows][0] == (3, 5.0, [3.0, 2.0, 1.0]) and len(rows) == 10 - 2 - 3
    x = panel.lag_design(df, 2).where("target = 'B' and bar = 4").first()
    assert (x["y"], x["x"]) == (104.0, [3.0, 103.0, 2.0, 102.0])
    w = panel.window_stack(df, "B", 3).orderBy("bar").first()
    assert (w["bar"], w["y"], w["x"]) == (3, 103.0, [[100.0, 0.0], [101.0, 1.0], [102.0, 2.0]])


def test_latest_active_bar(spark):
    df = long(spark, A=[1, 1, 1, 0, 0], B=[1, 1, 0, 0, 0])
    assert panel.latest_active_bar(df).first()["bar"] == 2
    assert panel.latest_active_bar(long(spark, A=[0] * 9)).first()["bar"] == 4


def test_universe(spark, tmp_path):
    (tmp_path / "u.yaml").write_text("equities:\n  us:\n    SPX: {ticker: X, transform: diff}\nrates:\n  US10Y: {series_id: D, transform: diff, frequency: daily}\nmacro:\n")
    rows = universe.load(spark, str(tmp_path / "u.yaml"))
    assert {r["series"]: r["transform"] for r in universe.transforms(rows).collect()} == {"SPX": "log_return", "US10Y": "diff"}
    assert {r["series"]: r["subgroup"] for r in rows.collect()} == {"SPX": "us", "US10Y": None}


def test_fetch_keeps_what_it_got(spark, tmp_path):
    rows = universe.load(spark, str(_yaml(tmp_path)))
    calls = []

    def prices(spark, key):
        calls.append(key)
        if key == "bad":
            raise OSError("no answer")
        return spark.createDataFrame([(DAY, 1.0)], "ts timestamp_ntz, level double")

    folder = str(tmp_path / "cache")
    assert {r["series"] for r in store.fetch(spark, rows, folder, {"prices": prices}).collect()} == {"GOLD"}
    assert store.fetch(spark, rows, folder, {"prices": prices}).count() == 1 and calls == ["GC", "bad"]
    assert store.cached_scan(spark, folder).count() == 1
    assert store.optional(spark, str(tmp_path / "none"), store.LEVELS).count() == 0


def _yaml(tmp_path):
    path = tmp_path / "v.yaml"
    path.write_text("commodities:\n  GOLD: {ticker: GC}\n  OIL: {ticker: bad}\nmacro:\n  CPI: {series_id: C}\n")
    return path


def test_matrices_by_lag(spark, tmp_path):
    edges = store.demo_matrix(spark).union(store.demo_matrix(spark).withColumn("lag", F.lit(5)))
    store.save_matrices(edges, str(tmp_path / "te"))
    assert [r["lag"] for r in store.matrix_lags(spark, str(tmp_path / "te")).collect()] == [1, 5]
    assert edges.count() == 2 * 8 * 7


def test_http_answers():
    assert http.parse("Date,Close\n2024-01-02,1.5\n2024-01-03,.\n", "Date", "Close") == [(dt.datetime(2024, 1, 2), 1.5)]
    with pytest.raises(ValueError, match="no observation"):
        http.parse("Date,Close\n", "Date", "Close")
