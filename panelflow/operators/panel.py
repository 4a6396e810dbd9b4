"""From levels to clean returns: calendar, alignment, transforms, outliers, coverage.

All tables are long: a row for each series and bar. `bar` is the dense number of a time in the
calendar; lags count bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import by, clip
from panelflow.functions.prefix import ordinals

#: Bars that a class's last level is carried on at most; classes that aren't named: DEFAULT_FILL.
FILL_LIMITS = {"rates": 5, "credit": 5, "volatility": 5, "events": 5, "macro": 0}
DEFAULT_FILL = 3


def numbered(times: DataFrame) -> DataFrame:
    """(ts, bar) of distinct times."""
    return ordinals(times.select("ts").distinct(), "ts", name="bar")


def observed_calendar(levels: DataFrame) -> DataFrame:
    return numbered(levels)


def business_calendar(levels: DataFrame, all_week: tuple[str, ...] = ()) -> DataFrame:
    """Week days from the first to the last time, and the days that the all-week classes have."""
    ends = levels.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    rest = levels.where(F.col("cls").isin(*all_week)).select(F.to_date("ts").alias("day"))
    return numbered(days.union(rest).select(F.col("day").cast("timestamp_ntz").alias("ts")))


def grid(levels: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every series on every bar, its level where it was observed."""
    series = levels.select("cls", "series").distinct()
    cells = series.crossJoin(calendar)
    return cells.join(levels.select("series", "ts", "level"), ["series", "ts"], "left").select("cls", "series", "bar", "ts", "level")


def forward_fill(cells: DataFrame, limit: int | None = None, value: str = "level") -> DataFrame:
    """Carries the last value over at most `limit` missing bars; limit None: by class (FILL_LIMITS)."""
    past = by("series").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct("bar", value)), ignorenulls=True).over(past)
    if limit is None:
        most = F.lit(DEFAULT_FILL)
        for cls, n in FILL_LIMITS.items():
            most = F.when(F.col("cls") == cls, n).otherwise(most)
    else:
        most = F.lit(limit)
    held = cells.withColumn("__last", last).withColumn("__most", most)
    return held.withColumn(value, F.when(F.col("bar") - F.col("__last.bar") <= F.col("__most"), F.col(f"__last.{value}"))).drop("__last", "__most")


def gap_report(cells: DataFrame, value: str = "level") -> DataFrame:
    return cells.groupBy("series").agg(F.count_if(F.col(value).isNull()).alias("gaps"), F.count(F.lit(1)).alias("bars"))


def align(levels: DataFrame, calendar: DataFrame) -> DataFrame:
    return forward_fill(grid(levels, calendar))


def observed_returns(levels: DataFrame, calendar: DataFrame, transforms: DataFrame | None = None) -> DataFrame:
    """(series, bar, ts, ret): each observed level against the series' last observed one.

    transforms: (series, transform); `diff` takes differences, anything else the log ratio. A bar
    without a level has no row; the ratio is null unless both levels are positive.
    """
    rows = levels.where("level is not null and not isnan(level)").join(calendar, "ts").select("series", "bar", "ts", "level")
    if transforms is None:
        rows = rows.withColumn("transform", F.lit("log_return"))
    else:
        rows = rows.join(transforms, "series", "left").withColumn("transform", F.coalesce("transform", F.lit("log_return")))
    last = F.lag("level").over(by("series"))
    log_ratio = F.when((last > 0) & (F.col("level") > 0), F.log(F.col("level") / last))
    ret = F.when(F.col("transform") == "diff", F.col("level") - last).otherwise(log_ratio)
    return rows.withColumn("ret", ret).where("ret is not null").select("series", "bar", "ts", "ret")


def filled(returns: DataFrame) -> DataFrame:
    """Every series on every bar that any series has a return on; 0 where it has none."""
    bars, series = returns.select("bar", "ts").distinct(), returns.select("series").distinct()
    cells = series.crossJoin(bars)
    return cells.join(returns.select("series", "bar", "ret"), ["series", "bar"], "left").select("series", "bar", "ts", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def winsorize(returns: DataFrame, n_sigma: float = 4.0, expanding: bool = False) -> DataFrame:
    """Clips at the mean +- n_sigma standard deviations; untouched where there is no spread.

    expanding: moments of the bars up to the row's own only, so that no row sees the future.
    """
    w = by("series").rowsBetween(Window.unboundedPreceding, 0) if expanding else Window.partitionBy("series")
    rows = returns.withColumns({"__m": F.avg("ret").over(w), "__s": F.stddev_samp("ret").over(w)})
    kept = F.when(F.col("__s") > 0, clip(F.col("ret"), F.col("__m") - n_sigma * F.col("__s"), F.col("__m") + n_sigma * F.col("__s"))).otherwise(F.col("ret"))
    return rows.withColumn("ret", kept).drop("__m", "__s")


def recent(returns: DataFrame, bars: int) -> DataFrame:
    """The last `bars` bars; all if bars is 0 or less."""
    if bars <= 0:
        return returns
    last = returns.agg(F.max("bar").alias("__last"))
    return returns.join(F.broadcast(last), F.col("bar") > F.col("__last") - bars).drop("__last")


def coverage(returns: DataFrame) -> DataFrame:
    """(series, coverage): the share of a series' rows with a return other than zero; null is none."""
    return returns.groupBy("series").agg(F.avg(F.when(F.coalesce("ret", F.lit(0.0)) != 0, 1.0).otherwise(0.0)).alias("coverage"))


def covered(returns: DataFrame, least: float = 0.10) -> DataFrame:
    return returns.join(coverage(returns).where(F.col("coverage") >= least).select("series"), "series", "left_semi")


def embedding(returns: DataFrame, lag: int = 1, history: int = 3) -> DataFrame:
    """Own-history embedding: (series, bar, future, past): past has the row's and the bars before it."""
    w = by("series")
    rows = returns.withColumns({"i": F.row_number().over(w) - 1, "future": F.lead("ret", lag).over(w), "past": F.array(*[F.lag("ret", k).over(w) for k in range(history)])})
    return rows.where((F.col("i") >= history) & F.col("future").isNotNull()).select("series", "bar", "future", "past")


def lag_design(returns: DataFrame, lags: int) -> DataFrame:
    """(target, bar, y, x): x has all series at lag 1, then at lag 2 and so on, series in name order.

    returns must have a row for each series and bar. The lags are taken series by series.
    """
    before = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("ret", k).over(by("series")).alias("v")) for k in range(1, lags + 1)])
    parts = returns.select("series", "bar", before.alias("ps")).select("series", "bar", F.explode("ps").alias("p")).select("bar", F.struct("p.lag", "series", "p.v").alias("p"))
    rows = parts.groupBy("bar").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    return returns.join(rows, "bar").select(F.col("series").alias("target"), "bar", F.col("ret").alias("y"), "x")


def window_stack(returns: DataFrame, target: str, history: int) -> DataFrame:
    """(bar, y, x): the target's return and the `history` rows of all series before it, the target first.

    returns must have a row for each series and bar. The histories are taken series by series.
    """
    past = F.collect_list("ret").over(by("series").rowsBetween(-history, -1))
    parts = returns.select("bar", F.struct((F.col("series") != target).alias("other"), "series", "ret", past.alias("past")).alias("p"))
    rows = parts.groupBy("bar").agg(F.array_sort(F.collect_list("p")).alias("ps")).where(F.forall("ps", lambda p: F.size(p["past"]) == history))
    x = F.transform(F.sequence(F.lit(0), F.lit(history - 1)), lambda i: F.transform("ps", lambda p: F.get(p["past"], i)))
    return rows.select("bar", F.get("ps", F.lit(0))["ret"].alias("y"), x.alias("x"))


def latest_active_bar(returns: DataFrame, share: float = 0.4, back: int = 5, least: float = 1e-10) -> DataFrame:
    """(bar, active): the newest of the last `back` bars on which over `share` of series moved, else the oldest of them."""
    bars = returns.groupBy("bar").agg(F.avg(F.when(F.abs("ret") > least, 1.0).otherwise(0.0)).alias("active")).orderBy(F.desc("bar")).limit(back)
    return bars.agg(F.coalesce(F.max(F.when(F.col("active") > share, F.col("bar"))), F.min("bar")).alias("bar"), F.max_by("active", F.struct((F.col("active") > share).cast("int"), F.when(F.col("active") > share, F.col("bar")).otherwise(-F.col("bar")))).alias("active"))
