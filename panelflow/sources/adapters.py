"""Level panels (cls, series, ts, level) made of the driver's tables.

Money is summed in cents and other values in millionths, as integers, so that a level doesn't
depend on the order of summation. The heavy part is one scan with partial aggregation; what is
shuffled is a row for each series, time and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, WEEK, HOUR = "DAY", "WEEK", "HOUR"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def _levels(cls: str, rows: DataFrame, series: Column, ts: Column, num: Column, den: Column, scale: float) -> DataFrame:
    grouped = rows.groupBy(series.alias("series"), ts.alias("ts")).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    return grouped.where("b > 0").select(F.lit(cls).alias("cls"), "series", "ts", (F.col("a").cast("double") / F.lit(scale) / F.col("b").cast("double")).alias("level"))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def weekly_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return _levels("lineitem", rows, F.concat("l_returnflag", "l_linestatus"), _at(WEEK, F.col("l_shipdate")), cents("l_extendedprice"), F.col("l_quantity").cast("long"), 100.0)


def weekly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return _levels("orders", rows, F.col("c_mktsegment"), _at(WEEK, F.col("o_orderdate")), cents("o_totalprice"), F.lit(1).cast("long"), 100.0)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return _levels("events", rows, F.col("event_type"), _at(HOUR, F.col("ts")), F.round(F.col("value") * 1e6).cast("long"), F.lit(1).cast("long"), 1e6)


def daily_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return _levels("brand", rows, F.col("p_brand"), _at(DAY, F.col("l_shipdate")), cents("l_extendedprice"), F.col("l_quantity").cast("long"), 100.0)


def monthly_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate-like, low-frequency class: its transform is `diff`."""
    rows = table(spark, sf_dir, "lineitem")
    return _levels("macro", rows, F.concat(F.lit("disc_"), F.col("l_returnflag")), _at("MONTH", F.col("l_shipdate")), cents("l_discount"), F.lit(1).cast("long"), 100.0)


# The same panels in DuckDB's SQL: name -> text of a `levels` table expression.
def _sql(cls: str, series: str, ts: str, num: str, den: str, scale: str, source: str) -> str:
    return f"levels AS (SELECT '{cls}' AS cls, {series} AS series, {ts} AS ts, sum({num})::DOUBLE / {scale} / sum({den})::DOUBLE AS level FROM {source} GROUP BY ALL HAVING sum({den}) > 0)"


LEVELS_SQL = {
    "weekly_lineitem": _sql("lineitem", "l_returnflag || l_linestatus", "date_trunc('week', l_shipdate)::TIMESTAMP", "round(l_extendedprice * 100)::BIGINT", "l_quantity::BIGINT", "100.0::DOUBLE", "lineitem"),
    "weekly_orders": _sql("orders", "c_mktsegment", "date_trunc('week', o_orderdate)::TIMESTAMP", "round(o_totalprice * 100)::BIGINT", "1::BIGINT", "100.0::DOUBLE", "orders JOIN customer ON o_custkey = c_custkey"),
    "hourly_events": _sql("events", "event_type", "date_trunc('hour', ts)", "round(value * 1000000)::BIGINT", "1::BIGINT", "1000000.0::DOUBLE", "events").replace("AS ts,", "AS ts,"),
    "daily_brand": _sql("brand", "p_brand", "date_trunc('day', l_shipdate)::TIMESTAMP", "round(l_extendedprice * 100)::BIGINT", "l_quantity::BIGINT", "100.0::DOUBLE", "lineitem JOIN part ON l_partkey = p_partkey"),
    "monthly_discount": _sql("macro", "'disc_' || l_returnflag", "date_trunc('month', l_shipdate)::TIMESTAMP", "round(l_discount * 100)::BIGINT", "1::BIGINT", "100.0::DOUBLE", "lineitem"),
}
LEVELS = {f.__name__: f for f in (weekly_lineitem, weekly_orders, hourly_events, daily_brand, monthly_discount)}
