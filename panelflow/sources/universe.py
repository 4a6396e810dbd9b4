"""The universe: which series there are, of which class, and how a level becomes a return."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "series string, cls string, subgroup string, source string, source_key string, transform string, frequency string"
#: Classes whose entries are nested in subgroups, and whose transform is always the log return.
NESTED = ("equities",)


def flatten(tree: dict[str, Any]) -> list[tuple]:
    """Rows of the nested catalog: class -> [subgroup ->] series -> attributes."""
    rows = []
    for cls, entries in tree.items():
        groups = entries.items() if cls in NESTED else [(None, entries)]
        for subgroup, series in groups:
            for name, a in (series or {}).items():
                source = "prices" if "ticker" in a else "series"
                transform = "log_return" if cls in NESTED else a.get("transform", "log_return")
                rows.append((name, cls, subgroup, source, a.get("ticker", a.get("series_id")), transform, a.get("frequency", "daily")))
    return rows


def load(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a YAML file as a small table; the file is read by the driver."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(flatten(yaml.safe_load(text) or {}), SCHEMA)


def demo(spark: SparkSession) -> DataFrame:
    """The universe of the adapters' series, named as they are made."""
    flags = [(f"{f}{s}", "lineitem", None, "table", "lineitem", "log_return", "weekly") for f in "ANR" for s in "FO"]
    segments = [(s, "orders", None, "table", "orders", "log_return", "weekly") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
    rates = [(f"disc_{f}", "macro", None, "table", "lineitem", "diff", "monthly") for f in "ANR"]
    return spark.createDataFrame(flags + segments + rates, SCHEMA)


def derived(levels: DataFrame, source: str = "table", differenced: tuple[str, ...] = ("macro",), frequencies: dict[str, str] | None = None) -> DataFrame:
    """The catalog of the series that levels (cls, series, ts, level) hold; classes named as `differenced` have rates."""
    frequency = F.lit("daily")
    for cls, name in (frequencies or {}).items():
        frequency = F.when(F.col("cls") == cls, name).otherwise(frequency)
    transform = F.when(F.col("cls").isin(*differenced), "diff").otherwise("log_return")
    rows = levels.select("cls", "series").distinct()
    return rows.select("series", "cls", F.lit(None).cast("string").alias("subgroup"), F.lit(source).alias("source"), F.col("series").alias("source_key"), transform.alias("transform"), frequency.alias("frequency"))


def transforms(universe: DataFrame) -> DataFrame:
    """(series, transform): nested classes and missing names get the log return."""
    nested = F.col("cls").isin(*NESTED)
    return universe.select("series", F.when(nested, "log_return").otherwise(F.coalesce("transform", F.lit("log_return"))).alias("transform"))
