"""Parquet artefacts: cache-aside fetches, cached scans, optional scans, matrices by lag."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
LEVELS = "cls string, series string, ts timestamp_ntz, level double"


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Only a local session may lack that setting (tests do); it then gets one in /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return files.makeQualified(at).toString()


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, cut from their lineage by a table of the folder."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All classes' levels kept in a folder: cls=<name>/ partitions, so a class is pruned to its files."""
    return spark.read.schema(LEVELS).parquet(folder)


@dataclass(frozen=True)
class AtOnce:
    """A source that is read once for many keys."""

    fetch: Callable[[SparkSession, list[str]], DataFrame]


def fetch(spark: SparkSession, universe: DataFrame, folder: str, sources: dict[str, Callable], keys: frozenset[str] = frozenset(), refresh: bool = False) -> DataFrame:
    """Levels of every class: the folder's where it has the class, else fetched and kept.

    sources: name -> function (spark, source_key) giving (ts, level), or AtOnce(function (spark,
    source_keys) giving (source_key, ts, level)), which gets all keys of a class in one call. A series
    that can't be fetched, or whose source isn't among `keys`, is logged and left out.
    """
    rows = universe.select("cls", "series", "source", "source_key").collect()  # a catalog row for each series
    out = spark.createDataFrame([], LEVELS)
    for cls in sorted({r["cls"] for r in rows}):
        path = f"{folder}/cls={cls}"
        if refresh or not exists(spark, path):
            parts, together = [], {}
            for r in (r for r in rows if r["cls"] == cls):
                if r["source"] not in sources or (keys and r["source"] not in keys):
                    log.warning("%s: no source %s", r["series"], r["source"])
                    continue
                if isinstance(sources[r["source"]], AtOnce):
                    together.setdefault(r["source"], []).append((r["source_key"], r["series"]))
                    continue
                try:
                    got = sources[r["source"]](spark, r["source_key"]).select("ts", "level")
                    parts.append(got.withColumn("series", F.lit(r["series"])).select("series", "ts", "level"))
                except Exception as error:  # one series' failure leaves the others
                    log.warning("%s: %s", r["series"], error)
            for source, names in together.items():
                try:
                    named = spark.createDataFrame(names, "source_key string, series string")
                    parts.append(sources[source].fetch(spark, [k for k, _ in names]).join(named, "source_key").select("series", "ts", "level"))
                except Exception as error:
                    log.warning("%s of %s: %s", source, cls, error)
            if not parts:
                continue
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            whole.write.mode("overwrite").parquet(path)
        out = out.unionByName(spark.read.parquet(path).withColumn("cls", F.lit(cls)).select("cls", "series", "ts", "level"))
    return out


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or no rows of its schema."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def save_matrices(edges: DataFrame, path: str) -> None:
    """Edges by lag: a partition folder for each."""
    edges.write.mode("overwrite").partitionBy("lag").parquet(path)


def matrix_lags(spark: SparkSession, path: str) -> DataFrame:
    """The lags kept at path."""
    return spark.read.parquet(path).select(F.col("lag").cast("int").alias("lag")).distinct().orderBy("lag")


def demo_matrix(spark: SparkSession, n: int = 8, seed: int = 42) -> DataFrame:
    """A made-up matrix of n series, for views without artefacts; the same for the same seed."""
    ids = spark.range(n).select(F.format_string("S%02d", "id").alias("s"))
    pairs = ids.select(F.col("s").alias("source")).join(ids.select(F.col("s").alias("target")), F.col("source") != F.col("target"))
    unit = F.pmod(F.xxhash64(F.lit(seed), "source", "target"), F.lit(1_000_000)) / F.lit(1e6)
    return pairs.select("source", "target", F.lit(1).alias("lag"), (unit * 0.15).alias("te"))


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
