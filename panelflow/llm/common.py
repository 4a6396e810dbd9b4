"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds as word lists at a time.
SLICE_BYTES = 4 << 20
#: Bytes of a row group of an intermediate table: a task that writes or reads one holds a row group in
#: the heap, and Parquet's usual 128 MB let it grow with what a task has written.
ROW_GROUP_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack that setting (tests do); it then gets one in /tmp.
    The folder goes when the driver's JVM ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, cut from their lineage by a Parquet table in a shared folder, of small row groups."""
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def released() -> None:
    """Gives memory that this Python worker no longer uses back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for a map over batches, with released() at the end of each task."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            released()

    return tidy


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of a shared folder that no later job reads."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def tasks_for(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n: the folds that the learned operators hold out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def bounded_sample(df: DataFrame, key: str, strata: str, per_stratum: int) -> DataFrame:
    """At most about per_stratum rows of each stratum (null is none), spread evenly by a hash of key.

    One aggregate over the strata's column counts them; they are the values that a model tells
    apart, so they are few. Rows are then kept by comparing their hash with the share wanted: no
    rows are sorted, joined or gathered.
    """
    counts = df.where(F.col(strata).isNotNull()).groupBy(strata).count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(strata) == F.lit(r[0]), per_stratum / r[1]).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) / F.lit(1e6)
    return df.where(unit < share)


def joined(big: DataFrame, small: DataFrame, key: str, folder: str, name: str, share: int = 1000) -> DataFrame:
    """big with the columns of small, which has at most one row for each key: a left join.

    Keys (not null) that hold more than a thousandth of big's rows, fewer than `share` of them whatever
    big's size, are joined by broadcast; the other rows are shuffled, of which no key has more.
    big is counted first, so it should be a written table.
    """
    n = big.count()
    hot = written(big.groupBy(key).count().where(F.col("count") > max(n // share, 1)).select(key), folder, f"{name}_hot")
    there = hot.join(small, key, "left")
    at_once = big.join(F.broadcast(there), key)
    rest = big.join(F.broadcast(hot), key, "left_anti").join(small, key, "left")
    return at_once.unionByName(rest)
