"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by source and key, so that a
large source spreads over many partitions; distributed prefix sums of the sizes (sums of each
partition, then offsets, then running sums inside the partitions) place each document in its
source's order, and the source is cut at its exact budget, after whole epochs where the budget
exceeds the source.

Targets: sources by code point, null last, have weights that repeat in turn and share a budget;
none may exceed `most` times its source's size, and the excess is shared again by weight until
none does. Each round of that is one aggregate over the table of sources.

The sorted table is written before it is summed: a range's bounds are sampled and could differ
if it were computed twice. Cases: a null text has size 0 and is never taken; a null source is a
source of its own; null or repeated ids are rows like others (equal rows can't be told apart);
sources without a word get target 0; an empty table gives an empty one; other columns aren't
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.common import shared_dir, tasks_for, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, seed: int) -> Column:
    """A number that depends on the seed and the id alone: the first 60 bits of their MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, most: float, folder: str) -> DataFrame:
    """sources (source, place, weight, source_size) with their targets."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        at = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if at["n"] == capped or not at["weight"]:
            break
        capped, level = at["n"], (share * total - most * (at["held"] or 0)) / at["weight"]
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level))))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, size, source_size, target, taken) of every document; keep: more columns of df to carry along."""
    spark = df.sparkSession
    folder, keep = shared_dir(spark), keep or {}
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *[c.alias(k) for k, c in keep.items()])
    sized = written(sized.withColumn("key", random_key(F.col("id"), seed)), folder, "sized")
    order = [F.col("key").asc(), F.col("id").asc_nulls_last(), F.col("size").asc()]
    placed = sized.repartitionByRange(tasks_for(spark), F.col("source").asc_nulls_last(), *order)
    placed = written(placed.withColumn("part", F.spark_partition_id()), folder, "placed")

    sums = written(placed.groupBy("part", "source").agg(F.sum("size").alias("held")), folder, "sums")
    # a source's place in code point order: those that begin in earlier partitions, then those before it in its own
    sources = sums.groupBy("source").agg(F.min("part").alias("begins"), F.sum("held").alias("source_size"))
    earlier = sources.groupBy("begins").count().withColumn("before", F.sum("count").over(Window.orderBy("begins").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("begins").alias("b"), F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("begins").orderBy(F.col("source").asc_nulls_last()))
    sources = sources.join(earlier, sources["begins"] == earlier["b"]).withColumn("place", F.col("before") + within - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "source_size", weight.cast("long").alias("weight")), folder, "sources")
    sources = targets(sources, share, most, folder)

    before = F.sum("held").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", "source", F.coalesce(before, F.lit(0)).alias("offset"))
    offsets = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    offsets = written(offsets, folder, "offsets").select(F.col("part").alias("p"), F.col("source").alias("s"), "offset", "source_size", "target")

    running = F.sum("size").over(Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.withColumn("running", F.coalesce(running, F.lit(0)))
    rows = rows.join(offsets, (rows["part"] == offsets["p"]) & rows["source"].eqNullSafe(offsets["s"]))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("running")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of df once for each epoch that takes it, the last cut after its last taken word.

    Rows that agree in id, text and source share what they were given together.
    """
    key = {"k1": F.xxhash64(id_col, source_col, text_col), "k2": F.xxhash64(F.lit(1), text_col, source_col, id_col)}
    given = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, keep=key, **options)
    given = given.groupBy("k1", "k2").agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size")).where("__taken > 0")
    rows = df.withColumns({f"__{k}": c for k, c in key.items()})
    one = Window.partitionBy("__k1", "__k2").orderBy(F.lit(1))
    rows = rows.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    rows = rows.join(given, (rows["__k1"] == given["k1"]) & (rows["__k2"] == given["k2"]))
    copies = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    # words with the blanks behind them; a piece of blanks only may come first
    pieces = F.split(text_col, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    ahead = F.when(F.get(pieces, F.lit(0)).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), left.cast("int") + ahead), "")
    text = F.when(left >= F.col("__size"), F.col(text_col)).otherwise(cut)
    return rows.select(*[(text if c == text_col else F.col(c)).alias(c) for c in df.columns])
