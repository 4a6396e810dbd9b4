"""Running sums, maxima and numbers along an order, without sorting a table in one task.

Rows are dealt to spans of the order (by day for times, of SPAN numbers for bars). Each span is summed up by
partial aggregates, the spans' totals are run along (a row for each span), and rows get their span's
offset by a join and run inside it. Spans depend on the values alone, so a plan can be computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of a span of bars, and days of a span of times.
SPAN, SPAN_DAYS = 4096, 366


def span_of(df: DataFrame, order: str) -> Column:
    """The span of a row: from a time or date, or a whole number."""
    if isinstance(df.schema[order].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_date(F.to_date(order)) / SPAN_DAYS)
    return F.floor(F.col(order) / SPAN)


def _offsets(df: DataFrame, keys: tuple[str, ...], totals: dict[str, Column], run: dict[str, Column]) -> DataFrame:
    """(keys, __span, ...): what the spans before each one come to; `run` names window functions over the totals."""
    sums = df.groupBy(*keys, "__span").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "__span", *[c.over(before).alias(n) for n, c in run.items()])


def _placed(df: DataFrame, offsets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    right = offsets.select(*[F.col(k).alias(f"__r{k}") for k in keys], F.col("__span").alias("__rspan"), *[c for c in offsets.columns if c not in (*keys, "__span")])
    on = F.col("__span") == F.col("__rspan")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r{k}"))
    return df.join(right, on, "left").drop("__rspan", *[f"__r{k}" for k in keys])


def ordinals(df: DataFrame, order: str, keys: tuple[str, ...] = (), name: str = "number") -> DataFrame:
    """df with each row's number along the order, from 0; the order's values are distinct (of each key)."""
    rows = df.withColumn("__span", span_of(df, order))
    offsets = _offsets(rows, keys, {"__n": F.count(F.lit(1))}, {"__before": F.sum("__n")})
    own = F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(order)) - 1
    out = _placed(rows.withColumn("__own", own), offsets, keys)
    return out.withColumn(name, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__span", "__own", "__before")


def running(df: DataFrame, order: str, keys: tuple[str, ...] = (), sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums and maxima (the row's own included) of the given columns."""
    sums, maxima = sums or {}, maxima or {}
    kinds = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in maxima.items()}
    rows = df.withColumn("__span", span_of(df, order)).withColumns({f"__v{n}": c for n, (_, c) in kinds.items()})
    offsets = _offsets(rows, keys, {f"__t{n}": f(f"__v{n}") for n, (f, _) in kinds.items()}, {f"__t{n}": f(f"__t{n}") for n, (f, _) in kinds.items()})
    inside = Window.partitionBy(*keys, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = _placed(rows.withColumns({f"__w{n}": f(f"__v{n}").over(inside) for n, (f, _) in kinds.items()}), offsets, keys)
    joined = {n: F.coalesce(F.col(f"__w{n}") + F.col(f"__t{n}"), f"__w{n}", f"__t{n}") if n in sums else F.greatest(f"__w{n}", f"__t{n}") for n in kinds}
    return out.withColumns(joined).drop("__span", *[f"__{x}{n}" for x in "vwt" for n in kinds])


def previous(df: DataFrame, order: str, columns: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the row before's values: new name -> column; null on the first row."""
    rows = df.withColumn("__span", span_of(df, order))
    last = F.max_by(F.struct(*columns.values()), order)
    sums = rows.groupBy(*keys, "__span").agg(last.alias("__last"))
    offsets = sums.select(*keys, "__span", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__span")).alias("__before"))
    inside = Window.partitionBy(*keys, "__span").orderBy(order)
    held = rows.withColumns({f"__w{n}": F.lag(c).over(inside) for n, c in columns.items()} | {"__own": F.row_number().over(inside)})
    out = _placed(held, offsets, keys)
    values = {n: F.when(F.col("__own") == 1, F.col(f"__before.{c}")).otherwise(F.col(f"__w{n}")) for n, c in columns.items()}
    return out.withColumns(values).drop("__span", "__own", "__before", *[f"__w{n}" for n in columns])


def rolled(df: DataFrame, order: str, rows: int, columns: dict[str, tuple[Column, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """df with aggregates over the last `rows` rows, the own included: name -> (aggregate, rows it needs, else null).

    The last rows of a span go along with the next one. A span has SPAN rows, or `rows`, if that is more.
    """
    size = max(SPAN, rows)
    placed = ordinals(df, order, keys, "__pos").withColumns({"__span": F.floor(F.col("__pos") / size), "__own": F.lit(True)})
    tail = placed.where(F.col("__pos") % size > size - rows).withColumns({"__span": F.col("__span") + 1, "__own": F.lit(False)})
    over = Window.partitionBy(*keys, "__span").orderBy("__pos").rowsBetween(1 - rows, 0)
    n = F.count(F.lit(1)).over(over)
    found = {name: F.when(n >= least, c.over(over)) for name, (c, least) in columns.items()}
    return placed.union(tail).withColumns(found).where("__own").drop("__pos", "__span", "__own")
