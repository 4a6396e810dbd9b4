"""Sums of products of all lagged series, by tiles, and sparse regressions from them.

The panel is packed into tiles of bars and series. Two tiles of the same bars give the products of
their columns; those of all bars are added up per pair of series blocks, in groups of bars that
tasks sum one after the other, a tile at a time. So a task holds two tiles and their product,
never the panel. A regression needs the products only: with the constant among the columns, they
give centred sums, and the lasso's path and its criterion follow.

Each block of targets gets the rows of the products' table that its targets' screened columns name
(all columns, up to SCREEN). A row has all columns, so a task checks on its own that no column left
out breaks the lasso's conditions at the knots up to the chosen one; targets for which one does are
solved again with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.numeric import lasso_gram, lasso_ic_gram
from panelflow.functions.prefix import ordinals
from panelflow.sources import store

#: Bars and series of a tile, tiles of bars that a task adds up, and columns of a target's first screen.
TILE_BARS, TILE_SERIES, TILES, SCREEN = 4096, 128, 64, 2048
ONE = "1"


def column_name(lag: int, series: str) -> str:
    return f"{lag}:{series}"


def _tiles(returns: DataFrame, lags: int, folder: str) -> DataFrame:
    """(part, side, series, x): each tile's series in order and its values, a row for each bar after `lags` bars before it; written."""
    names = ordinals(returns.select("series").distinct().withColumn("h", F.xxhash64("series")), "h").select("series", F.floor(F.col("number") / TILE_SERIES).alias("side"))
    bars = ordinals(returns.select("bar").distinct(), "bar", name="pos")
    rows = returns.join(bars, "bar").join(names, "series").select("series", "side", "pos", F.col("ret").cast("double").alias("ret"))
    home = rows.withColumn("part", F.floor(F.col("pos") / TILE_BARS))
    last = rows.where(F.col("pos") % TILE_BARS >= TILE_BARS - lags).withColumn("part", F.floor(F.col("pos") / TILE_BARS) + 1)

    def pack(table: pa.Table) -> pa.Table:
        wide = table.select(["pos", "series", "ret"]).to_pandas().pivot(index="pos", columns="series", values="ret").sort_index().sort_index(axis=1)
        part = table.column("part")[0].as_py()
        # bars of the tile itself; a tile that has none but those before it is none
        own = int((wide.index >= part * TILE_BARS).sum())
        blob = pa.array([np.ascontiguousarray(wide.to_numpy(float)).tobytes()] if own else [], pa.binary())
        n = len(blob)
        return pa.table([pa.array([part] * n, pa.int64()), pa.array([table.column("side")[0].as_py()] * n, pa.int64()), pa.array([list(wide.columns)] * n, pa.list_(pa.string())), blob], names=["part", "side", "series", "x"])

    tiles = home.union(last).groupBy("part", "side").applyInArrow(pack, "part long, side long, series array<string>, x binary")
    return store.kept(tiles, folder, "tiles")


def _design(series: list[str], x: bytes, part: int, lags: int, constant: bool) -> tuple[list[str], np.ndarray]:
    """A tile's columns: the constant (of the first block of series only), lags 0 to `lags`, of the bars that have them all."""
    x = np.frombuffer(x).reshape(-1, len(series))
    n = len(x) - lags
    parts = [x[lags - k : len(x) - k] for k in range(lags + 1)]
    names = [column_name(k, s) for k in range(lags + 1) for s in series]
    return ([ONE] if constant else []) + names, np.column_stack([np.ones((n, 1 if constant else 0)), *parts]) if n > 0 else np.zeros((0, len(names) + constant))


def gram(returns: DataFrame, lags: int) -> DataFrame:
    """(a, bs, vs): for each column (the constant "1", "0:name" for a series, "k:name" for its lag k) its products with all, in name order.

    returns must have a row for each series and bar.
    """
    folder, spark = store.scratch(returns.sparkSession), returns.sparkSession
    tiles = _tiles(returns, lags, folder)
    left = tiles.select("part", F.col("side").alias("i"), F.col("series").alias("si"), F.col("x").alias("xi"))
    right = tiles.select("part", F.col("side").alias("j"), F.col("series").alias("sj"), F.col("x").alias("xj"))
    both = left.join(right.toDF(*right.columns), "part").where("i <= j").withColumn("lot", F.floor(F.col("part") / TILES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, names = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["i"], r["j"], r["lot"])
                a, x = _design(r["si"], r["xi"], r["part"], lags, r["i"] == 0)
                b, y = _design(r["sj"], r["xj"], r["part"], lags, r["j"] == 0)
                if key != at:
                    if at is not None:
                        yield done(at, total, names)
                    at, total, names = key, np.zeros((len(a), len(b))), (a, b)
                total += x.T @ y
        if at is not None:
            yield done(at, total, names)

    def done(at: tuple, total: np.ndarray, names: tuple[list[str], list[str]]) -> pa.RecordBatch:
        a, b = names
        rows = [(x, y, v) for x, v in zip(a, total, strict=True) for y, v in [(b, v)]]
        if at[0] != at[1]:
            rows += [(y, a, v) for y, v in zip(b, total.T, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([[at[0], at[1]]] * len(rows), pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))], names=["a", "tile", "bs", "vs"])

    parts = both.repartition(tasks, "i", "j", "lot").sortWithinPartitions("i", "j", "lot", "part").mapInArrow(add, "a string, tile array<bigint>, bs array<string>, vs array<double>")
    cells = parts.select("a", F.explode(F.arrays_zip("bs", "vs")).alias("c")).groupBy("a", F.col("c.bs").alias("b")).agg(F.sum("c.vs").alias("v"))
    rows = cells.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("r"))
    return store.kept(rows.select("a", F.col("r.b").alias("bs"), F.col("r.v").alias("vs")), folder, "gram")


def gram_cells(table: DataFrame) -> DataFrame:
    """(a, b, value) of gram()."""
    return table.select("a", F.explode(F.arrays_zip("bs", "vs")).alias("c")).select("a", F.col("c.bs").alias("b"), F.col("c.vs").alias("value"))


def sparse_regressions(table: DataFrame, lags: int, alpha: float | None = None, criterion: str = "bic") -> DataFrame:
    """(target, source, lag, coef, alpha, intercept) of each series on all lags, from gram()'s rows, which are written."""
    spark = table.sparkSession
    folder = store.scratch(spark)
    targets = table.where(F.col("a").startswith("0:")).select(F.col("a").alias("target"), "bs", "vs")
    blocks = max(1, min(2 * spark.sparkContext.defaultParallelism, targets.count()))
    targets = targets.withColumn("block", F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int"))
    found, wanted, turn = None, None, 0
    lagged = ~F.col("a").startswith("0:")
    # correlations with the target, the largest first; all columns where they are few
    own = targets.select("block", "target", F.arrays_zip("bs", "vs").alias("r"))
    columns = F.filter("r", lambda c: ~c["bs"].startswith("0:") & (c["bs"] != ONE))
    first = F.slice(F.array_sort(columns, lambda x, y: F.when(F.abs(x["vs"]) > F.abs(y["vs"]), -1).when(F.abs(x["vs"]) < F.abs(y["vs"]), 1).otherwise(0)), 1, SCREEN)
    wanted = store.kept(own.select("block", "target", F.transform(first, lambda c: c["bs"]).alias("columns")), folder, "wanted0")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(next(iter(pdf["bs"])))
        at = {n: i for i, n in enumerate(names)}
        rows = {a: np.asarray(v, float) for a, v in zip(pdf["a"], pdf["vs"], strict=True)}
        one = rows[ONE]
        n, out = one[at[ONE]], []
        every = np.array([i for i, x in enumerate(names) if x != ONE and not x.startswith("0:")])
        for target, held in pdf.loc[pdf["columns"].notna(), ["a", "columns"]].itertuples(index=False):
            picked = sorted(held, key=lambda x: at[x])
            keep = np.array([at[x] for x in picked])
            y = rows[target]
            centred = (np.stack([rows[x] for x in picked]) - np.outer(one[keep], one) / n)[:, every] if len(picked) else np.zeros((0, len(every)))
            place = {c: i for i, c in enumerate(every)}
            square, cross = centred[:, [place[c] for c in keep]], (y - one * y[at[ONE]] / n)
            yy = y[at[target]] - y[at[ONE]] ** 2 / n
            if alpha is not None:
                b, used, path = lasso_gram(square / n, cross[keep] / n, alpha), alpha, None
                path = [(alpha, b)]
            else:
                b, used, path = lasso_ic_gram(square, cross[keep], yy, int(n), criterion, whole=len(keep) == len(every))
            left: set[int] = set()
            for level, coef in path if len(keep) < len(every) else ():
                rest = np.abs(cross[every] - centred.T @ coef) / n
                left |= {int(c) for c in every[rest > level * (1 + 1e-9) + 1e-15]} - set(keep.tolist())
            level = y[at[ONE]] / n - (one[keep] / n) @ b
            coef = dict(zip(picked, b, strict=True))
            for x in (names[c] for c in every):
                lag, source = x.split(":", 1)
                out.append((target[2:], source, int(lag), float(coef.get(x, 0.0)), used, float(level), [names[c] for c in sorted(left)]))
        return pd.DataFrame(out, columns=["target", "source", "lag", "coef", "alpha", "intercept", "missing"])

    while True:
        needed = wanted.select("block", F.explode("columns").alias("a")).union(wanted.select("block", F.concat("target").alias("a"))).union(wanted.select("block", F.lit(ONE).alias("a"))).distinct()
        rows = needed.join(table, "a").join(wanted.withColumnRenamed("target", "a"), ["block", "a"], "left")
        new = store.kept(rows.repartition(blocks, "block").groupBy("block").applyInPandas(solve, "target string, source string, lag int, coef double, alpha double, intercept double, missing array<string>"), folder, f"solved{turn}")
        good = new.where(F.size("missing") == 0).drop("missing")
        found = good if found is None else found.union(good)
        more = new.where(F.size("missing") > 0).select(F.concat(F.lit("0:"), "target").alias("target"), "missing").distinct()
        if more.isEmpty():
            return found
        turn += 1
        wanted = store.kept(wanted.join(more, "target").select("block", "target", F.array_union("columns", "missing").alias("columns")), folder, f"wanted{turn}")
