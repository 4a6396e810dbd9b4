"""Column expressions that behave alike whatever the data: guarded ratios, windows, rounding."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ANNUAL = 252


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def by(*keys: str, order: str = "bar"):
    return Window.partitionBy(*keys).orderBy(order)


def rolling(window, rows: int):
    return window.rowsBetween(1 - rows, 0)


def full(value: Column, over, rows: int) -> Column:
    """value over the window, null until it holds `rows` values."""
    return F.when(F.count(F.lit(1)).over(over) >= rows, value)


def clip(x: Column, low, high) -> Column:
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def rounded(digits: int, **columns: Column) -> list[Column]:
    return [F.round(c, digits).alias(name) for name, c in columns.items()]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def slope(x: Column, y: Column) -> Column:
    """Aggregate: the regression of y on x; null without spread of x."""
    n = F.count(F.lit(1))
    spread = F.sum(x * x) - F.sum(x) * F.sum(x) / n
    return F.when(spread > 1e-20, (F.sum(x * y) - F.sum(x) * F.sum(y) / n) / spread)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation of x and y by centred moments; null without spread of either."""
    sx, sy = F.var_pop(x), F.var_pop(y)
    return F.when((sx > 1e-24) & (sy > 1e-24), F.covar_pop(x, y) / F.sqrt(sx * sy))


def compounded(r: Column, over=None) -> Column:
    """The product of 1 + r, over a window or as an aggregate; also where returns are below -1."""
    g = 1 + r
    parts = F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)), F.sum(F.when(g < 0, 1).otherwise(0)), F.max(F.when(g == 0, 1).otherwise(0))
    size, negative, zero = (p.over(over) for p in parts) if over is not None else parts
    return F.when(zero == 1, 0.0).when(negative % 2 == 1, -F.exp(size)).otherwise(F.exp(size))
