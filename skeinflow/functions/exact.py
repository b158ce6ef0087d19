"""Averages and deviations that don't depend on the order of summation.

Values are counted in whole units (cents, millionths), so sums are exact whatever partition or engine adds them, and each
result is one division or root of exact numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def units(value: Column, per_one: float) -> Column:
    """``value`` as a whole number of 1 / ``per_one``."""
    return F.round(value * F.lit(float(per_one))).cast("long")


def _over(column: Column, window: WindowSpec | None) -> Column:
    return column.over(window) if window is not None else column


def mean(whole: Column, per_one: float, window: WindowSpec | None = None) -> Column:
    """Mean of whole units, back in ones; null without values."""
    total, n = _over(F.sum(whole), window), _over(F.count(whole), window)
    return F.when(n > 0, total.cast("double") / n.cast("double") / F.lit(float(per_one)))


def _spread(whole: Column, window: WindowSpec | None) -> tuple[Column, Column]:
    wide = whole.cast("decimal(18,0)")
    n, total, squares = _over(F.count(whole), window), _over(F.sum(wide), window), _over(F.sum(wide * wide), window)
    return n, n.cast("decimal(10,0)") * squares.cast("decimal(28,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")


def sd_population(whole: Column, per_one: float, window: WindowSpec | None = None) -> Column:
    n, spread = _spread(whole, window)
    return F.when(n > 0, F.sqrt(spread.cast("double")) / n.cast("double") / F.lit(float(per_one)))


def sd_sample(whole: Column, per_one: float, window: WindowSpec | None = None) -> Column:
    """Null for fewer than two values."""
    n, spread = _spread(whole, window)
    pairs = n.cast("double") * (n - 1).cast("double")
    return F.when(n > 1, F.sqrt(spread.cast("double") / pairs) / F.lit(float(per_one)))
