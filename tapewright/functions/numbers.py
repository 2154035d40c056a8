"""Null-safe arithmetic of the panel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float, high: float) -> Column:
    """Held between two bounds; null stays null."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def simple_return(now: Column | str, before: Column | str) -> Column:
    """now / before - 1, null where `before` is null or zero."""
    return F.try_divide(_col(now), _col(before)) - 1


def scaled_move(x: Column | str, volatility: Column | str, most: float = 8.0, floor: float = 1e-8) -> Column:
    return clip(_col(x) / (_col(volatility) + floor), -most, most)


def decay(age: Column | str, half_life: float) -> Column:
    return F.pow(F.lit(0.5), _col(age) / F.lit(float(half_life)))


def net_return(slip: float | Column = 0.0, book: float = 1_000_000.0) -> Column:
    """(gross - fees - traded * slip) / book of a day result."""
    slip = F.lit(slip) if isinstance(slip, int | float) else slip
    return (F.col("gross") - F.col("fees") - F.col("traded") * slip) / F.lit(book)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of the pairs where both are there; null for a constant series."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def feed_symbol(sym: Column | str) -> Column:
    """A ticker as the daily feed writes it: `.` becomes `-`."""
    return F.replace(_col(sym), F.lit("."), F.lit("-"))
