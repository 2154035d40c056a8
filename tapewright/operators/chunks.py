"""Rows dealt to tasks by their number; long keys dealt out in chunks of their order, whose bounds come from the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.sources.scratch import written


#: Rows of a task that sorts them several times.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, keys: list[str], target: int = TASK_ROWS) -> DataFrame:
    """rows by hash of the keys, in tasks of about `target` rows; rows of one key stay together. Up to `target` rows are left to Spark.

    Spark puts shuffled rows together by their compressed bytes, of which 64 MB are millions of narrow rows and more than a GB
    where several windows sort them. The rows are counted first, so they should be a written table or come from one without a shuffle.
    """
    n = rows.count()
    return rows.repartition(-(-n // target), *keys) if n > target else rows


def bounds(rows: DataFrame, by: list[str], order: str, target: int, chunks: int = 64) -> DataFrame:
    """(by, bounds): for each key with more than `target` rows, up to chunks - 1 quantiles of its order, of a sketch that partial aggregates merge.

    Other keys have no row here and one chunk. Written, as its sketch isn't to be drawn twice.
    """
    shares = [i / chunks for i in range(1, chunks)]
    sketch = rows.where(F.col(order).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(number_of(rows, order), shares, 10_000).alias("_all"))
    step = F.greatest(F.lit(1), F.floor(F.lit(chunks) * target / F.col("_n"))).cast("int")  # every so many quantiles suffice
    few = F.filter("_all", lambda x, i: (i + 1) % F.col("_step") == 0)
    return written(sketch.where(F.col("_n") > target).withColumn("_step", step).select(*by, F.array_distinct(few).alias("bounds")), "bounds")


def number_of(rows: DataFrame, order: str) -> Column:
    """The order column as a number in the same order."""
    kind = dict(rows.dtypes)[order]
    c = F.col(order)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return (F.unix_micros(c.cast("timestamp"))).cast("double")
    return c.cast("double")


def chunked(rows: DataFrame, by: list[str], order: str, limits: DataFrame, name: str = "_chunk") -> DataFrame:
    """rows with the number of their chunk, from 0 in order: rows of one chunk lie between two bounds of their key. A null order is in chunk 0."""
    at = number_of(rows, order)
    there = rows.join(limits.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col("bounds").alias("_bounds")), [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], "left")
    number = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= at)), F.lit(0))
    return there.withColumn(name, F.when(F.col("_bounds").isNull() | F.col(order).isNull(), 0).otherwise(number)).drop("_bounds", *[f"_of_{b}" for b in by])
