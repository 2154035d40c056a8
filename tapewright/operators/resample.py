"""Coarser bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.calendar import bucket


def resample(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """Bars of so many minutes: first open, highest high, lowest low, last close, sums, and the volume-weighted vwap.

    All aggregates are partial: one shuffle of about one row for each symbol, bucket and input partition. First and last are
    by time and may be null; a volume without vwap has no weight; sums of nothing are 0; without weight the vwap is null.
    """
    weight = F.when(F.col("vwap").isNotNull(), F.col("volume"))
    rows = bars.select("*", bucket("time", minutes).alias("bucket"))
    out = rows.groupBy("sym", "bucket").agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"), F.coalesce(F.sum("ntrades"), F.lit(0)).alias("ntrades"),
        F.try_divide(F.sum(F.col("volume") * F.col("vwap")), F.sum(weight)).alias("vwap"),
    )
    return out.withColumnRenamed("bucket", "time").withColumn("date", F.to_date("time"))


def daily_roll_up(bars: DataFrame) -> DataFrame:
    """One row for each symbol and date: first open, last close, range, volume."""
    return bars.groupBy("sym", "date").agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"))
