"""As-of joins: the newest right row at or before each left row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.chunks import bounds, chunked


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], chunk: str | int | None = None) -> DataFrame:
    """left with `values` of the right row with equal `by` and the greatest right_ts <= left_ts; null where there is none.

    A right row counts even if its values are null. Right times should be unique within `by`; of equal ones any is taken.
    Both sides go through one shuffle by `by` and one ordered window, which nothing but the newest row crosses. With few
    keys, `chunk` deals a key's time out in chunks: the last right row before a chunk is carried into it from a table of one
    row for each key and chunk. It is a unit of date_trunc, such as 'MONTH', or about how many rows a chunk may have: keys with
    more are then divided at quantiles of their own times, however they crowd, and others stay whole.
    """
    held = F.struct(*[F.col(v) for v in values])
    l = left.select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_left"))  # noqa: E741
    r = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), held.alias("_right")).where("_t IS NOT NULL")
    keys = list(by)
    if chunk:
        if isinstance(chunk, int):
            limits = bounds(l.select(*by, "_t").unionByName(r.select(*by, "_t")), by, "_t", chunk)
            l, r = chunked(l, by, "_t", limits), chunked(r, by, "_t", limits)  # noqa: E741
        else:
            of = F.date_trunc(chunk, F.col("_t").cast("timestamp"))
            l, r = l.withColumn("_chunk", of), r.withColumn("_chunk", of)  # noqa: E741
        last = r.groupBy(*by, "_chunk").agg(F.max_by("_right", "_t").alias("_last"))
        chunks = last.select(*by, "_chunk").unionByName(l.select(*by, "_chunk")).distinct().join(last, [*by, "_chunk"], "left")
        w = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = chunks.withColumn("_right", F.last("_last", ignorenulls=True).over(w)).where("_right IS NOT NULL")
        r = r.unionByName(carried.select(*by, F.lit(None).cast(r.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"), "_right", "_chunk"))
        keys.append("_chunk")
    w = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    out = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    # a left row without a time matches nothing
    return out.select("_left.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_found.{v}")).alias(v) for v in values])


def prior_betas(days: DataFrame, betas: DataFrame, values: list[str]) -> DataFrame:
    """(sym, date, *values): for each distinct symbol and date the newest estimate of a strictly earlier date.

    It runs on distinct days rather than bars; bars then meet it by an equi-join.
    """
    stamped = betas.select("sym", F.date_add("date", 1).alias("_stamp"), *values)
    return asof_join(days.select("sym", "date").distinct(), stamped, ["sym"], "date", "_stamp", values)


def betas_of_last_date(dates: DataFrame, betas: DataFrame) -> DataFrame:
    """(date, sym, beta, beta_date): for each date the estimates of the one newest earlier date over all symbols; a symbol without a row then has none."""
    stamps = betas.select(F.col("date").alias("beta_date")).distinct().select("beta_date", F.date_add("beta_date", 1).alias("_stamp"), F.lit(0).alias("_all"))
    at = asof_join(dates.select("date").distinct().withColumn("_all", F.lit(0)), stamps, ["_all"], "date", "_stamp", ["beta_date"])
    return at.drop("_all").join(betas.select(F.col("date").alias("beta_date"), "sym", F.col("mkt").alias("beta")), "beta_date")


def simulation_panel(bars: DataFrame, preds: DataFrame, betas: DataFrame, proxy: str) -> DataFrame:
    """(date, sym, bkt, open, close, pred, beta): bars of dates with predictions, without the proxy."""
    from tapewright.functions.calendar import minute_of_day

    dates = preds.select("date").distinct()
    rows = bars.where(F.col("sym") != proxy).select("date", "sym", minute_of_day("time").alias("bkt"), "open", "close").join(dates, "date", "left_semi")
    return rows.join(preds.select("date", "sym", "bkt", "pred"), ["date", "sym", "bkt"], "left").join(betas_of_last_date(dates, betas).select("date", "sym", "beta"), ["date", "sym"], "left")
