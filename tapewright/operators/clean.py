"""Cleaning of minute bars, its report, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.calendar import minute_of_day, to_new_york

#: Regular session, first and last minute of day.
SESSION = (570, 959)


def in_session(bars: DataFrame, session: tuple[int, int] = SESSION, time: str = "time") -> DataFrame:
    return bars.where(minute_of_day(time).between(*session))


def first_of_each(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with equal keys the first by `order` (an explicit column: row order isn't otherwise defined)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def bad_high_low() -> F.Column:
    """High below low, where a missing high counts as below any low."""
    return F.coalesce(F.col("high") < F.col("low"), F.lit(False)) | (F.col("high").isNull() & F.col("low").isNotNull())


def flagged(raw: DataFrame, session: tuple[int, int] | None = SESSION, tz: str | None = None, utc: bool = False) -> DataFrame:
    """Raw bars with New York time, date, month, and the flags `inside` (session) and `again` (duplicate of sym and time).

    session None keeps the whole day; utc leaves times as they are. One shuffle, by symbol and date.
    """
    time = F.col("ts").cast("timestamp_ntz") if utc else to_new_york("ts", tz)
    rows = raw.withColumn("time", time).withColumn("date", F.to_date("time")).withColumn("month", F.date_format("time", "yyyy-MM"))
    inside = F.col("time").isNotNull() if session is None else F.coalesce(minute_of_day("time").between(*session), F.lit(False))
    rows = rows.withColumn("inside", inside)
    w = Window.partitionBy("sym", "date", "time", "inside").orderBy("seq")
    return rows.repartition("sym", "date").withColumn("again", F.col("inside") & (F.row_number().over(w) > 1))


def kept(rows: DataFrame) -> DataFrame:
    """The bars among flagged rows: those of the session, one for each symbol and minute (the first in input order)."""
    return rows.where("inside AND NOT again").select("sym", "time", "open", "high", "low", "close", "volume", "ntrades", "vwap", "date")


def report(rows: DataFrame) -> DataFrame:
    """A row for each month of flagged rows: rows read, dropped outside the session, dropped as duplicates, kept with high below low, days and rows written."""
    stays = F.col("inside") & ~F.col("again")
    return rows.groupBy("month").agg(
        F.count("*").alias("raw"),
        F.count_if(~F.col("inside")).alias("dropped_outside"),
        F.count_if("again").alias("dropped_dupes"),
        F.count_if(stays & bad_high_low()).alias("bad_high_low"),
        F.count_if(stays).alias("written"),
        F.countDistinct(F.when(stays, F.col("date"))).alias("days_written"),
    )


def clean_bars(raw: DataFrame, session: tuple[int, int] | None = SESSION, tz: str | None = None, utc: bool = False) -> DataFrame:
    """Bars of the session in New York time, one for each symbol and minute."""
    return kept(flagged(raw, session, tz, utc))


def clean_report(raw: DataFrame, session: tuple[int, int] | None = SESSION, tz: str | None = None, utc: bool = False) -> DataFrame:
    return report(flagged(raw, session, tz, utc))


def conserved(report: DataFrame) -> DataFrame:
    """Months whose rows add up: read - outside - duplicates = written."""
    return report.select("month", (F.col("raw") - F.col("dropped_outside") - F.col("dropped_dupes") == F.col("written")).alias("conserved"))


def weekend_audit(bars: DataFrame) -> DataFrame:
    day = F.dayofweek("date")
    return bars.agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_days"), F.count_if(day.isin(1, 7)).alias("weekend_rows"))


def duplicate_audit(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return bars.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_months(universe: DataFrame, present: DataFrame, first: str, last: str) -> DataFrame:
    """Symbol-months that are expected from `first` to `last` (yyyy-MM) but not present."""
    months = F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("INTERVAL 1 MONTH"))
    grid = universe.select("sym").distinct().select("sym", F.explode(months).alias("m")).select("sym", F.date_format("m", "yyyy-MM").alias("month"))
    return grid.join(present.select("sym", "month").distinct(), ["sym", "month"], "left_anti")


def with_proxy(universe: DataFrame, proxy: str) -> DataFrame:
    """The universe's symbols, the market proxy among them."""
    return universe.select("sym").union(universe.sparkSession.createDataFrame([(proxy,)], "sym string")).distinct()
