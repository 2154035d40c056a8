"""Coverage of the panel and summaries of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.numbers import correlation, simple_return
from tapewright.operators.resample import daily_roll_up


def coverage_by_month(bars: DataFrame) -> DataFrame:
    """(sym, month, n): rows, counted by day first as stores keep them, then by month."""
    return bars.groupBy("sym", "date").agg(F.count("*").alias("n")).groupBy("sym", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"))


def coverage_matrix(bars: DataFrame, months: list[str]) -> DataFrame:
    """A row for each symbol with a column for each given month; null where there are no rows."""
    return coverage_by_month(bars).groupBy("sym").pivot("month", months).sum("n")


def summary(rows: DataFrame, date: str = "date", sym: str = "sym") -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(sym).alias("n_symbols"))


def last_close(bars: DataFrame, sym: str) -> DataFrame:
    """(sym, close) of a symbol's last bar on the panel's last date, in one pass of partial aggregates."""
    own = bars.where(F.col("sym") == sym).groupBy("sym", "date").agg(F.max_by("close", "time").alias("close"))
    return own.join(bars.agg(F.max("date").alias("date")), "date").select("sym", "close")


def proxy_against_market(daily: DataFrame, factors: DataFrame, proxy: str) -> DataFrame:
    """(n, corr) of the proxy's daily return with the market factor plus the riskless rate."""
    from pyspark.sql import Window

    ret = simple_return("close", F.lag("close").over(Window.partitionBy("sym").orderBy("date")))
    own = daily.where(F.col("sym") == proxy).select("sym", "date", ret.alias("ret")).where("ret IS NOT NULL")
    both = own.join(factors.select("date", (F.col("mkt_rf") + F.col("rf")).alias("market")), "date")
    return both.agg(F.count("*").alias("n"), correlation("ret", "market").alias("corr"))


def intraday_against_daily(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """(sym, n, corr) of closes rolled up from bars with the daily source's."""
    up = daily_roll_up(bars).select("sym", "date", F.col("close").alias("intraday"))
    return up.join(daily.select("sym", "date", "close"), ["sym", "date"]).groupBy("sym").agg(F.count("*").alias("n"), correlation("intraday", "close").alias("corr"))
