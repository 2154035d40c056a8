"""Skill of predictions, autocorrelation of returns, and statistics of daily P&L."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import correlation
from tapewright.operators.chunks import TASK_ROWS, bounds, chunked, dealt
from tapewright.sources.scratch import written


def oos_r2(scored: DataFrame, by: list[str]) -> DataFrame:
    """1 - squared error over the label's variation about its own mean; null for a constant label."""
    e = F.col("y") - F.col("pred")
    return scored.groupBy(*by).agg(F.count("*").alias("n_test"), (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("y"))).alias("oos_r2"))


def average_rank(value: str, keys: list[str]) -> F.Column:
    """Rank from 1 within the keys, equal values sharing the mean of their places; null of null."""
    w = Window.partitionBy(*keys)
    place = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), place + (ties - 1) / 2)


def rank_ic(rows: DataFrame, pred: str, label: str, by: list[str], per: str = "day", target: int = TASK_ROWS) -> DataFrame:
    """(by, mean_ic, t_ic, n_days): skill of ranks.

    Ranks are taken within each (date, bkt). per="day" correlates a day's pooled ranks once; per="bucket" correlates each
    cross-section and averages over the day. Days without a correlation don't count. t is mean / (sd / sqrt(days)).
    Cross-sections are dealt to tasks of about `target` rows.
    """
    keys = [*by, "date", "bkt"]
    narrow = dealt(rows.select(*dict.fromkeys([*keys, pred, label])), keys, target)
    ranked = narrow.where(F.col(pred).isNotNull() & F.col(label).isNotNull()).withColumn("_p", average_rank(pred, keys)).withColumn("_y", average_rank(label, keys))
    daily = ranked.groupBy(*([*by, "date"] if per == "day" else keys)).agg(correlation("_p", "_y").alias("ic"))
    if per != "day":
        daily = daily.groupBy(*by, "date").agg(F.avg("ic").alias("ic"))
    n = F.count("ic")
    return daily.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic") * F.sqrt(n), F.stddev_samp("ic")).alias("t_ic"), n.alias("n_days"))


def lagged_correlation(rows: DataFrame, columns: list[str], lags: int = 12) -> DataFrame:
    """(lag, n, corr_<column>...): pooled correlation of each column with itself so many rows before in the day, where all are there. One window pass."""
    w = Window.partitionBy("sym", "date").orderBy("time")
    structs = [F.struct(F.lit(k).alias("lag"), *[F.col(c).alias(c) for c in columns], *[F.lag(c, k).over(w).alias(f"{c}_before") for c in columns]) for k in range(1, lags + 1)]
    wide = rows.select(F.array(*structs).alias("all"))
    long = wide.select(F.explode("all").alias("x")).select("x.*").dropna()
    return long.groupBy("lag").agg(F.count("*").alias("n"), *[correlation(c, f"{c}_before").alias(f"corr_{c}") for c in columns])


def pnl_scenarios(days: DataFrame, slips: DataFrame, book: float = 1_000_000.0) -> DataFrame:
    """(config, slip, n_days, total, mean, sharpe, traded): every day result under every slippage rate of a short list.

    Sums of moments by config first: a config's days are read once and meet the rates as one row. More than 10,000 rates are an error.
    """
    rates = slips.select("slip").distinct()
    if rates.limit(10_001).count() > 10_000:
        raise ValueError("too many slippage rates to broadcast")
    net = F.col("gross") - F.col("fees")
    m = days.groupBy("config").agg(F.count("*").alias("n_days"), F.avg(net).alias("a"), F.avg("traded").alias("b"), F.var_samp(net).alias("va"), F.var_samp("traded").alias("vb"), F.covar_samp(net, F.col("traded")).alias("cab"))
    s = F.col("slip")
    mean = F.col("a") - s * F.col("b")
    sd = F.sqrt(F.greatest(F.col("va") - 2 * s * F.col("cab") + s * s * F.col("vb"), F.lit(0.0)))
    return m.crossJoin(F.broadcast(rates)).select("config", "slip", "n_days", (mean * F.col("n_days")).alias("total"), mean.alias("mean"), F.try_divide(mean, sd).alias("ratio"), F.col("b").alias("traded")).withColumn("sharpe", F.col("ratio") * F.sqrt(F.lit(252.0))).drop("ratio")


def cumulative(days: DataFrame, value: str, by: list[str], target: int = 1_000_000) -> DataFrame:
    """(by, date, cumulative): running total of each series in order of date; a missing value adds nothing.

    A scan in two levels: series of more than `target` rows are cut into chunks at quantiles of their dates, chunks are summed,
    the sums before each chunk are its offset, and only rows of one chunk meet in a window.
    """
    limits = bounds(days, by, "date", target)
    rows = chunked(days.select(*by, "date", F.col(value).alias("_v")), by, "date", limits)
    sums = rows.groupBy(*by, "_chunk").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col("_chunk").alias("_of"), F.sum("_sum").over(before).alias("_before")).where("_before IS NOT NULL")
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    own = F.sum("_v").over(Window.partitionBy(*by, "_chunk").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    here = rows.withColumn("_own", own).join(offsets, [*same, F.col("_chunk") == F.col("_of")], "left")
    total = F.when(F.col("_own").isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return here.select(*by, "date", total.alias("cumulative"))


def order_statistic(rows: DataFrame, column: str, places: list[int], held: int = 10_000) -> list[float]:
    """The values at the given places (from 0) of a column in order; nulls and NaN don't count.

    By selection: a sketch gives two values near each place, exact counts below, at, between and above them say where the place
    is, and the search goes on among the values between them, until `held` at most are left and come to the driver. No task has
    more than a sketch and counts.
    """
    values = written(rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), "values")
    return [_at_place(values, place, held) for place in places]


def _at_place(values: DataFrame, place: int, held: int, accuracy: int = 10_000) -> float:
    n = values.count()
    if not 0 <= place < n:
        raise IndexError(f"place {place} of {n} values")
    v = F.col("v")
    while n > held:
        share, slack = place / n, 2 / accuracy
        low, high = values.agg(F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], accuracy)).first()[0]
        regions = [(v < low, values.where(v < low)), (v == low, None), ((v > low) & (v < high), values.where((v > low) & (v < high))), ((v == high) & (v > low), None), (v > high, values.where(v > high))]
        counts = values.agg(*[F.count_if(c).alias(f"n{i}") for i, (c, _) in enumerate(regions)]).first()
        for i, (_, part) in enumerate(regions):
            if place < counts[i]:
                break
            place -= counts[i]
        if part is None:
            return float(low if i == 1 else high)
        values, n = part, counts[i]
    return float(sorted(r[0] for r in values.collect())[place])


def head_to_head(results: DataFrame, metrics: list[str], by: str = "label") -> DataFrame:
    """(by, model, mean of each metric)."""
    return results.groupBy(by, "model").agg(*[F.avg(m).alias(m) for m in metrics])
