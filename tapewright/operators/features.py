"""Trailing features and forward labels of a bar panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.calendar import minute_of_day
from tapewright.functions.numbers import simple_return
from tapewright.operators.asof import prior_betas


#: Rows of the proxy that are broadcast at most: some 24 bytes each; thirty years of minute bars.
MOST_PROXY = 3_000_000


@dataclass(frozen=True)
class FeatureConfig:
    """Row counts of windows are in bars; cutoffs are the last minute of day at which a label of so many bars stands."""

    proxy: str = "SPY"
    short: int = 6
    long: int = 12
    labels: dict[str, int] = field(default_factory=lambda: {"fwdres10": 2, "fwdres15": 3, "fwdres30": 6})
    cutoffs: dict[str, int] = field(default_factory=lambda: {"fwdres10": 945, "fwdres15": 940, "fwdres30": 925})
    baseline_days: int = 20
    require_full_window: bool = False


def in_day():
    """A symbol's bars of one day in order of time."""
    return Window.partitionBy("sym", "date").orderBy("time")


def bar_returns(bars: DataFrame) -> DataFrame:
    """ret5: return on the previous bar of the same symbol and day."""
    return bars.withColumn("ret5", simple_return("close", F.lag("close").over(in_day())))


def with_proxy_return(bars: DataFrame, proxy: str, counted: DataFrame | None = None, most: int = MOST_PROXY) -> DataFrame:
    """spyret: the proxy's ret5 of the same bucket; the proxy's own rows go.

    The proxy has a row a bucket, as many as the calendar has and no more for more symbols. Their number is counted (on
    `counted`, the bars as stored, where returns needn't be computed for that), and up to `most` they are broadcast, so bars
    keep their layout by symbol and day; beyond, both sides are shuffled by time.
    """
    own = bars.where(F.col("sym") == proxy).select("time", F.col("ret5").alias("spyret"))
    rows = (bars if counted is None else counted).where(F.col("sym") == proxy).limit(most + 1).count()
    own = F.broadcast(own) if rows <= most else own
    return bars.where(F.col("sym") != proxy).join(own, "time", "left")


def volume_baseline(bars: DataFrame, days: int = 20) -> DataFrame:
    """vbase: mean volume of the same symbol and bucket over the `days` earlier rows, without today's."""
    w = Window.partitionBy("sym", "bkt").orderBy("date").rowsBetween(-days, -1)
    return bars.select("sym", "date", minute_of_day("time").alias("bkt"), "volume").withColumn("vbase", F.avg("volume").over(w)).drop("volume")


def previous_close(daily: DataFrame) -> DataFrame:
    return daily.select("sym", "date", F.lag("close").over(Window.partitionBy("sym").orderBy("date")).alias("pclose"))


def trailing(rows: DataFrame, config: FeatureConfig) -> DataFrame:
    """cumres30, cumres60, rv60 and the forward sums from `resid`, a missing one being 0. Windows count rows of the day."""
    r0 = rows.withColumn("r0", F.coalesce("resid", F.lit(0.0)))
    back = lambda n: in_day().rowsBetween(1 - n, 0)
    minute = minute_of_day("time")
    labels = {}
    for name, k in config.labels.items():
        w = in_day().rowsBetween(1, k)
        ok = minute <= config.cutoffs[name]
        if config.require_full_window:
            ok = ok & (F.count("*").over(w) == k)
        labels[name] = F.when(ok, F.sum("r0").over(w))
    return r0.select(
        "*", F.sum("r0").over(back(config.short)).alias("cumres30"), F.sum("r0").over(back(config.long)).alias("cumres60"),
        F.sqrt(F.sum(F.col("r0") * F.col("r0")).over(back(config.long))).alias("rv60"), *[c.alias(n) for n, c in labels.items()],
    ).drop("r0")


def signal_table(bars: DataFrame, betas: DataFrame, daily: DataFrame, config: FeatureConfig | None = None) -> DataFrame:
    """The feature and label table: one row for each bar of every symbol but the proxy.

    Shuffles: by (sym, date) for all windows of the day, by (sym, bucket) for the volume baseline, and the joins back.
    Betas come from strictly earlier dates and the baseline leaves today out, so only the labels look forward.
    """
    config = config or FeatureConfig()
    bars = bars.select("sym", "date", "time", "open", "close", "volume")
    rows = with_proxy_return(bar_returns(bars), config.proxy, bars)
    rows = rows.join(prior_betas(rows, betas, ["mkt"]), ["sym", "date"], "left").withColumn("resid", F.col("ret5") - F.col("mkt") * F.col("spyret"))
    rows = trailing(rows, config)
    rows = rows.join(previous_close(daily), ["sym", "date"], "left")
    whole = in_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("gap", simple_return(F.first("open").over(whole), F.first("pclose").over(whole)))
    rows = rows.withColumn("bkt", minute_of_day("time")).join(volume_baseline(bars, config.baseline_days), ["sym", "date", "bkt"], "left")
    rows = rows.withColumn("vsurp", F.try_divide("volume", "vbase"))
    return rows.select("sym", "time", "ret5", "spyret", "resid", "cumres30", "cumres60", "rv60", "vsurp", "gap", *config.labels, "date")


def look_ahead_audit(days: DataFrame, betas: DataFrame) -> DataFrame:
    """How many symbol-days use an estimate that isn't of an earlier date: 0."""
    used = prior_betas(days, betas.withColumn("beta_date", F.col("date")), ["beta_date"])
    return used.agg(F.count("*").alias("n_days"), F.count_if(F.col("beta_date") >= F.col("date")).alias("look_ahead"), F.count("beta_date").alias("matched"))
