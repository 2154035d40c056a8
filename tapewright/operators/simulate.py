"""Simulation of a daily long/short book over a panel of predictions.

Days are independent (the book starts and ends flat), so a day is a group and all configurations run inside it on one copy of
its panel, held as dense bucket x symbol matrices. Nothing crosses days, and a group is as large as a day.

Where rules leave room: ties in predictions go by symbol; an order whose next bar is missing is lost; a name without a bar
keeps its last mark; shares left at the end of a day keep theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "config string, date date, gross double, fees double, traded double, sold double, trades int"


@dataclass(frozen=True)
class BookConfig:
    name: str = "base"
    n_enter: int = 10
    n_exit: int = 25
    rebalance_every: int = 2
    paper_fill: bool = False
    notional: float = 50_000.0
    # Fees on sales (a rate on money, a rate a share and its most for an order).
    sec_rate: float = 27.80e-6
    taf_rate: float = 0.000166
    taf_most: float = 8.30
    scale_least: float = 0.5
    scale_most: float = 2.0
    min_buckets: int = 10


def _dense(day: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Presence and values by bucket and symbol, both in order; of repeated rows the least counts."""
    day = day.sort_values(["bkt", "sym", "open", "close", "pred", "beta"]).drop_duplicates(["bkt", "sym"])
    buckets, b = np.unique(day["bkt"].to_numpy(), return_inverse=True)
    symbols, s = np.unique(day["sym"].to_numpy(dtype=str), return_inverse=True)
    there = np.zeros((len(buckets), len(symbols)), bool)
    there[b, s] = True
    values = {}
    for name in ("open", "close", "pred", "beta"):
        values[name] = np.full(there.shape, np.nan)
        values[name][b, s] = day[name].to_numpy(dtype=np.float64, na_value=np.nan)
    return there, values


def simulate_day(there: np.ndarray, panel: dict[str, np.ndarray], config: BookConfig) -> tuple[float, float, float, float, int]:
    """(gross, fees, traded, sold, trades) of one day."""
    n_buckets, n_symbols = there.shape
    rankable = there & ~np.isnan(panel["pred"]) & ~np.isnan(panel["beta"]) & (np.nan_to_num(panel["close"], nan=0.0) > 0)
    shares, mark = np.zeros(n_symbols), np.zeros(n_symbols)
    wanted, quoted = np.full(n_symbols, np.nan), np.zeros(n_symbols)  # orders for the next bucket and the price they were decided at
    gross = fees = traded = sold = 0.0
    trades = 0
    for t in range(n_buckets):
        opens, closes = panel["open"][t], panel["close"][t]
        filled = ~np.isnan(wanted) & there[t] & ~np.isnan(opens)
        if filled.any():
            price = np.where(filled, quoted if config.paper_fill else opens, 0.0)
            moved = filled & (shares != 0) & (mark > 0)
            gross += float((shares * (price - mark))[moved].sum())
            change = np.where(filled, wanted - shares, 0.0)
            money = np.abs(change) * price
            sale = change < 0
            traded += float(money.sum())
            trades += int((change != 0).sum())
            sold += float(money[sale].sum())
            fees += float((money[sale] * config.sec_rate + np.minimum(np.abs(change[sale]) * config.taf_rate, config.taf_most)).sum())
            shares = np.where(filled, wanted, shares)
            mark = np.where(filled, price, mark)
        wanted[:] = np.nan
        open_ = (shares != 0) & there[t] & ~np.isnan(closes)
        gross += float((shares * (np.where(open_, closes, 0.0) - mark))[open_].sum())
        mark = np.where(open_, closes, mark)
        if t == n_buckets - 2:  # all positions are closed in the last bucket
            wanted, quoted = np.where(shares != 0, 0.0, np.nan), mark.copy()
            continue
        ok = rankable[t]
        n = int(ok.sum())
        if t % config.rebalance_every or t == n_buckets - 1 or n < 4 * config.n_enter:
            continue
        names = np.flatnonzero(ok)
        names = names[np.argsort(-panel["pred"][t, names], kind="stable")]
        place = np.full(n_symbols, n_symbols + n)
        place[names] = np.arange(n)
        stays_long = (shares > 0) & ok & (place < config.n_exit)
        stays_short = (shares < 0) & ok & (place >= n - config.n_exit)
        side = stays_long.astype(float) - stays_short.astype(float)
        leaves = (shares != 0) & (side == 0)
        side[names[: config.n_enter]] = 1.0
        side[names[n - config.n_enter :]] = -1.0
        beta = np.nan_to_num(panel["beta"][t])
        short_beta = beta[side < 0].sum()
        scale = float(np.clip(beta[side > 0].sum() / short_beta if short_beta != 0 else 1.0, config.scale_least, config.scale_most))
        size = config.notional * np.where(side < 0, scale, 1.0)
        target = side * np.floor(np.divide(size, closes, out=np.zeros(n_symbols), where=side != 0))
        placed = (side != 0) & (target != shares)
        wanted = np.where(placed, target, np.where(leaves, 0.0, np.nan))
        quoted = np.where(placed, closes, mark)
    return gross, fees, traded, sold, trades


def simulate(panel: DataFrame, configs: list[BookConfig]) -> DataFrame:
    """A row for each date and configuration, days with too few buckets left out. panel: see asof.simulation_panel."""

    def run(key: tuple, day: pd.DataFrame) -> pd.DataFrame:
        there, values = _dense(day)
        rows = [(c.name, key[0], *simulate_day(there, values, c)) for c in configs if len(there) >= c.min_buckets]
        return pd.DataFrame(rows, columns=["config", "date", "gross", "fees", "traded", "sold", "trades"]).astype({"trades": "int32"})

    return panel.select("date", "sym", "bkt", "open", "close", "pred", "beta").groupBy("date").applyInPandas(run, RESULT)


def tradable_days(panel: DataFrame, least: int = 10) -> DataFrame:
    """(date, n_buckets) of days with enough distinct buckets."""
    return panel.groupBy("date").agg(F.countDistinct("bkt").alias("n_buckets")).where(F.col("n_buckets") >= least)


def extremes(preds: DataFrame, n: int) -> DataFrame:
    """Rows of preds with their place from the top and from the bottom of their (date, bkt), and whether they are among the n first or last. Ties go by symbol."""
    w = Window.partitionBy("date", "bkt")
    high = F.row_number().over(w.orderBy(F.col("pred").desc(), F.col("sym")))
    low = F.row_number().over(w.orderBy(F.col("pred").asc(), F.col("sym").desc()))
    return preds.withColumn("from_top", high).withColumn("from_bottom", low).withColumn("is_top", F.col("from_top") <= n).withColumn("is_bottom", F.col("from_bottom") <= n)
