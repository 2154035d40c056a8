"""Rolling decayed ridge regressions of excess returns on factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import simple_return
from tapewright.operators.metrics import order_statistic
from tapewright.sources.scratch import written

FACTOR_NAMES = ["mkt_rf", "smb", "hml", "wml"]


def excess_returns(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """(sym, date, exret, factors): daily returns over all of a symbol's rows, less the riskless rate, on dates with factors."""
    ret = simple_return("close", F.lag("close").over(Window.partitionBy("sym").orderBy("date")))
    rows = daily.select("sym", "date", ret.alias("ret")).where("ret IS NOT NULL")
    return rows.join(factors.select("date", *FACTOR_NAMES, "rf"), "date").select("sym", "date", (F.col("ret") - F.col("rf")).alias("exret"), *FACTOR_NAMES)


def window_sums(terms: np.ndarray, window: int, half_life: float) -> np.ndarray:
    """Decayed sums of the last `window` rows at every row (fewer at the start); a row's weight halves every half_life rows.

    Rows are cut into blocks as long as the window, so that a window is the end of one block and the beginning of the next.
    Beginnings and ends of all blocks are summed up together, a place at a time. Nothing is ever subtracted: a missing or huge
    value counts in the windows that hold it and leaves no trace in others.
    """
    n, k = terms.shape
    blocks = -(-n // window) if n else 0
    padded = np.zeros((blocks, window, k))
    padded.reshape(-1, k)[:n] = terms
    keep = 0.5 ** (1 / half_life)
    begins, ends = np.empty_like(padded), np.empty_like(padded)
    so_far, rest = np.zeros((blocks, k)), np.zeros((blocks, k))
    for i in range(window):
        so_far = so_far * keep + padded[:, i]
        begins[:, i] = so_far
        rest = rest + padded[:, window - 1 - i] * keep**i
        ends[:, window - 1 - i] = rest
    out = begins.reshape(-1, k)[:n].copy()
    at = np.arange(n)
    inside = (at % window != window - 1) & (at >= window)  # windows that reach back into the block before
    weight = keep ** (at[inside] % window + 1.0)
    out[inside] += ends.reshape(-1, k)[at[inside] - window + 1] * weight[:, None]
    return out


def fit_windows(x: np.ndarray, y: np.ndarray, window: int, min_obs: int, half_life: float, ridge: float) -> np.ndarray:
    """Rows (coefficients..., r2, nobs) of every window end from the min_obs-th row on; weights halve every half_life rows.

    A window that holds a missing value has no fit (NaN).
    """
    n, k = x.shape
    if n < min_obs:
        return np.zeros((0, k + 2))
    i, j = np.triu_indices(k + 1)
    z = np.column_stack([x, y])
    sums = window_sums(np.column_stack([z[:, i] * z[:, j], y, np.ones(n)]), window, half_life)[min_obs - 1 :]
    m = np.empty((len(sums), k + 1, k + 1))
    m[:, i, j] = m[:, j, i] = sums[:, : len(i)]
    swy, sw = sums[:, -2], sums[:, -1]
    xx, xy, yy = m[:, :k, :k], m[:, :k, k], m[:, k, k]
    with np.errstate(invalid="ignore", over="ignore"):
        beta = np.linalg.solve(xx + ridge * np.eye(k), xy[..., None])[..., 0]
        sse = yy - 2 * (beta * xy).sum(1) + np.einsum("bi,bij,bj->b", beta, xx, beta)
        sst = yy - swy * swy / sw
        r2 = np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), np.where(np.isnan(sst), np.nan, 0.0))
    return np.column_stack([beta, r2, np.minimum(np.arange(min_obs - 1, n) + 1, window)])


def rolling_betas(daily: DataFrame, factors: DataFrame, window: int = 250, min_obs: int = 120, half_life: float = 60.0, ridge: float = 1e-4, chunk: int = 5000) -> DataFrame:
    """(date, sym, alpha, mkt, smb, hml, wml, r2, nobs): one regression for each symbol and day from its min_obs-th on.

    A missing return or factor spoils the windows that hold it (NaN) and no other. A long history is fitted in chunks of `chunk` rows, each with the window - 1 rows before it, so that few symbols still
    make many tasks and a group stays small.
    """
    rows = excess_returns(daily, factors).withColumn("nth", F.row_number().over(Window.partitionBy("sym").orderBy("date")) - 1)
    own = F.floor(F.col("nth") / chunk)
    ahead = F.floor((F.col("nth") + (window - 1)) / chunk)  # the last chunk that looks back to the row
    dealt = rows.withColumn("chunk", F.explode(F.sequence(own, ahead)))

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("nth")
        x = np.column_stack([np.ones(len(frame)), frame[FACTOR_NAMES].to_numpy(np.float64)])
        nth = frame["nth"].to_numpy()
        first = int(nth[0])
        need = max(min_obs - first, 1)
        got = fit_windows(x, frame["exret"].to_numpy(np.float64), window, need, half_life, ridge)
        ends = frame.iloc[need - 1 :] if len(frame) >= need else frame.iloc[:0]
        out = pd.DataFrame(got, columns=["alpha", "mkt", "smb", "hml", "wml", "r2", "nobs"])
        out.insert(0, "sym", ends["sym"].to_numpy())
        out.insert(0, "date", ends["date"].to_numpy())
        keep = (ends["nth"].to_numpy() // chunk) == key[1]
        return out[keep].astype({"nobs": "int64"})

    return dealt.groupBy("sym", "chunk").applyInPandas(fit, "date date, sym string, alpha double, mkt double, smb double, hml double, wml double, r2 double, nobs long")


def median_fit(betas: DataFrame) -> DataFrame:
    """(median_r2, n_fits): the exact median, the mean of the middle two if their number is even. Windows without a fit don't count; null of none."""
    fits = written(betas.select("r2"), "fits").where("r2 IS NOT NULL AND NOT isnan(r2)")
    n = fits.count()
    middle = order_statistic(fits, "r2", sorted({(n - 1) // 2, n // 2})) if n else []
    return betas.sparkSession.createDataFrame([(sum(middle) / len(middle) if middle else None, n)], "median_r2 double, n_fits long")
