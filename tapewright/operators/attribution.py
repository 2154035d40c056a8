"""Attribution of a return series to factors, with standard errors that allow for autocorrelation.

All sums are Spark's: products for the normal equations, then, with the residuals, products of each day's scores with those of
the days before it, from lags in a window over the series. Only matrices of five by five, one row a series, are solved in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ["mkt_rf", "smb", "hml", "wml"]
SCHEMA = "series string, n long, alpha_annual double, alpha_t double, r2 double, " + ", ".join(f"b_{f} double" for f in NAMES) + ", " + ", ".join(f"t_{f} double" for f in NAMES)
_K = len(NAMES) + 1
_UPPER = [(i, j) for i in range(_K) for j in range(i, _K)]


def _square(upper) -> np.ndarray:
    out = np.zeros((_K, _K))
    for (i, j), v in zip(_UPPER, upper, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _solved(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        inverses = [np.linalg.pinv(_square(x), hermitian=True) for x in f["xx"]]
        yield pd.DataFrame({"series": f["series"], "beta": [i @ np.asarray(xy) for i, xy in zip(inverses, f["xy"], strict=True)], "inverse": [i.ravel() for i in inverses]})


def _tested(per_year: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s in f.itertuples(index=False):
                inverse = np.asarray(s.inverse).reshape(_K, _K)
                se = np.sqrt(np.maximum(np.diag(inverse @ _square(s.meat) @ inverse), 0))
                beta = np.asarray(s.beta)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(se > 0, beta / se, np.nan)
                out.append((s.series, s.n, beta[0] * per_year, t[0], s.r2, *beta[1:], *t[1:]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def attribute(returns: DataFrame, factors: DataFrame, lags: int = 5, per_year: int = 252) -> DataFrame:
    """A row for each series: annual alpha, exposures, t values, R2. returns: (series, date, ret); dates without factors don't count.

    Least squares with Bartlett weights over `lags` days of the series and no small-sample correction; deficient factors get the
    coefficients of least norm. A constant series has no R2. Rows of equal date are in the order of their values.
    """
    rows = returns.select(F.col("series").cast("string").alias("series"), "date", F.col("ret").alias("y")).join(factors.select("date", *NAMES), "date").where("y IS NOT NULL")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in NAMES]]
    normal = rows.groupBy("series").agg(F.array(*[F.sum(x[i] * x[j]) for i, j in _UPPER]).alias("xx"), F.array(*[F.sum(c * F.col("y")) for c in x]).alias("xy"))
    solved = normal.mapInPandas(_solved, "series string, beta array<double>, inverse array<double>")
    fitted = sum((F.get("beta", F.lit(i)) * c for i, c in enumerate(x)), F.lit(0.0))
    rest = rows.join(solved.select("series", "beta"), "series").withColumn("e", F.col("y") - fitted)
    rest = rest.select("series", "date", "y", "e", F.array(*[c * F.col("e") for c in x]).alias("g"))
    w = Window.partitionBy("series").orderBy("date", "y", "e")
    lagged = rest.select("series", "y", "e", "g", *[F.lag("g", k).over(w).alias(f"g{k}") for k in range(1, lags + 1)])

    def meat(i: int, j: int) -> F.Column:
        g = [F.col("g")[m] for m in range(_K)]
        total = g[i] * g[j]
        for k in range(1, lags + 1):
            before = F.col(f"g{k}")
            total = total + F.coalesce((1 - k / (lags + 1)) * (g[i] * before[j] + g[j] * before[i]), F.lit(0.0))
        return F.sum(total)

    r2 = 1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("y") * F.count("y"))
    sums = lagged.groupBy("series").agg(F.count("*").alias("n"), r2.alias("r2"), F.array(*[meat(i, j) for i, j in _UPPER]).alias("meat"))
    return sums.join(solved, "series").select("series", "n", "r2", "meat", "beta", "inverse").mapInPandas(_tested(per_year), SCHEMA)
