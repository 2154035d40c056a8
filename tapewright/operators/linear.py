"""Linear models over expanding folds, by orthogonal triangles that read each row once.

Rows of one label and year, as columns (1, features, y), are reduced to the triangle R of their QR decomposition, ten numbers
square whatever the number of rows: in each task first, then triangles are stacked and reduced again, in groups of a task's
number and then by year. A fold's triangle is that of the years before it, so no row is read again for a later fold. As the
first column is constant, what remains of R below its first row is the triangle of the centred data. Moments would square the
condition number; a triangle keeps it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triangles of so many groups of tasks meet before those of a year do.
GROUPS = 64
_TRIANGLES = "label string, year int, part int, n long, r array<double>"


def _reduced(stack: np.ndarray) -> np.ndarray:
    """The triangle of the rows, as square as they are wide."""
    r = np.linalg.qr(stack, mode="r")
    out = np.zeros((stack.shape[1],) * 2)
    out[: len(r)] = r
    return out


def _of_tasks(features: list[str]):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
        for frame in frames:
            for key, rows in frame.groupby(["label", "year"], sort=False):
                n, r = held.get(key, (0, np.zeros((0, len(features) + 2))))
                z = np.column_stack([np.ones(len(rows)), rows[[*features, "y"]].to_numpy(np.float64)])
                held[key] = n + len(rows), _reduced(np.vstack([r, z]))
        part = TaskContext.get().partitionId() % GROUPS
        yield pd.DataFrame([(label, year, part, n, r.ravel()) for (label, year), (n, r) in held.items()], columns=["label", "year", "part", "n", "r"])

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    width = int(np.sqrt(len(frame["r"].iloc[0])))
    first = frame.iloc[0]
    r = _reduced(np.vstack([np.asarray(x).reshape(width, width) for x in frame["r"]]))
    return pd.DataFrame([(first["label"], first["year"], first["part"], int(frame["n"].sum()), r.ravel())], columns=["label", "year", "part", "n", "r"])


def year_triangles(rows: DataFrame, features: list[str]) -> DataFrame:
    """(label, year, part, n, r) of the long form's rows (1, features, y), one for each label and year; rows are complete cases."""
    own = rows.select("label", F.year("date").alias("year"), *[F.col(c).cast("double").alias(c) for c in [*features, "y"]]).mapInPandas(_of_tasks(features), _TRIANGLES)
    grouped = own.groupBy("label", "year", "part").applyInPandas(_merged, _TRIANGLES)
    return grouped.groupBy("label", "year").applyInPandas(_merged, _TRIANGLES)


def fit_folds(rows: DataFrame, folds: DataFrame, features: list[str]) -> DataFrame:
    """(label, fold, n_train, mu, sd, beta): means, sample deviations (1 where 0) and least-squares coefficients, intercept first, on standardised features.

    Rank-deficient folds get the coefficients of least norm.
    """
    per_fold = year_triangles(rows, features).join(folds.select("label", "fold"), "label").where(F.col("year") < F.col("fold"))
    k = len(features)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].sum())
        r = _reduced(np.vstack([np.asarray(x).reshape(k + 2, k + 2) for x in frame["r"]]))
        mean = r[0, 1:] / r[0, 0]
        centred = r[1:, 1:]
        var = (centred[:, :k] ** 2).sum(0) / max(n - 1, 1)
        varies = var > np.maximum(1e-18, (1e-13 * mean[:k]) ** 2)  # what is left of a constant one is rounding
        sd = np.where(varies, np.sqrt(var), 1.0)
        slopes = np.linalg.lstsq(np.where(varies, centred[:, :k] / sd, 0.0), centred[:, k], rcond=1e-12)[0]
        return pd.DataFrame({"label": [key[0]], "fold": [key[1]], "n_train": [n], "mu": [mean[:k].tolist()], "sd": [sd.tolist()], "beta": [[mean[k], *slopes]]})

    return per_fold.groupBy("label", "fold").applyInPandas(fit, "label string, fold int, n_train long, mu array<double>, sd array<double>, beta array<double>")


def train_statistics(rows: DataFrame, folds: DataFrame, features: list[str]) -> DataFrame:
    """(label, fold, feature, mu, sd) of the training rows."""
    return fit_folds(rows, folds, features).select("label", "fold", F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), "mu", "sd")).alias("z")).select("label", "fold", F.col("z.feature").alias("feature"), F.col("z.mu").alias("mu"), F.col("z.sd").alias("sd"))


def score(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """rows (with label and fold) with `pred`; models hold a row for each label and fold, of which folds.test_rows allows 10,000 at most."""
    m = F.broadcast(models.select("label", "fold", "mu", "sd", "beta"))
    terms = [F.get("beta", F.lit(i + 1)) * (F.col(c) - F.get("mu", F.lit(i))) / F.get("sd", F.lit(i)) for i, c in enumerate(features)]
    pred = F.get("beta", F.lit(0))
    for t in terms:
        pred = pred + t
    return rows.join(m, ["label", "fold"]).withColumn("pred", pred).drop("mu", "sd", "beta")
