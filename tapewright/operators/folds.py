"""Expanding walk-forward folds with an embargo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk_forward_folds(rows: DataFrame, by: list[str], embargo: int = 5, min_train_years: int = 1) -> DataFrame:
    """(by, fold, train_end, test_start, test_end): a row for each test year and group.

    Training ends with the year before; testing starts at the date after `embargo` dates of the test year's begin and ends
    with the year or the last date. A year with too few later dates has no fold. Works on distinct dates: days, not rows.
    """
    dates = rows.where("date IS NOT NULL").select(*by, "date").distinct().withColumn("year", F.year("date"))
    w = Window.partitionBy(*by)
    ranked = dates.select(*by, "date", "year", F.row_number().over(w.orderBy("date")).alias("nth"), F.min("year").over(w).alias("y0"), F.max("year").over(w).alias("y1"), F.max("date").over(w).alias("last"))
    span = ranked.select(*by, "y0", "y1", "last").distinct()
    years = span.where(F.col("y0") + min_train_years <= F.col("y1")).select(*by, "last", F.explode(F.sequence(F.col("y0") + min_train_years, F.col("y1"))).alias("fold"))
    per_year = ranked.groupBy(*by, "year").agg(F.count("*").alias("n"))
    before = years.alias("f").join(per_year.alias("p"), [*[F.col(f"f.{b}").eqNullSafe(F.col(f"p.{b}")) for b in by], F.col("p.year") < F.col("f.fold")], "left").groupBy(*[F.col(f"f.{b}").alias(b) for b in by], F.col("f.fold").alias("fold"), F.col("f.last").alias("last")).agg(F.coalesce(F.sum("p.n"), F.lit(0)).alias("n_before"))
    starts = before.withColumn("nth", (F.col("n_before") + embargo + 1).cast("int")).join(ranked.select(*by, "nth", F.col("date").alias("test_start")), [*by, "nth"])
    end = F.least(F.make_date("fold", F.lit(12), F.lit(31)), F.col("last"))
    return starts.select(*by, "fold", F.make_date(F.col("fold") - 1, F.lit(12), F.lit(31)).alias("train_end"), "test_start", end.alias("test_end")).where("test_start <= test_end")


def test_rows(rows: DataFrame, folds: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the fold that tests them. Folds are years by groups: a table of checked, small size."""
    if folds.limit(10_001).count() > 10_000:
        raise ValueError("too many folds to broadcast")
    f = F.broadcast(folds.select(*[F.col(b).alias(f"_{b}") for b in by], "fold", "test_start", "test_end"))
    on = F.col("date").between(F.col("test_start"), F.col("test_end"))
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    return rows.join(f, on).drop(*[f"_{b}" for b in by], "test_start", "test_end")


def fold_sizes(rows: DataFrame, folds: DataFrame, by: list[str], min_train: int = 100_000, min_test: int = 10_000) -> DataFrame:
    """(by, fold, n_train, n_test) of folds with enough rows, from counts by date. Both sides are dates by groups; Spark broadcasts one if it is small."""
    days = rows.groupBy(*by, "date").agg(F.count("*").alias("n"))
    f = folds.select(*[F.col(b).alias(f"_{b}") for b in by], "fold", "train_end", "test_start", "test_end")
    on = F.col("date") <= F.col("test_end")
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    both = days.join(f, on)
    out = both.groupBy(*by, "fold").agg(
        F.coalesce(F.sum(F.when(F.col("date") <= F.col("train_end"), F.col("n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(F.col("date") >= F.col("test_start"), F.col("n"))), F.lit(0)).alias("n_test"),
    )
    return out.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def validation_cut(rows: DataFrame, by: list[str], share: float = 0.85) -> DataFrame:
    """(by, cut): the date at place int(share * n) (from 0) of the sorted distinct dates."""
    w = Window.partitionBy(*by)
    dates = rows.where("date IS NOT NULL").select(*by, "date").distinct()
    ranked = dates.select(*by, "date", (F.row_number().over(w.orderBy("date")) - 1).alias("nth"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("nth") == F.floor(F.col("n") * F.lit(share))).select(*by, F.col("date").alias("cut"))
