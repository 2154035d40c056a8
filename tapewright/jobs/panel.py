"""The three workloads as jobs over stored tables: raw bars to signals, signals to predictions, predictions to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.numbers import net_return
from tapewright.operators.asof import simulation_panel
from tapewright.operators.attribution import attribute
from tapewright.operators.clean import flagged, kept, report
from tapewright.operators.dataset import FEATURES, by_label, model_features
from tapewright.operators.exposures import rolling_betas
from tapewright.operators.features import FeatureConfig, signal_table
from tapewright.operators.folds import fold_sizes, test_rows, walk_forward_folds
from tapewright.operators.linear import fit_folds, score
from tapewright.operators.metrics import oos_r2, rank_ic
from tapewright.operators.resample import resample
from tapewright.operators.simulate import BookConfig, simulate
from tapewright.sources import snapshots
from tapewright.sources.files import predictions_text, raw_bar_files, read_predictions, read_raw_bars, write_csv, write_flat
from tapewright.sources.scratch import written


def build_store(spark: SparkSession, raw_root: str, store: str, months: list[str] | None = None, resume: bool = False, **clean) -> DataFrame:
    """Cleans raw bars into the table `store/bars` (by date) and returns the cleaning report of the files read.

    Raw files are read once: their rows, with the flags of cleaning, are written to the shared folder, and bars and report both
    come from there. The new bars appear with the list of their files in one commit, so a run that ends early changes nothing
    and the next one does its work. Without resume all of the table, or all dates of the given months, are what the files say
    now; dates of other months that those files touch keep the rows they have from others. With resume only files that the table doesn't list are read, and those that have changed since; dates that they touch
    keep the rows they have from others. clean: options of clean_bars.
    """
    path = f"{store}/bars"
    before = snapshots.current(spark, path)
    files = raw_bar_files(spark, raw_root, months)
    if resume:
        listed = snapshots.source_files(spark, path, before)
        known = {tuple(r) for r in listed.select("sym", "month", "bytes", "changed").distinct().collect()} if listed is not None else set()  # as many as files are listed above
        files = [f for f in files if (f[0], f[1], f[3], f[4]) not in known]
    raw = read_raw_bars(spark, raw_root, paths=[f[2] for f in files])
    rows = written(flagged(raw, **clean), "flagged")
    bars, gone = kept(rows), None
    if resume or months is not None:
        touched = snapshots.dates_of(bars)
        gone = touched if resume else snapshots.in_months(list(before.folders), months)
        shared = touched if resume else sorted(set(touched) - set(snapshots.in_months(touched, months)))  # a file's first hours may be of the month before
        if before.version and shared:
            there = snapshots.read(spark, path, shared, before).select(bars.columns)
            bars = bars.unionByName(there.join(bars.select("sym", "time"), ["sym", "time"], "left_anti"))
    if files or not resume:
        sources = spark.createDataFrame([(f[0], f[1], f[3], f[4]) for f in files], "sym string, month string, bytes long, changed long")
        snapshots.commit(spark, path, snapshots.stage(bars, path, sources=sources), before, gone, with_sources=True)
    return report(rows)


def build_signals(spark: SparkSession, store: str, daily: DataFrame, factors: DataFrame, minutes: int = 5, config: FeatureConfig | None = None) -> None:
    """`store/bars` to `store/bars5`, `store/betas` and `store/sig`, all dates in one plan each; the tables by date change at once."""
    snapshots.replace(resample(snapshots.read(spark, f"{store}/bars"), minutes), f"{store}/bars5")
    write_flat(rolling_betas(daily, factors), f"{store}/betas")
    snapshots.replace(signal_table(snapshots.read(spark, f"{store}/bars5"), spark.read.parquet(f"{store}/betas"), daily, config), f"{store}/sig")


def walk_forward(rows: DataFrame, labels: list[str], embargo: int = 5, min_train: int = 100_000, min_test: int = 10_000, features: list[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(predictions, results): out-of-sample predictions of every fold that is large enough, and their R2, rank skill and first coefficient.

    Model rows and scored rows are written once each; folds, sizes and moments read the first, both measures the second.
    """
    long = written(by_label(model_features(rows), labels, features), "long")
    folds = written(walk_forward_folds(long, ["label"], embargo), "folds")
    folds = written(folds.join(fold_sizes(long, folds, ["label"], min_train, min_test).select("label", "fold"), ["label", "fold"]), "folds")
    models = written(fit_folds(long, folds, features), "models")
    scored = written(score(test_rows(long, folds, ["label"]), models, features).select("label", "fold", "date", "sym", "bkt", "y", "pred"), "scored")
    results = oos_r2(scored, ["label", "fold"]).join(rank_ic(scored, "pred", "y", ["label", "fold"]), ["label", "fold"], "left")
    return scored, results.join(models.select("label", "fold", F.col("beta")[1].alias(f"coef_{features[0]}")), ["label", "fold"])


def store_predictions(rows: DataFrame, label: str, path: str, **folds) -> DataFrame:
    """Out-of-sample predictions of one label as text in `path` (eight significant digits, times as HH:MM), read again as a table."""
    write_csv(predictions_text(walk_forward(rows, [label], **folds)[0]), path)
    return read_predictions(rows.sparkSession, path)


def backtest(bars: DataFrame, preds: DataFrame, betas: DataFrame, factors: DataFrame, configs: list[BookConfig], proxy: str = "SPY", slip: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(day results, attribution by configuration)."""
    days = written(simulate(simulation_panel(bars, preds, betas, proxy), configs), "days")
    returns = days.select(F.col("config").alias("series"), "date", net_return(slip).alias("ret"))
    return days, attribute(returns, factors)
