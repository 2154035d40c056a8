"""Hand-made frames: edges that change answers."""

import datetime as dt
import gzip
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import duck
from tapewright.functions import calendar as cal
from tapewright.functions import numbers as num
from tapewright.jobs import panel, queries
from tapewright.operators import asof, chunks, clean, dataset, features, folds, linear, metrics, resample
from tapewright.sources import files, snapshots
from tapewright.sources import store as stores

BAR = "sym string, time timestamp_ntz, open double, high double, low double, close double, volume long, ntrades long, vwap double, date date"


def at(text):
    return dt.datetime.fromisoformat(text)


def bar(sym, text, open_=1.0, close=1.0, volume=10, vwap=1.0, high=2.0, low=0.5):
    t = at(text)
    return (sym, t, open_, high, low, close, volume, 1, vwap, t.date())


def test_new_york_edges(spark):
    df = spark.createDataFrame([(at("2024-03-10 06:30"),), (at("2024-11-03 05:30"),), (at("2024-07-01 13:30"),), (at("2024-01-02 14:30"),)], "ts timestamp_ntz")
    rule = [r[0] for r in df.select(cal.to_new_york("ts")).collect()]
    zone = [r[0] for r in df.select(cal.to_new_york("ts", "America/New_York")).collect()]
    assert rule == [at("2024-03-10 02:30"), at("2024-11-03 00:30"), at("2024-07-01 09:30"), at("2024-01-02 09:30")]
    assert zone == [at("2024-03-10 01:30"), at("2024-11-03 01:30"), at("2024-07-01 09:30"), at("2024-01-02 09:30")]


RAW = "sym string, ts timestamp_ntz, open double, high double, low double, close double, volume long, ntrades long, vwap double, seq long"


def test_cleaning_keeps_the_first_and_adds_up(spark):
    t = at("2024-07-01 13:30")
    rows = [("A", t, 1.0, None, 0.5, 1.0, 1, 1, 1.0, 5), ("A", t, 9.0, 9.0, 9.0, 9.0, 1, 1, 9.0, 7), ("A", at("2024-07-01 03:00"), 1.0, 1.0, 1.0, 1.0, 1, 1, 1.0, 1), ("A", None, 1.0, 1.0, 1.0, 1.0, 1, 1, 1.0, 2), ("A", at("2024-07-01 19:59"), 1.0, 1.0, 1.0, 1.0, 1, 1, 1.0, 3), ("A", at("2024-07-01 20:00"), 1.0, 1.0, 1.0, 1.0, 1, 1, 1.0, 4)]
    raw = spark.createDataFrame(rows, RAW)
    kept = clean.clean_bars(raw).orderBy("time").collect()
    assert [(r["time"], r["open"]) for r in kept] == [(at("2024-07-01 09:30"), 1.0), (at("2024-07-01 15:59"), 1.0)]
    report = clean.clean_report(raw).where("month = '2024-07'").first()
    assert (report["raw"], report["dropped_outside"], report["dropped_dupes"], report["bad_high_low"], report["written"], report["days_written"]) == (4, 1, 1, 1, 2, 1)  # 03:00 UTC is still June in New York
    assert all(r["conserved"] for r in clean.conserved(clean.clean_report(raw)).collect())
    assert clean.clean_bars(raw.limit(0)).count() == 0


def test_resample_nulls(spark):
    rows = [bar("A", "2024-01-02 09:30", None, 1.0, 10, 2.0), bar("A", "2024-01-02 09:31", 3.0, 2.0, 30, None), bar("A", "2024-01-02 09:34", 4.0, None, 0, 5.0), bar("A", "2024-01-02 09:35", 7.0, 7.0, 0, 5.0)]
    got = resample.resample(spark.createDataFrame(rows, BAR), 5).orderBy("time").collect()
    assert [(r["open"], r["close"], r["volume"], r["vwap"]) for r in got] == [(None, None, 40, 2.0), (7.0, 7.0, 0, None)]


def test_asof_ties_nulls_and_chunks(spark):
    left = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 9, 3), ("b", 5, 4), ("a", None, 5)], "k string, t int, id int").withColumn("t", F.timestamp_seconds(F.col("t") * 86400 * 20))
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 6, None), ("a", None, 7.0), ("c", 1, 3.0)], "k string, rt int, v double").withColumn("rt", F.timestamp_seconds(F.col("rt") * 86400 * 20))
    want = {1: None, 2: 1.0, 3: None, 4: None, 5: None}  # a null value is a match as well
    for chunk in (None, "MONTH", 1, 2):
        got = asof.asof_join(left, right.withColumn("hit", F.lit(1)), ["k"], "t", "rt", ["v", "hit"], chunk).collect()
        assert {r["id"]: r["v"] for r in got} == want
        assert {r["id"]: r["hit"] for r in got} == {1: None, 2: 1, 3: 1, 4: None, 5: None}


def test_asof_divides_a_crowded_key(spark):
    """A key whose rows are all of one day, beside small ones: chunks of its own rows, and the same answer."""
    left = spark.range(3000).selectExpr("if(id % 10 = 0, concat('k', id % 70), 'hot') AS k", "timestamp_millis(1704067200000 + (id * 7919 % 86400) * 1000) AS t", "id")
    right = spark.range(900).selectExpr("if(id % 9 = 0, concat('k', id % 70), 'hot') AS k", "timestamp_millis(1704067200000 + (id * 104729 % 86400) * 1000) AS rt", "id AS v")
    whole = {(r["id"], r["v"]) for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    parts = asof.asof_join(left, right, ["k"], "t", "rt", ["v"], 100)
    assert {(r["id"], r["v"]) for r in parts.collect()} == whole and len(whole) == 3000
    limits = asof.bounds(left.selectExpr("k", "t").union(right.selectExpr("k", "rt")), ["k"], "t", 100)
    sizes = [r["count"] for r in asof.chunked(left, ["k"], "t", limits).groupBy("k", "_chunk").count().where("k = 'hot'").collect()]
    assert len(sizes) > 25 and max(sizes) < 200


def test_latest_date_differs_from_newest_row(spark):
    betas = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("B", dt.date(2024, 1, 2), 2.0)], "sym string, date date, mkt double")
    days = spark.createDataFrame([("A", dt.date(2024, 1, 3)), ("B", dt.date(2024, 1, 3)), ("B", dt.date(2024, 1, 2))], "sym string, date date")
    newest = {(r["sym"], r["date"].day): r["mkt"] for r in asof.prior_betas(days, betas, ["mkt"]).collect()}
    assert newest == {("A", 3): 1.0, ("B", 3): 2.0, ("B", 2): None}
    latest = {(r["sym"], r["date"].day): r["beta"] for r in asof.betas_of_last_date(days, betas).collect()}
    assert latest == {("B", 3): 2.0, ("A", 2): 1.0}


def test_labels_stop_at_the_clock_and_rows_may_be_missing(spark):
    times = ["09:30", "09:35", "09:45", "15:50"]  # a missing middle bucket
    rows = spark.createDataFrame([("A", at(f"2024-01-02 {t}"), dt.date(2024, 1, 2), float(i + 1)) for i, t in enumerate(times)], "sym string, time timestamp_ntz, date date, resid double")
    got = features.trailing(rows, features.FeatureConfig()).orderBy("time").collect()
    assert [r["cumres30"] for r in got] == [1.0, 3.0, 6.0, 10.0]
    assert [r["fwdres10"] for r in got] == [5.0, 7.0, 4.0, None]
    full = features.trailing(rows, features.FeatureConfig(require_full_window=True)).orderBy("time").collect()
    assert [r["fwdres10"] for r in full] == [5.0, 7.0, None, None]
    one = features.bar_returns(rows.limit(1).withColumn("close", F.lit(1.0))).first()
    assert one["ret5"] is None


def test_proxy_return_whether_broadcast_or_not(spark):
    rows = [(s, at(f"2024-01-02 09:3{i}"), float(i)) for s in ("SPY", "A", "B") for i in range(4)] + [("A", at("2024-01-02 10:00"), 9.0)]
    df = spark.createDataFrame(rows, "sym string, time timestamp_ntz, ret5 double")
    got = [sorted((r["sym"], r["time"], r["spyret"] is None, r["spyret"] or 0.0) for r in features.with_proxy_return(df, "SPY", most=m).collect()) for m in (2, 100)]
    assert got[0] == got[1] and len(got[0]) == 9 and sum(r[2] for r in got[0]) == 1


def test_clip_keeps_null_and_constant_has_no_correlation(spark):
    df = spark.createDataFrame([(None, 1.0), (99.0, 1.0), (-99.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(num.clip("x", -8, 8)).collect()] == [None, 8.0, -8.0]
    assert df.agg(num.correlation("x", "y")).first()[0] is None


def test_rank_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None), (2, 3.0)], "k int, v double")
    got = df.select("k", "v", metrics.average_rank("v", ["k"]).alias("r")).collect()
    assert sorted((r["k"], r["v"] or -1, r["r"]) for r in got if r["r"] is not None) == [(1, 5.0, 1.5), (1, 5.0, 1.5), (1, 7.0, 3.0), (2, 3.0, 1.0)]
    assert [r["r"] for r in got if r["v"] is None] == [None]


def _sections(spark, days: int):
    """500 rows a day in five buckets, with ties."""
    date = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % days).cast("int"))
    noise = lambda k: F.pmod(F.hash("id", F.lit(k)), F.lit(50)).cast("double")
    return spark.range(days * 500).select(F.lit(1).alias("fold"), date.alias("date"), F.floor(F.col("id") / days % 5).cast("int").alias("bkt"), noise(1).alias("pred"), noise(2).alias("y"))


def test_tasks_that_rank_grow_in_number_and_not_in_rows(spark):
    keys = ["fold", "date", "bkt"]
    for days in (8, 64):
        parts = chunks.dealt(_sections(spark, days), keys, 1000).groupBy(F.spark_partition_id().alias("part"), *keys).count().toPandas()
        assert parts.groupby("part")["count"].sum().max() <= 4000 and parts["count"].sum() == days * 500
        assert not parts.duplicated(keys).any()  # a cross-section lies in one task
    few = _sections(spark, 2)
    assert chunks.dealt(few, keys, 1000) is few


@pytest.mark.parametrize("per", ["day", "bucket"])
def test_rank_skill_is_the_same_however_rows_are_dealt(spark, per):
    rows = _sections(spark, 16)
    a, b = (metrics.rank_ic(rows, "pred", "y", ["fold"], per, n) for n in (500, 1_000_000))
    assert a._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert "RepartitionByExpression" not in b._jdf.queryExecution().optimizedPlan().toString()
    (x,), (y,) = a.collect(), b.collect()
    assert x["n_days"] == y["n_days"] == 16 and x["mean_ic"] == pytest.approx(y["mean_ic"], abs=1e-12) and x["t_ic"] == pytest.approx(y["t_ic"], abs=1e-9)
    assert metrics.rank_ic(rows, "y", "y", ["fold"], per, 500).first()["mean_ic"] == pytest.approx(1.0)


@pytest.mark.parametrize("name, per", [("a13_w6_rank_ic", "day"), ("a13_rank_ic_per_bucket", "bucket")])
def test_rank_skill_in_many_tasks_equals_sql(spark, sf, name, per):
    got = metrics.rank_ic(queries._scored(spark, sf), "pred", "y", ["fold"], per, 500)
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()
    shown = [tuple(r) for r in got.orderBy("fold").select("fold", F.round("mean_ic", 6), F.round("t_ic", 6), "n_days").collect()]
    assert shown == duck(sf).sql(queries.ORACLES[name]).order("fold").project("fold, mean_ic, t_ic, n_days").fetchall()


def test_folds_embargo(spark):
    days = [dt.date(y, 1, d) for y in (2020, 2021) for d in range(1, 11)] + [dt.date(2022, 1, d) for d in range(1, 5)]
    rows = spark.createDataFrame([("l", d) for d in days], "label string, date date")
    got = folds.walk_forward_folds(rows, ["label"]).collect()
    assert [(r["fold"], r["train_end"], r["test_start"], r["test_end"]) for r in got] == [(2021, dt.date(2020, 12, 31), dt.date(2021, 1, 6), dt.date(2021, 12, 31))]
    assert folds.walk_forward_folds(rows.limit(0), ["label"]).count() == 0


def test_moments_give_direct_least_squares(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.normal(size=(n, 2)) * [1.0, 3.0] + [100.0, -5.0]
    frame = pd.DataFrame({"label": "l", "date": [dt.date(2000 + i % 3, 1, 1 + i % 28) for i in range(n)], "a": x[:, 0], "b": x[:, 1], "c": x[:, 0], "y": x @ [0.5, -0.25] + rng.normal(size=n)})
    f = spark.createDataFrame([("l", 2002)], "label string, fold int")
    got = linear.fit_folds(spark.createDataFrame(frame), f, ["a", "b", "c"]).first()  # c repeats a: rank-deficient
    train = frame[[d.year < 2002 for d in frame["date"]]]
    z = (train[["a", "b", "c"]] - train[["a", "b", "c"]].mean()) / train[["a", "b", "c"]].std()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), train["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(got["beta"], want, atol=1e-9) and np.allclose(got["sd"], train[["a", "b", "c"]].std())


def test_factor_text(spark):
    text = "Banner\nNot a date, 1\n  20240102, 1.50, -0.25\n20240103, -99.99, 0.10\n20240104, 0.10, 0.20\n\nAnnual\n20241231, 7, 7\n"
    got = files.parse_factor_text(spark.createDataFrame([(text,)], "value string"), ["m", "s"]).orderBy("date").collect()
    assert [(r["date"].day, round(r["m"], 6), round(r["s"], 6)) for r in got] == [(2, 0.015, -0.0025), (4, 0.001, 0.002)]


def test_csv_of_bars(spark, tmp_path):
    head = "ts,open,high,low,close,volume,ntrades,vwap\n"
    for sym, month, line in (("AA", "2024-01", "2024-01-02T14:30:00Z,1,2,0.5,1.5,10,3,1.2\nbroken,x,2,0.5,1.5,10,3,1.2\n"), ("BB", "2024-02", "2024-02-01T14:30:00Z,1,2,0.5,1.5,10,3,1.2\n")):
        os.makedirs(tmp_path / sym)
        with gzip.open(tmp_path / sym / f"{month}.csv.gz", "wt") as f:
            f.write(head + line)
    (tmp_path / "stray.csv").write_text(head)
    got = files.read_raw_bars(spark, str(tmp_path)).orderBy("sym", "seq").collect()
    assert [(r["sym"], r["month"], r["ts"], r["open"]) for r in got] == [("AA", "2024-01", at("2024-01-02 14:30"), 1.0), ("AA", "2024-01", None, None), ("BB", "2024-02", at("2024-02-01 14:30"), 1.0)]
    assert files.read_raw_bars(spark, str(tmp_path), ["2024-02"]).count() == 1
    empty = files.read_raw_bars(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and "ntrades" in empty.columns


def test_daily_and_factor_files(spark, tmp_path):
    (tmp_path / "daily").mkdir()
    (tmp_path / "daily" / "AA.csv").write_text("date,open,high,low,close,volume\n2024-01-03,1,2,0.5,1.5,10\n2024-01-02,1,2,0.5,x,10\n")
    (tmp_path / "daily" / "BB.csv").write_text("date,open,high,low,close,volume\n2024-01-02,3,4,2,3.5,\n")
    got = [(r["sym"], r["date"].day, r["close"], r["volume"]) for r in files.read_daily(spark, str(tmp_path / "daily")).collect()]
    assert got == [("AA", 2, None, 10), ("AA", 3, 1.5, 10), ("BB", 2, 3.5, None)]
    assert files.read_daily(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "f.csv").write_text("date,mkt_rf,smb,hml,wml,rf\n2024-01-02,0.01,0.02,,0.04,0.0001\n")
    assert [tuple(r)[1:4] for r in files.read_factors(spark, str(tmp_path / "f.csv")).collect()] == [(0.01, 0.02, None)]
    (tmp_path / "t.txt").write_text("Banner\n20240102, 1.50\n\nAnnual\n20241231, 7\n")
    assert [(r["date"].day, r["m"]) for r in files.read_factor_text(spark, str(tmp_path / "t.txt"), ["m"]).collect()] == [(2, 0.015)]


def test_store_goes_on_where_it_stopped(spark, tmp_path):
    """A symbol that comes later joins dates that are there; what is loaded isn't loaded again."""
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    row = lambda sym, text, close, seq: (sym, at(text), 1.0, 2.0, 0.5, close, 10, 1, 1.0, seq)
    files.write_raw_bars(spark.createDataFrame([row("A", "2024-01-02 14:30", 1.0, 1), row("A", "2024-02-01 14:30", 2.0, 2)], RAW), raw)
    first = panel.build_store(spark, raw, store, resume=True).collect()
    assert sum(r["written"] for r in first) == 2
    files.write_raw_bars(spark.createDataFrame([row("B", "2024-01-02 14:31", 3.0, 1)], RAW), str(tmp_path / "more"))
    os.makedirs(f"{raw}/B")
    os.rename(tmp_path / "more" / "B" / "2024-01.csv.gz", f"{raw}/B/2024-01.csv.gz")
    second = panel.build_store(spark, raw, store, resume=True).collect()
    assert [(r["month"], r["raw"]) for r in second] == [("2024-01", 1)]
    bars = snapshots.read(spark, f"{store}/bars").orderBy("time").collect()
    assert [(r["sym"], r["close"]) for r in bars] == [("A", 1.0), ("B", 3.0), ("A", 2.0)]
    assert panel.build_store(spark, raw, store, resume=True).count() == 0 and snapshots.read(spark, f"{store}/bars").count() == 3
    whole = panel.build_store(spark, raw, store)
    assert whole.count() == 2 and snapshots.read(spark, f"{store}/bars").count() == 3


def raw_row(sym, text, close=1.0, seq=1):
    return (sym, at(text), 1.0, 2.0, 0.5, close, 10, 1, 1.0, seq)


def test_months_and_symbols_open_their_files_only(spark, tmp_path):
    """Files of other months and symbols may be broken: they aren't opened."""
    root = str(tmp_path / "raw")
    files.write_raw_bars(spark.createDataFrame([raw_row(s, f"2024-{m:02}-05 14:3{i}", seq=i) for s in ("A", "B") for m in (1, 2, 3) for i in range(3)], RAW), root)
    for broken in ("A/2024-01", "B/2024-01", "B/2024-02"):
        with open(f"{root}/{broken}.csv.gz", "wb") as f:
            f.write(b"not gzip at all")
    (tmp_path / "raw" / "A" / "notes.csv").write_text("ts\nx\n")
    got = files.read_raw_bars(spark, root, ["2024-02", "2031-07"], ["A", "none"])
    assert [(r["sym"], r["month"], r["ts"].minute) for r in got.orderBy("seq").collect()] == [("A", "2024-02", 30 + i) for i in range(3)]
    later = files.read_raw_bars(spark, root).where("sym = 'A' AND month >= '2024-02'")  # prunes files as well
    assert later.count() == 6
    assert clean.clean_bars(files.read_raw_bars(spark, root, ["2024-03"])).count() == 6
    assert files.read_raw_bars(spark, root, []).count() == 0 and files.read_raw_bars(spark, root, symbols=[]).count() == 0
    assert panel.build_store(spark, root, str(tmp_path / "store"), ["2024-03"]).count() == 1
    assert snapshots.read(spark, str(tmp_path / "store" / "bars")).count() == 6


def test_order_of_rows_does_not_hang_on_partitions(spark, tmp_path):
    root = str(tmp_path / "raw")
    files.write_raw_bars(spark.createDataFrame([raw_row(f"S{i % 40}", f"2024-0{1 + i % 2}-05 14:{i % 60:02}", seq=i) for i in range(400)], RAW), root)
    one = {(r["sym"], r["ts"], r["seq"]) for r in files.read_raw_bars(spark, root).collect()}
    assert files.read_raw_bars(spark, root).rdd.getNumPartitions() < 20  # small files share tasks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        many = files.read_raw_bars(spark, root)
        assert many.rdd.getNumPartitions() > 4 and {(r["sym"], r["ts"], r["seq"]) for r in many.collect()} == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({(s, q) for s, _, q in one}) == 400


ODD = ["^GSPC", "BRK B", "BRK/B", "A%2FB", "50%", "x+y", "{a,b}", "[z]*?", "\u00e9t\u00e9", "a=b"]


def test_symbols_survive_their_file_names(spark, tmp_path):
    bars, daily = str(tmp_path / "raw"), str(tmp_path / "daily")
    files.write_raw_bars(spark.createDataFrame([raw_row(s, "2024-01-05 14:30") for s in ODD], RAW), bars)
    assert sorted(r["sym"] for r in files.read_raw_bars(spark, bars).collect()) == sorted(ODD)
    for s in ODD:
        assert [r["sym"] for r in files.read_raw_bars(spark, bars, symbols=[s]).collect()] == [s]
    assert os.path.isdir(f"{bars}/^GSPC") and os.path.isdir(f"{bars}/BRK B")
    files.write_daily(spark.createDataFrame([(s, dt.date(2024, 1, 5), 1.0, 1.0, 1.0, 1.0, 5) for s in ODD], "sym string, date date, open double, high double, low double, close double, volume long"), daily)
    assert sorted(r["sym"] for r in files.read_daily(spark, daily).collect()) == sorted(ODD)


def test_files_are_written_again_and_whole(spark, tmp_path):
    """A second run replaces files; a limit on rows a file loses none; rows without a name are an error."""
    root = str(tmp_path / "raw")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        for close in (1.0, 2.0):
            files.write_raw_bars(spark.createDataFrame([raw_row("A", f"2024-01-05 14:3{i}", close, i) for i in range(5)], RAW), root)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [r["close"] for r in files.read_raw_bars(spark, root).collect()] == [2.0] * 5
    assert os.listdir(root) == ["A"]
    with pytest.raises(Exception, match="has no file"):
        files.write_raw_bars(spark.createDataFrame([raw_row(None, "2024-01-05 14:30")], RAW), root)
    with pytest.raises(OSError, match="could not be renamed"):
        stores.move(spark, [(f"{root}/nothing", f"{root}/B/x")])


def test_a_load_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "store")
    files.write_raw_bars(spark.createDataFrame([raw_row("A", "2024-01-02 14:30", 1.0), raw_row("A", "2024-01-03 14:30", 1.0, 2)], RAW), raw)
    panel.build_store(spark, raw, root, resume=True)
    seen = lambda: sorted((r["sym"], r["date"].day, r["close"]) for r in snapshots.read(spark, f"{root}/bars").collect())
    old, before = seen(), snapshots.current(spark, f"{root}/bars")
    reader = snapshots.read(spark, f"{root}/bars")
    files.write_raw_bars(spark.createDataFrame([raw_row("B", "2024-01-02 14:30", 5.0), raw_row("B", "2024-01-04 14:30", 5.0, 2)], RAW), raw)
    with monkeypatch.context() as m:
        def killed(*_):
            raise KeyboardInterrupt

        m.setattr(stores, "put_new", killed)  # all rows are written, nothing is listed
        with pytest.raises(KeyboardInterrupt):
            panel.build_store(spark, raw, root, resume=True)
    assert seen() == old == [("A", 2, 1.0), ("A", 3, 1.0)]
    panel.build_store(spark, raw, root, resume=True)
    assert seen() == [("A", 2, 1.0), ("A", 3, 1.0), ("B", 2, 5.0), ("B", 4, 5.0)]
    assert reader.count() == 2  # a reader that began before sees what it saw
    assert snapshots.read(spark, f"{root}/bars", snapshot=before).count() == 2
    with pytest.raises(FileExistsError):
        snapshots.commit(spark, f"{root}/bars", snapshots.stage(reader, f"{root}/bars"), before)  # another writer was first
    with pytest.raises(ValueError, match="without a date"):
        snapshots.replace(reader.withColumn("date", F.lit(None).cast("date")), f"{root}/bars")
    assert snapshots.vacuum(spark, f"{root}/bars", keep=1) >= 2  # what the killed run and the late writer left
    assert len(seen()) == 4
    assert [r["date"].day for r in snapshots.read(spark, f"{root}/bars", ["2024-01-04", "2031-01-01"]).collect()] == [4]


def test_reload_forgets_dates_and_months_keep_their_neighbours(spark, tmp_path):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "store")
    late = raw_row("A", "2024-02-01 02:00", 7.0)  # still January in New York
    files.write_raw_bars(spark.createDataFrame([raw_row("A", "2024-01-31 14:30", 1.0), late, raw_row("A", "2024-02-05 14:30", 2.0, 2)], RAW), raw)
    seen = lambda: sorted((str(r["date"]), r["close"]) for r in snapshots.read(spark, f"{root}/bars").collect())
    panel.build_store(spark, raw, root, session=None)
    assert seen() == [("2024-01-31", 1.0), ("2024-01-31", 7.0), ("2024-02-05", 2.0)]
    files.write_raw_bars(spark.createDataFrame([late, raw_row("A", "2024-02-06 14:30", 3.0, 2)], RAW), raw)
    panel.build_store(spark, raw, root, ["2024-02"], session=None)
    assert seen() == [("2024-01-31", 1.0), ("2024-01-31", 7.0), ("2024-02-06", 3.0)]
    os.remove(f"{raw}/A/2024-01.csv.gz")
    panel.build_store(spark, raw, root, session=None)
    assert seen() == [("2024-01-31", 7.0), ("2024-02-06", 3.0)]


def test_the_report_needs_no_second_reading(spark, tmp_path):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "store")
    files.write_raw_bars(spark.createDataFrame([raw_row("A", "2024-01-02 14:30"), raw_row("A", "2024-01-02 14:30", 3.0, 2), raw_row("A", "2024-01-02 03:00", seq=3)], RAW), raw)
    told = panel.build_store(spark, raw, root)
    stores.remove(spark, raw)
    assert [(r["raw"], r["dropped_outside"], r["dropped_dupes"], r["written"]) for r in told.orderBy("month").collect()] == [(3, 1, 1, 1)]


def test_a_changed_file_is_loaded_again(spark, tmp_path):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "store")
    for close in (1.0, 2.0):
        files.write_raw_bars(spark.createDataFrame([raw_row("A", "2024-01-02 14:30", close)], RAW), raw)
        os.utime(f"{raw}/A/2024-01.csv.gz", (1e9 + close * 1000,) * 2)
        panel.build_store(spark, raw, root, resume=True)
    assert [r["close"] for r in snapshots.read(spark, f"{root}/bars").collect()] == [2.0]


def test_a_date_larger_than_a_task_is_several_files(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.range(20_000).selectExpr("concat('S', lpad(id % 97, 2, '0')) AS sym", "TIMESTAMP_NTZ'2024-01-02 09:30:00' + make_interval(0, 0, 0, 0, 0, id) AS time", "id", "CASE WHEN id % 10 = 0 THEN date_add(DATE'2024-01-03', CAST(id % 7 AS INT)) ELSE DATE'2024-01-02' END AS date")
    files.write_by_date(rows, path, rows_a_file=2500)
    parts = [f for f in os.listdir(f"{path}/date=2024-01-02") if f.startswith("part")]
    assert len(parts) >= 6
    spans = []
    for f in parts:  # each in order, and each a range of symbols of its own
        t = pd.read_parquet(f"{path}/date=2024-01-02/{f}")
        assert list(zip(t["sym"], t["time"], strict=True)) == sorted(zip(t["sym"], t["time"], strict=True)) and len(t) < 5000
        spans.append((t["sym"].iloc[0], t["time"].iloc[0], t["sym"].iloc[-1], t["time"].iloc[-1]))
    spans.sort()
    assert all(a[2:] < b[:2] for a, b in zip(spans, spans[1:], strict=False))
    assert spark.read.parquet(path).select(rows.columns).exceptAll(rows).count() == 0 and spark.read.parquet(path).count() == 20_000
    assert max(len(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=2024-01-0") and d != "date=2024-01-02") <= 4


def test_write_by_date_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "bars")
    both = spark.createDataFrame([bar("A", "2024-01-02 09:30"), bar("A", "2024-01-03 09:30")], BAR)
    files.write_by_date(both, path)
    files.write_by_date(both.where("date = DATE '2024-01-03'").withColumn("close", F.lit(9.0)), path)
    assert [r["close"] for r in spark.read.parquet(path).orderBy("date").collect()] == [1.0, 9.0]
    assert len(os.listdir(f"{path}/date=2024-01-03")) <= 2


def test_seeded_sample_is_stable(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    a = {r["id"] for r in dataset.seeded_sample(rows, 100, 3, ["id"], ["g"]).collect()}
    b = {r["id"] for r in dataset.seeded_sample(rows.repartition(7), 100, 3, ["id"], ["g"]).collect()}
    assert a == b and len(a) == 200
    assert dataset.seeded_sample(rows.limit(30), 100, 3, ["id"], ["g"]).count() == 30


def test_seeded_sample_of_repeated_keys(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.lit(1).alias("g"))
    for seed in range(4):
        got = [r["k"] for r in dataset.seeded_sample(rows, 100, seed, ["k"], ["g"]).collect()]
        again = [r["k"] for r in dataset.seeded_sample(rows.repartition(5), 100, seed, ["k"], ["g"]).collect()]
        assert len(got) == 100 and sorted(got) == sorted(again) and min(got.count(k) for k in range(3)) > 15
    nothing = spark.createDataFrame([(1, None), (2, None)], "k int, g int")
    assert dataset.seeded_sample(nothing, 1, 0, ["k"], ["g"]).count() == 1


def test_rows_dealt_anew_come_in_more_tasks_as_they_grow(spark, tmp_path):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for n in (5_000, 50_000):
            spark.range(0, n, 1, 8).select("id", F.xxhash64("id").alias("h")).write.parquet(f"{tmp_path}/{n}")
            rows = spark.read.parquet(f"{tmp_path}/{n}")
            parts = queries.dealt_anew(rows).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.max("id"), F.max("h")).toPandas()["n"]
            assert parts.sum() == n and parts.max() <= 10_000 and len(parts) >= n // 10_000
        again = queries.dealt_anew(rows).exceptAll(rows)
        assert again.isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_audit_deals_by_no_fixed_number(spark, sf):
    plan = queries.QUERIES["t3_sample_audit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "Repartition 5" not in plan


def test_scenarios_equal_direct(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"config": "c", "gross": rng.normal(size=50) * 100, "fees": rng.random(50), "traded": rng.random(50) * 1e5})
    got = metrics.pnl_scenarios(spark.createDataFrame(frame), spark.createDataFrame([(0.0,), (1e-4,)], "slip double")).collect()
    for r in got:
        net = frame["gross"] - frame["fees"] - frame["traded"] * r["slip"]
        assert r["total"] == pytest.approx(net.sum()) and r["sharpe"] == pytest.approx(net.mean() / net.std() * 252**0.5)
    with pytest.raises(ValueError):
        metrics.pnl_scenarios(spark.createDataFrame(frame), spark.range(10_001).select(F.col("id").cast("double").alias("slip")))
