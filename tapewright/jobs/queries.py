"""Registered queries over the derived panel, each with the SQL that gives the same rows where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import calendar as cal
from tapewright.functions import numbers as num
from tapewright.jobs import panel
from tapewright.jobs.fixtures import PROXY, load, oracle
from tapewright.operators import asof, attribution, clean, coverage, dataset, exposures, features, folds, linear, metrics, resample, simulate
from tapewright.sources import files, snapshots
from tapewright.sources.scratch import scratch_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- how both sides show their columns: s text, i whole number, f and g numbers (6 and 10 decimals), d date, t time, b truth value


def _spark_column(name: str, kind: str) -> F.Column:
    c = F.col(name)
    shown = {"s": c.cast("string"), "i": c.cast("long"), "d": c.cast("string"), "t": F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "b": c.cast("boolean")}
    places = {"f": 6, "g": 10}.get(kind)
    return (F.when(~F.isnan(c.cast("double")), F.round(c.cast("double"), places) + F.lit(0.0)) if places else shown[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    return {
        "s": f"CAST({name} AS VARCHAR)", "i": f"CAST({name} AS BIGINT)", "d": f"CAST(CAST({name} AS DATE) AS VARCHAR)", "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "b": f"CAST({name} AS BOOLEAN)", "f": f"CASE WHEN isfinite({name}) THEN round(CAST({name} AS DOUBLE), 6) + 0.0 END", "g": f"CASE WHEN isfinite({name}) THEN round(CAST({name} AS DOUBLE), 10) + 0.0 END",
    }[kind] + f" AS {name}"


def query(name: str, columns: str, sql: str | None = None, views: str = "", also: dict[str, str] | None = None):
    """Registers f(spark, sf_dir); columns is 'name:kind ...'."""
    spec = [tuple(x.split(":")) for x in columns.split()]

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*[_spark_column(*x) for x in spec])
        if sql:
            ORACLES[name] = oracle(f"SELECT {', '.join(_sql_column(*x) for x in spec)} FROM ({sql}) AS q", *views.split(), also=also)
        return f

    return add


# ---- common tables of the oracle

BARS = {"bars": "SELECT sym, ts AS time, open, high, low, close, volume, ntrades, vwap, CAST(ts AS DATE) AS date FROM (SELECT *, row_number() OVER (PARTITION BY sym, ts ORDER BY seq) AS rn FROM raw_bars) WHERE rn = 1"}
HOURS = BARS | {
    "hours": """SELECT sym, date_trunc('hour', time) AS time, arg_min_null(open, time) AS open, max(high) AS high, min(low) AS low, arg_max_null(close, time) AS close,
  sum(volume) AS volume, sum(ntrades) AS ntrades, sum(volume * vwap) / sum(volume) AS vwap, min(date) AS date, CAST(60 * hour(date_trunc('hour', min(time))) AS INT) AS bkt FROM bars GROUP BY sym, date_trunc('hour', time)"""
}
BETAS = {"betas": "SELECT date, sym, CAST(volume % 7 AS DOUBLE) / 7 + 0.5 AS mkt FROM daily"}
RETURNS = HOURS | {"rets": "SELECT *, close / nullif(lag(close) OVER (PARTITION BY sym, date ORDER BY time), 0) - 1 AS ret5 FROM hours"}
USED = {"used": "SELECT d.sym, d.date, b.mkt, b.bdate FROM (SELECT DISTINCT sym, date FROM bars WHERE sym <> 'S0') d ASOF LEFT JOIN (SELECT sym, date AS bdate, date + 1 AS stamp, mkt FROM betas) b ON d.sym = b.sym AND d.date >= b.stamp"}
RESID = RETURNS | BETAS | USED | {
    "resid": """SELECT r.*, p.ret5 AS spyret, u.mkt, r.ret5 - u.mkt * p.ret5 AS resid, coalesce(r.ret5 - u.mkt * p.ret5, 0.0) AS r0 FROM rets r
  LEFT JOIN (SELECT time, ret5 FROM rets WHERE sym = 'S0') p ON r.time = p.time LEFT JOIN used u ON r.sym = u.sym AND r.date = u.date WHERE r.sym <> 'S0'"""
}
W = "OVER (PARTITION BY sym, date ORDER BY time ROWS BETWEEN {} AND {})"
SIG = RESID | {
    "sig": f"""SELECT r.*, sum(r0) {W.format('5 PRECEDING', 'CURRENT ROW')} AS cumres30, sum(r0) {W.format('11 PRECEDING', 'CURRENT ROW')} AS cumres60,
  sqrt(sum(r0 * r0) {W.format('11 PRECEDING', 'CURRENT ROW')}) AS rv60,
  CASE WHEN bkt <= 1260 THEN sum(r0) {W.format('1 FOLLOWING', '2 FOLLOWING')} END AS fwdres10,
  CASE WHEN bkt <= 1200 THEN sum(r0) {W.format('1 FOLLOWING', '3 FOLLOWING')} END AS fwdres15,
  CASE WHEN bkt <= 1020 THEN sum(r0) {W.format('1 FOLLOWING', '6 FOLLOWING')} END AS fwdres30 FROM resid r"""
}
CONFIG = features.FeatureConfig(proxy=PROXY, cutoffs={"fwdres10": 1260, "fwdres15": 1200, "fwdres30": 1020})
LONG = {
    "feats": """SELECT *, CASE WHEN cumres30 IS NOT NULL THEN least(greatest(cumres30 / (rv60 + 1e-8), -8.0), 8.0) END AS z30,
  CASE WHEN cumres60 IS NOT NULL THEN least(greatest(cumres60 / (rv60 + 1e-8), -8.0), 8.0) END AS z60, ln(rv60 + 1e-8) AS lrv,
  CASE WHEN vsurp IS NULL THEN 0.0 ELSE ln(least(greatest(vsurp, 0.05), 20.0)) END AS lvs, CASE WHEN gap IS NULL THEN 0.0 ELSE least(greatest(gap, -0.10), 0.10) END AS gapc,
  CASE WHEN bkt < 630 THEN 1.0 ELSE 0.0 END AS tod_open, CASE WHEN bkt >= 900 THEN 1.0 ELSE 0.0 END AS tod_close FROM model_rows""",
    "long": "SELECT date, sym, bkt, 'fwdres10' AS label, fwdres10 AS y, z30, z60, lrv, lvs, gapc, tod_open, tod_close FROM feats WHERE fwdres10 IS NOT NULL AND z30 IS NOT NULL AND z60 IS NOT NULL",
    "dates": "SELECT DISTINCT date FROM long",
    "ranked": "SELECT date, row_number() OVER (ORDER BY date) AS nth FROM dates",
    "folds": """SELECT y AS fold, make_date(y - 1, 12, 31) AS train_end, r.date AS test_start, least(make_date(y, 12, 31), (SELECT max(date) FROM dates)) AS test_end
  FROM (SELECT CAST(unnest(range((SELECT min(year(date)) FROM dates) + 1, (SELECT max(year(date)) FROM dates) + 1)) AS INT) AS y) ys
  JOIN ranked r ON r.nth = (SELECT count(*) FROM dates WHERE year(date) < y) + 6 WHERE r.date <= least(make_date(y, 12, 31), (SELECT max(date) FROM dates))""",
}


def _bars(spark, sf):
    return clean.clean_bars(load(spark, sf, "raw_bars"), session=None, utc=True)


def _hours(spark, sf):
    return resample.resample(_bars(spark, sf), 60)


def _betas(spark, sf):
    return load(spark, sf, "daily").select("date", "sym", ((F.col("volume") % 7).cast("double") / 7 + 0.5).alias("mkt"))


def _sig(spark, sf):
    hours = written(_hours(spark, sf), "hours")  # as the job has them in its store: read for returns, proxy, days and baseline
    return features.signal_table(hours, _betas(spark, sf), load(spark, sf, "daily"), CONFIG)


def _long(spark, sf):
    return dataset.by_label(dataset.model_features(load(spark, sf, "model_rows")), ["fwdres10"])


def _folds(spark, sf):
    return folds.walk_forward_folds(_long(spark, sf), ["label"])


def _backtest(spark, sf):
    """Day results of three configurations and their attribution, on true bars and predictions."""
    configs = [simulate.BookConfig(name, n_enter=1, n_exit=2, rebalance_every=k, paper_fill=paper) for name, k, paper in (("r2", 2, False), ("r6", 6, False), ("paper", 2, True))]
    return panel.backtest(_hours(spark, sf), load(spark, sf, "preds"), _betas(spark, sf), load(spark, sf, "factors"), configs, PROXY)


#: Stand-in day results that both engines derive alike: (config, date, gross, fees, traded).
DAYS = {
    "days": """SELECT 'c' || CAST(l_suppkey % 3 AS VARCHAR) AS config, CAST(l_shipdate AS DATE) + 8215 AS date, max(l_extendedprice) - 50000 AS gross,
  min(l_discount) AS fees, max(l_quantity) * 1000 AS traded, min(l_quantity) * 1000 AS sold, count(*) AS trades FROM lineitem GROUP BY 1, 2"""
}


def _stand_in_days(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.groupBy(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("config"), F.date_add(F.to_date("l_shipdate"), 8215).alias("date")).agg(
        (F.max("l_extendedprice") - 50000).alias("gross"), F.min("l_discount").alias("fees"), (F.max("l_quantity") * 1000).alias("traded"), (F.min("l_quantity") * 1000).alias("sold"), F.count("*").alias("trades"))


_DST = "d >= make_date(year(d), 3, 8) + CAST((7 - dayofweek(make_date(year(d), 3, 8))) % 7 AS INT) AND d < make_date(year(d), 11, 1) + CAST((7 - dayofweek(make_date(year(d), 11, 1))) % 7 AS INT)"
_NY = {"ny": f"SELECT *, CAST(t AS DATE) AS day, 60 * hour(t) + minute(t) AS m FROM (SELECT *, ts - INTERVAL 5 HOUR + CASE WHEN {_DST} THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS t FROM (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS d FROM raw_bars))"}
_MARKED = _NY | {"marked": "SELECT *, coalesce(m BETWEEN 570 AND 959, false) AS inside, row_number() OVER (PARTITION BY sym, t, coalesce(m BETWEEN 570 AND 959, false) ORDER BY seq) AS rn FROM ny"}


# ---- sources and sinks


@query("s1_s3_raw_bar_files", "sym:s month:s ts:t open:f high:f low:f close:f volume:i ntrades:i vwap:f", "SELECT *, strftime(ts, '%Y-%m') AS month FROM raw_bars", "raw_bars")
def _(spark, sf):
    path = scratch_path(spark, "raw")
    files.write_raw_bars(load(spark, sf, "raw_bars"), path)
    return files.read_raw_bars(spark, path)


@query("s2_s3_raw_files_of_months", "sym:s ts:t volume:i", "SELECT * FROM raw_bars WHERE strftime(ts, '%Y-%m') IN ('2024-01', '2031-07')", "raw_bars")
def _(spark, sf):
    path = scratch_path(spark, "raw")
    files.write_raw_bars(load(spark, sf, "raw_bars"), path)
    return files.read_raw_bars(spark, path, ["2024-01", "2031-07"])  # no symbol has a file for the second


@query("s5_daily_files", "sym:s date:d open:f high:f low:f close:f volume:i", "SELECT * FROM daily", "daily")
def _(spark, sf):
    path = scratch_path(spark, "daily")
    files.write_daily(load(spark, sf, "daily"), path)
    return files.read_daily(spark, path)


@query("s6_factor_files", "date:d mkt_rf:g smb:g hml:g wml:g rf:g", "SELECT * FROM factors", "factors")
def _(spark, sf):
    path = scratch_path(spark, "factors")
    files.write_csv(load(spark, sf, "factors").select("date", "mkt_rf", "smb", "hml", "wml", "rf"), path)
    return files.read_factors(spark, path)


@query("s4_select_months", "sym:s n:i", "SELECT sym, count(*) AS n FROM raw_bars WHERE strftime(ts, '%Y-%m') IN ('2024-01') GROUP BY sym", "raw_bars")
def _(spark, sf):
    return files.select_months(load(spark, sf, "raw_bars"), ["2024-01"]).groupBy("sym").agg(F.count("*").alias("n"))


_TEXT = {"f": "SELECT date, CAST(printf('%.8f', mkt_rf * 100) AS DOUBLE) / 100 AS mkt_rf, CAST(printf('%.8f', smb * 100) AS DOUBLE) / 100 AS smb FROM factors WHERE day(date) <> 13"}


@query("s7_parse_factor_text", "date:d mkt_rf:g smb:g", "SELECT * FROM f", "factors", _TEXT)
def _(spark, sf):
    line = F.concat(F.date_format("date", "yyyyMMdd"), F.lit(", "), F.when(F.dayofmonth("date") == 13, F.lit("-99.99")).otherwise(F.format_string("%.8f", F.col("mkt_rf") * 100)), F.lit(", "), F.format_string("%.8f", F.col("smb") * 100))
    lines = load(spark, sf, "factors").groupBy(F.year("date").alias("year")).agg(F.sort_array(F.collect_list(line)).alias("lines"))  # a file a year: as many lines as days
    text = F.concat(F.lit("Banner of the file\n,Mkt-RF,SMB\n"), F.array_join("lines", "\n"), F.lit("\n\nAnnual\n20240101, 9.9, 9.9\n"))
    return files.parse_factor_text(lines.select(text.alias("value")), ["mkt_rf", "smb"])


@query("s8_merge_factors", "date:d mkt_rf:g wml:g", "SELECT f.date, mkt_rf, m.wml FROM factors f JOIN (SELECT date, CAST(max(volume) AS DOUBLE) / 1000 AS wml FROM daily GROUP BY date) m ON f.date = m.date", "factors daily")
def _(spark, sf):
    momentum = load(spark, sf, "daily").groupBy("date").agg((F.max("volume").cast("double") / 1000).alias("wml"))
    return files.merge_factors(load(spark, sf, "factors").drop("wml"), momentum)


@query("s9_predictions_round_trip", "date:d sym:s bkt:i pred:f", "SELECT date, sym, bkt, CAST(printf('%.8g', pred) AS DOUBLE) AS pred FROM preds", "preds")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    files.write_csv(files.predictions_text(load(spark, sf, "preds")), path)
    return files.read_predictions(spark, path)


@query("s10_write_by_date", "sym:s time:t close:f date:d", "SELECT sym, time, close, date FROM bars", "raw_bars", BARS)
def _(spark, sf):
    path = scratch_path(spark, "bars")
    files.write_by_date(_bars(spark, sf), path)
    return spark.read.parquet(path)


@query("s13_resumed_store", "sym:s time:t close:f date:d", "SELECT sym, t AS time, close, day AS date FROM marked WHERE inside AND rn = 1", "raw_bars", _MARKED)
def _(spark, sf):
    raw, store = scratch_path(spark, "raw"), scratch_path(spark, "store")
    files.write_raw_bars(load(spark, sf, "raw_bars"), raw)
    for months in (["2024-01"], None, None):  # one month first, then what is left of all, then nothing
        panel.build_store(spark, raw, store, months, resume=True)
    return snapshots.read(spark, f"{store}/bars")


@query("s10_dates_in_ranges", "sym:s n:i first:t last:t", "SELECT sym, count(*) AS n, min(time) AS first, max(time) AS last FROM bars GROUP BY sym", "raw_bars", BARS)
def _(spark, sf):
    path = scratch_path(spark, "bars")
    files.write_by_date(_bars(spark, sf), path, rows_a_file=100)  # dates are larger than a file
    return spark.read.parquet(path).groupBy("sym").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("s11_write_flat", "date:d mkt_rf:g smb:g hml:g wml:g rf:g", "SELECT * FROM factors", "factors")
def _(spark, sf):
    path = scratch_path(spark, "factors")
    files.write_flat(load(spark, sf, "factors"), path)
    return spark.read.parquet(path)


@query("s12_day_results_text", "qdate:i gross:f fees:f traded:f sold:f trades:i", "SELECT date - DATE '2000-01-01' AS qdate, round(gross, 2) AS gross, round(fees, 2) AS fees, round(traded, 2) AS traded, round(sold, 2) AS sold, trades FROM days", also=DAYS)
def _(spark, sf):
    path = scratch_path(spark, "days")
    files.write_csv(files.day_results_text(_stand_in_days(spark, sf)), path)
    return spark.read.schema("qdate int, gross double, fees double, traded double, sold double, trades int").option("header", True).csv(path)


@query("s14_export_dataset", "date:d sym:s bkt:i cumres30:f cumres60:f rv60:f fwdres10:f fwdres30:f", "SELECT date, sym, bkt, cumres30, cumres60, rv60, fwdres10, fwdres30 FROM sig WHERE cumres30 IS NOT NULL AND rv60 > 0", "raw_bars daily", SIG)
def _(spark, sf):
    return files.export_dataset(_sig(spark, sf))


# ---- dates, numbers


_D = {"d": "SELECT DISTINCT CAST(o_orderdate AS DATE) + 8215 AS d FROM orders"}


def _dates(spark, sf):
    return load(spark, sf, "factors").select(F.col("date").alias("d"))


@query("p1_first_sunday", "d:d sunday:d", "SELECT d, d + CAST((7 - dayofweek(d)) % 7 AS INT) AS sunday FROM d", also=_D)
def _(spark, sf):
    return _dates(spark, sf).select("d", cal.first_sunday("d").alias("sunday"))


@query("p2_us_dst", "d:d dst:b", f"SELECT d, {_DST} AS dst FROM d", also=_D)
def _(spark, sf):
    return _dates(spark, sf).select("d", cal.is_us_dst("d").alias("dst"))


@query("p3_new_york", "event_id:i ny:t", f"SELECT event_id, ts + INTERVAL 3 MONTH - INTERVAL 5 HOUR + CASE WHEN {_DST} THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS ny FROM (SELECT *, CAST(ts + INTERVAL 3 MONTH - INTERVAL 5 HOUR AS DATE) AS d FROM events)")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", cal.to_new_york(F.col("ts") + F.expr("INTERVAL 3 MONTHS")).alias("ny"))


@query("p4_p5_minute_and_bucket", "event_id:i minute:i date:d bucket:t", "SELECT event_id, 60 * hour(ts) + minute(ts) AS minute, CAST(ts AS DATE) AS date, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", cal.minute_of_day("ts").alias("minute"), F.to_date("ts").alias("date"), cal.bucket("ts", 5).alias("bucket"))


@query("p6_bar_return", "sym:s time:t ret5:f", "SELECT sym, time, ret5 FROM rets", "raw_bars", RETURNS)
def _(spark, sf):
    return features.bar_returns(_hours(spark, sf))


_EXCESS = {"ex": "SELECT d.sym, d.date, d.ret - f.rf AS exret, f.mkt_rf, f.smb, f.hml, f.wml FROM (SELECT sym, date, close / lag(close) OVER (PARTITION BY sym ORDER BY date) - 1 AS ret FROM daily) d JOIN factors f ON d.date = f.date WHERE d.ret IS NOT NULL"}


@query("p7_j1_excess_return", "sym:s date:d exret:g mkt_rf:g", "SELECT * FROM ex", "daily factors", _EXCESS)
def _(spark, sf):
    return exposures.excess_returns(load(spark, sf, "daily"), load(spark, sf, "factors"))


_SIGS = "sym:s time:t ret5:f spyret:f resid:f cumres30:f cumres60:f rv60:f vsurp:f gap:f fwdres10:f fwdres15:f fwdres30:f date:d"
_GAPS = SIG | {
    "base": "SELECT sym, date, bkt, avg(volume) OVER (PARTITION BY sym, bkt ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vbase FROM hours",
    "pc": "SELECT sym, date, lag(close) OVER (PARTITION BY sym ORDER BY date) AS pclose FROM daily",
}


@query(
    "sig_feature_table", _SIGS,
    "SELECT s.sym, s.time, ret5, spyret, resid, cumres30, cumres60, rv60, s.volume / nullif(vbase, 0) AS vsurp, first_value(s.open) OVER (PARTITION BY s.sym, s.date ORDER BY s.time) / nullif(pclose, 0) - 1 AS gap, fwdres10, fwdres15, fwdres30, s.date FROM sig s LEFT JOIN base b ON s.sym = b.sym AND s.date = b.date AND s.bkt = b.bkt LEFT JOIN pc ON s.sym = pc.sym AND s.date = pc.date",
    "raw_bars daily", _GAPS,
)
def _(spark, sf):
    return _sig(spark, sf)


@query("p8_residual", "sym:s time:t resid:f", "SELECT sym, time, resid FROM resid", "raw_bars daily", RESID)
def _(spark, sf):
    return _sig(spark, sf)


@query("p9_w7_overnight_gap", "sym:s date:d gap:f", "SELECT h.sym, h.date, arg_min_null(h.open, h.time) / nullif(max(pclose), 0) - 1 AS gap FROM hours h LEFT JOIN pc ON h.sym = pc.sym AND h.date = pc.date WHERE h.sym <> 'S0' GROUP BY h.sym, h.date", "raw_bars daily", _GAPS)
def _(spark, sf):
    return _sig(spark, sf).select("sym", "date", "gap").distinct()


@query("p10_w5_relative_volume", "sym:s time:t vsurp:f", "SELECT h.sym, h.time, h.volume / nullif(b.vbase, 0) AS vsurp FROM hours h JOIN base b ON h.sym = b.sym AND h.date = b.date AND h.bkt = b.bkt WHERE h.sym <> 'S0'", "raw_bars daily", _GAPS)
def _(spark, sf):
    return _sig(spark, sf)


@query("p11_p13_model_features", "date:d sym:s bkt:i z30:f z60:f lrv:f lvs:f gapc:f tod_open:f tod_close:f", "SELECT * FROM feats", "model_rows", LONG)
def _(spark, sf):
    return dataset.model_features(load(spark, sf, "model_rows"))


@query("p14_minute_of_text", "event_id:i bkt:i", "SELECT event_id, 60 * hour(ts) + minute(ts) AS bkt FROM events")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", cal.minute_of_text(F.date_format("ts", "HH:mm")).alias("bkt"))


@query("p15_w4_forward_labels", "sym:s time:t fwdres10:f fwdres15:f fwdres30:f", "SELECT sym, time, fwdres10, fwdres15, fwdres30 FROM sig", "raw_bars daily", SIG)
def _(spark, sf):
    return _sig(spark, sf)


@query("p16_feed_symbol", "raw:s feed:s", "SELECT p_name || '.B' AS raw, replace(p_name || '.B', '.', '-') AS feed FROM part")
def _(spark, sf):
    raw = F.concat("p_name", F.lit(".B"))
    return spark.read.parquet(f"{sf}/part.parquet").select(raw.alias("raw"), num.feed_symbol(raw).alias("feed"))


@query("p17_month_key", "date:d month:s", "SELECT date, strftime(date, '%Y-%m') AS month FROM factors", "factors")
def _(spark, sf):
    return load(spark, sf, "factors").select("date", cal.month_key("date").alias("month"))


@query("p18_decay", "seq:i w:f", "SELECT seq, pow(0.5, (seq % 250) / 60.0) AS w FROM raw_bars", "raw_bars")
def _(spark, sf):
    return load(spark, sf, "raw_bars").select("seq", num.decay((F.col("seq") % 250).cast("double"), 60).alias("w"))


@query("p19_net_return", "config:s date:d ret:g", "SELECT config, date, (gross - fees - traded * 0.00005) / 1000000 AS ret FROM days", also=DAYS)
def _(spark, sf):
    return _stand_in_days(spark, sf).select("config", "date", num.net_return(0.5e-4).alias("ret"))


# ---- filters

@query("f1_session", "sym:s seq:i time:t", "SELECT sym, seq, t AS time FROM ny WHERE m BETWEEN 570 AND 959", "raw_bars", _NY)
def _(spark, sf):
    return clean.in_session(load(spark, sf, "raw_bars").withColumn("time", cal.to_new_york("ts")))


@query("f2_first_of_each", "sym:s ts:t seq:i open:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym, ts ORDER BY seq) AS rn FROM raw_bars) WHERE rn = 1", "raw_bars")
def _(spark, sf):
    return clean.first_of_each(load(spark, sf, "raw_bars"), ["sym", "ts"])


@query("f3_j2_proxy_return", "sym:s time:t spyret:f", "SELECT r.sym, r.time, p.ret5 AS spyret FROM rets r LEFT JOIN rets p ON p.sym = 'S0' AND p.time = r.time WHERE r.sym <> 'S0'", "raw_bars", RETURNS)
def _(spark, sf):
    return features.with_proxy_return(features.bar_returns(_hours(spark, sf)), PROXY)


@query("f4_f5_complete_cases", "date:d sym:s bkt:i y:f z30:f z60:f lrv:f lvs:f gapc:f", "SELECT * FROM long", "model_rows", LONG)
def _(spark, sf):
    return _long(spark, sf)


@query("f6_f7_lookup", "sym:s time:t close:f", "SELECT sym, time, close FROM bars WHERE date = DATE '2024-01-10' AND sym IN ('S1', 'S3') AND time > TIMESTAMP '2024-01-10 12:00:00'", "raw_bars", BARS)
def _(spark, sf):
    path = scratch_path(spark, "bars")
    files.write_by_date(_bars(spark, sf), path)
    return spark.read.parquet(path).where("date = DATE '2024-01-10' AND sym IN ('S1', 'S3') AND time > TIMESTAMP_NTZ '2024-01-10 12:00:00'")


_SIZES = LONG | {"sizes": "SELECT f.fold, count(*) FILTER (WHERE l.date <= f.train_end) AS n_train, count(*) FILTER (WHERE l.date BETWEEN f.test_start AND f.test_end) AS n_test FROM folds f JOIN long l ON l.date <= f.test_end GROUP BY f.fold"}


@query("f8_f9_fold_sizes", "fold:i n_train:i n_test:i", "SELECT * FROM sizes WHERE n_train >= 1000 AND n_test >= 100", "model_rows", _SIZES)
def _(spark, sf):
    return folds.fold_sizes(_long(spark, sf), _folds(spark, sf), ["label"], 1000, 100)


@query("f10_tradable_days", "date:d n_buckets:i", "SELECT date, count(DISTINCT bkt) AS n_buckets FROM hours WHERE sym <> 'S0' GROUP BY date HAVING count(DISTINCT bkt) >= 10", "raw_bars", HOURS)
def _(spark, sf):
    return simulate.tradable_days(_hours(spark, sf).where(F.col("sym") != PROXY).withColumn("bkt", cal.minute_of_day("time")))


# ---- joins


@query("j3_asof_events", "event_id:i user_id:i price:f", "SELECT l.event_id, l.user_id, r.value AS price FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    right = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("rts")).agg(F.max("value").alias("price"))
    return asof.asof_join(e.where("event_type != 'purchase'"), right, ["user_id"], "ts", "rts", ["price"])


@query("j3_asof_in_chunks", "event_id:i g:i price:f", "SELECT l.event_id, l.g, r.value AS price FROM (SELECT event_id, user_id % 3 AS g, ts FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT user_id % 3 AS g, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON l.g = r.g AND l.ts >= r.ts")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("g", F.col("user_id") % 3)
    right = e.where("event_type = 'purchase'").groupBy("g", F.col("ts").alias("rts")).agg(F.max("value").alias("price"))
    return asof.asof_join(e.where("event_type != 'purchase'"), right, ["g"], "ts", "rts", ["price"], chunk="DAY")


@query("j3_asof_in_chunks_of_rows", "event_id:i g:i price:f", "SELECT l.event_id, l.g, r.value AS price FROM (SELECT event_id, user_id % 3 AS g, ts FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT user_id % 3 AS g, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON l.g = r.g AND l.ts >= r.ts")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("g", F.col("user_id") % 3)
    right = e.where("event_type = 'purchase'").groupBy("g", F.col("ts").alias("rts")).agg(F.max("value").alias("price"))
    return asof.asof_join(e.where("event_type != 'purchase'"), right, ["g"], "ts", "rts", ["price"], chunk=200)


@query("j3_prior_betas", "sym:s date:d mkt:f", "SELECT * FROM used", "raw_bars daily", BARS | BETAS | USED)
def _(spark, sf):
    return asof.prior_betas(_bars(spark, sf).where(F.col("sym") != PROXY), _betas(spark, sf), ["mkt"])


_PANEL = HOURS | BETAS | {"panel": "SELECT h.date, h.sym, h.bkt, h.open, h.close, p.pred, b.mkt AS beta FROM hours h SEMI JOIN preds q ON h.date = q.date LEFT JOIN preds p ON h.date = p.date AND h.sym = p.sym AND h.bkt = p.bkt LEFT JOIN betas b ON h.sym = b.sym AND b.date = (SELECT max(date) FROM betas WHERE date < h.date) WHERE h.sym <> 'S0'"}


@query("j5_simulation_panel", "date:d sym:s bkt:i open:f close:f pred:f beta:f", "SELECT * FROM panel", "raw_bars daily preds", _PANEL)
def _(spark, sf):
    return asof.simulation_panel(_hours(spark, sf), load(spark, sf, "preds"), _betas(spark, sf), PROXY)


@query("j6_test_rows", "fold:i n:i y:f", "SELECT f.fold, count(*) AS n, sum(l.y) AS y FROM long l JOIN folds f ON l.date BETWEEN f.test_start AND f.test_end GROUP BY f.fold", "model_rows", LONG)
def _(spark, sf):
    return folds.test_rows(_long(spark, sf), _folds(spark, sf), ["label"]).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y"))


@query("j7_returns_with_factors", "config:s date:d ret:g mkt_rf:g", "SELECT d.config, d.date, (gross - fees) / 1000000 AS ret, mkt_rf FROM days d JOIN factors f ON d.date = f.date", "factors", DAYS)
def _(spark, sf):
    return _stand_in_days(spark, sf).withColumn("ret", num.net_return()).join(load(spark, sf, "factors"), "date")


_MISSING = {"uni": "SELECT DISTINCT sym FROM raw_bars UNION SELECT 'SX'", "grid": "SELECT sym, m FROM uni, (VALUES ('2023-12'), ('2024-01'), ('2024-02')) AS t(m)"}


@query("j9_v5_s13_missing_months", "sym:s month:s", "SELECT sym, m AS month FROM grid ANTI JOIN (SELECT DISTINCT sym, strftime(ts, '%Y-%m') AS m FROM raw_bars) p USING (sym, m)", "raw_bars", _MISSING)
def _(spark, sf):
    raw = load(spark, sf, "raw_bars").withColumn("month", cal.month_key("ts"))
    return clean.missing_months(clean.with_proxy(raw, "SX"), raw, "2023-12", "2024-02")


# ---- aggregates


@query("a1_resample", "sym:s time:t open:f high:f low:f close:f volume:i ntrades:i vwap:g date:d", "SELECT * FROM hours", "raw_bars", HOURS)
def _(spark, sf):
    return _hours(spark, sf)


_REPORT = _MARKED | {"report": "SELECT strftime(t, '%Y-%m') AS month, count(*) AS raw, count(*) FILTER (WHERE NOT inside) AS dropped_outside, count(*) FILTER (WHERE inside AND rn > 1) AS dropped_dupes, count(*) FILTER (WHERE inside AND rn = 1 AND (coalesce(high < low, false) OR (high IS NULL AND low IS NOT NULL))) AS bad_high_low, count(*) FILTER (WHERE inside AND rn = 1) AS written, count(DISTINCT CASE WHEN inside AND rn = 1 THEN day END) AS days_written FROM marked GROUP BY 1"}


@query("a2_clean_report", "month:s raw:i dropped_outside:i dropped_dupes:i bad_high_low:i written:i days_written:i", "SELECT * FROM report", "raw_bars", _REPORT)
def _(spark, sf):
    return clean.clean_report(load(spark, sf, "raw_bars"))


@query("a3_coverage_by_month", "sym:s month:s n:i", "SELECT sym, strftime(date, '%Y-%m') AS month, count(*) AS n FROM daily GROUP BY 1, 2", "daily")
def _(spark, sf):
    return coverage.coverage_by_month(load(spark, sf, "daily"))


@query("a4_coverage_matrix", "sym:s jan:f feb:f dec:f", "SELECT sym, nullif(count(*) FILTER (WHERE strftime(date, '%Y-%m') = '2020-01'), 0) AS jan, nullif(count(*) FILTER (WHERE strftime(date, '%Y-%m') = '2020-02'), 0) AS feb, nullif(count(*) FILTER (WHERE strftime(date, '%Y-%m') = '2030-12'), 0) AS dec FROM daily GROUP BY sym", "daily")
def _(spark, sf):
    return coverage.coverage_matrix(load(spark, sf, "daily"), ["2020-01", "2020-02", "2030-12"]).toDF("sym", "jan", "feb", "dec")


@query("a5_u2_distinct_buckets", "date:d bkt:i", "SELECT DISTINCT date, bkt FROM preds", "preds")
def _(spark, sf):
    return load(spark, sf, "preds").select("date", "bkt").distinct().orderBy("date", "bkt")


@query("a6_summary", "n_rows:i first_date:d last_date:d n_symbols:i", "SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT sym) AS n_symbols FROM daily", "daily")
def _(spark, sf):
    return coverage.summary(load(spark, sf, "daily"))


@query("a7_last_close", "sym:s close:f", "SELECT sym, arg_max_null(close, time) AS close FROM bars WHERE sym = 'S0' AND date = (SELECT max(date) FROM bars) GROUP BY sym", "raw_bars", BARS)
def _(spark, sf):
    return coverage.last_close(_bars(spark, sf), PROXY)


_LAGS = RESID | {"lags": " UNION ALL ".join(f"SELECT {k} AS lag, ret5 AS a, lag(ret5, {k}) OVER w AS a0, resid AS b, lag(resid, {k}) OVER w AS b0 FROM resid WINDOW w AS (PARTITION BY sym, date ORDER BY time)" for k in range(1, 13))}


@query("a8_lagged_correlation", "lag:i n:i corr_ret5:f corr_resid:f", "SELECT lag, count(*) AS n, corr(a, a0) AS corr_ret5, corr(b, b0) AS corr_resid FROM lags WHERE a IS NOT NULL AND a0 IS NOT NULL AND b IS NOT NULL AND b0 IS NOT NULL GROUP BY lag", "raw_bars daily", _LAGS)
def _(spark, sf):
    return metrics.lagged_correlation(_sig(spark, sf), ["ret5", "resid"])


_STATS = LONG | {"train": "SELECT f.fold, l.* FROM long l JOIN folds f ON l.date <= f.train_end"}


@query("a9_train_statistics", "fold:i feature:s mu:f sd:f", " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, avg({c}) AS mu, CASE WHEN stddev_samp({c}) > 1e-9 THEN stddev_samp({c}) ELSE 1 END AS sd FROM train GROUP BY fold" for c in dataset.FEATURES), "model_rows", _STATS)
def _(spark, sf):
    return linear.train_statistics(_long(spark, sf), _folds(spark, sf), dataset.FEATURES)


def _solved(name: str, source: str, n: int, sides: list[str], tiny: float = 1e-9) -> dict[str, str]:
    """Common tables that solve n linear equations by elimination: source has a_i_j and, for each right side s, s_i. The table `name` also has x_s_i, 0 where a pivot vanishes."""
    out, at = {}, source
    for k in range(n):
        ratio = {i: f"CASE WHEN abs(a_{k}_{k}) > {tiny} THEN a_{i}_{k} / a_{k}_{k} ELSE 0 END" for i in range(n) if i != k}
        new = [f"a_{i}_{j} - ({r}) * a_{k}_{j} AS a_{i}_{j}" for i, r in ratio.items() for j in range(k + 1, n)] + [f"{s}_{i} - ({r}) * {s}_{k} AS {s}_{i}" for i, r in ratio.items() for s in sides]
        out[f"{name}_{k}"] = f"SELECT * REPLACE ({', '.join(new)}) FROM {at}"
        at = f"{name}_{k}"
    out[name] = f"SELECT *, {', '.join(f'CASE WHEN abs(a_{i}_{i}) > {tiny} THEN {s}_{i} / a_{i}_{i} ELSE 0 END AS x_{s}_{i}' for s in sides for i in range(n))} FROM {at}"
    return out


_N = range(len(dataset.FEATURES))
_FITTED = _STATS | {
    "moments": f"SELECT fold, count(*) AS n_train, avg(y) AS b0, {', '.join(f'avg({c}) AS mu_{i}, CASE WHEN var_samp({c}) > 1e-18 THEN stddev_samp({c}) ELSE 1 END AS sd_{i}' for i, c in enumerate(dataset.FEATURES))} FROM train GROUP BY fold",
    "standard": f"SELECT fold, y, {', '.join(f'({c} - mu_{i}) / sd_{i} AS s_{i}' for i, c in enumerate(dataset.FEATURES))} FROM train JOIN moments USING (fold)",
    "normal": f"SELECT fold, {', '.join(f'sum(s_{i} * s_{j}) AS a_{i}_{j}' for i in _N for j in _N)}, {', '.join(f'sum(s_{i} * y) AS b_{i}' for i in _N)} FROM standard GROUP BY fold",
} | _solved("solved", "normal", len(dataset.FEATURES), ["b"])


@query("a10_fit_folds", "label:s fold:i n_train:i b0:f z30:f z60:f", "SELECT 'fwdres10' AS label, fold, n_train, b0, x_b_0 AS z30, x_b_1 AS z60 FROM solved JOIN moments USING (fold)", "model_rows", _FITTED)
def _(spark, sf):
    return linear.fit_folds(_long(spark, sf), _folds(spark, sf), dataset.FEATURES).select("label", "fold", "n_train", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("z30"), F.col("beta")[2].alias("z60"))


_FIXED = "0.25 + 0.5 * (z30 - 0.1) / 2.0 - 0.125 * (z60 + 0.2) / 4.0"


def _scored(spark, sf):
    long = written(_long(spark, sf), "long")
    own = written(folds.walk_forward_folds(long, ["label"]), "folds")
    rows = folds.test_rows(long, own, ["label"])
    models = own.select("label", "fold", F.array(F.lit(0.1), F.lit(-0.2)).alias("mu"), F.array(F.lit(2.0), F.lit(4.0)).alias("sd"), F.array(F.lit(0.25), F.lit(0.5), F.lit(-0.125)).alias("beta"))
    return linear.score(rows, models, ["z30", "z60"])


_SCORED = LONG | {"scored": f"SELECT f.fold, l.*, {_FIXED} AS pred FROM long l JOIN folds f ON l.date BETWEEN f.test_start AND f.test_end"}


@query("a11_score", "fold:i date:d sym:s bkt:i pred:f", "SELECT * FROM scored", "model_rows", _SCORED)
def _(spark, sf):
    return _scored(spark, sf)


@query("a12_oos_r2", "fold:i n_test:i oos_r2:f", "SELECT fold, count(*) AS n_test, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS oos_r2 FROM scored GROUP BY fold", "model_rows", _SCORED)
def _(spark, sf):
    return metrics.oos_r2(_scored(spark, sf), ["fold"])


def _ic_sql(keys: str) -> dict[str, str]:
    rank = "rank() OVER (PARTITION BY fold, date, bkt ORDER BY {0}) + (count(*) OVER (PARTITION BY fold, date, bkt, {0}) - 1) / 2.0"
    return _SCORED | {
        "r": f"SELECT fold, date, bkt, {rank.format('pred')} AS p, {rank.format('y')} AS q FROM scored",
        "c": f"SELECT fold, date, covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0) AS ic FROM r GROUP BY {keys}",
        "d": "SELECT fold, date, avg(ic) AS ic FROM c GROUP BY fold, date",
    }


_IC = "SELECT fold, avg(ic) AS mean_ic, avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0) AS t_ic, count(ic) AS n_days FROM d GROUP BY fold"


@query("a13_w6_rank_ic", "fold:i mean_ic:f t_ic:f n_days:i", _IC, "model_rows", _ic_sql("fold, date"))
def _(spark, sf):
    return metrics.rank_ic(_scored(spark, sf), "pred", "y", ["fold"])


@query("a13_rank_ic_per_bucket", "fold:i mean_ic:f t_ic:f n_days:i", _IC, "model_rows", _ic_sql("fold, date, bkt"))
def _(spark, sf):
    return metrics.rank_ic(_scored(spark, sf), "pred", "y", ["fold"], per="bucket")


@query("a14_head_to_head", "label:s model:s gross:f fees:f", "SELECT 'all' AS label, config AS model, avg(gross) AS gross, avg(fees) AS fees FROM days GROUP BY config", also=DAYS)
def _(spark, sf):
    return metrics.head_to_head(_stand_in_days(spark, sf).withColumn("label", F.lit("all")).withColumnRenamed("config", "model"), ["gross", "fees"])


_SCEN = DAYS | {"net": "SELECT config, s.slip, gross - fees - traded * s.slip AS x, traded FROM days, (VALUES (0.0), (0.5e-4), (1e-4), (2e-4), (5e-4)) AS s(slip)"}


@query("a15_a16_j8_scenarios", "config:s slip:f n_days:i total_millions:f mean:f sharpe:f traded:f", "SELECT config, slip, count(*) AS n_days, sum(x) / 1000000 AS total_millions, avg(x) AS mean, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0) AS sharpe, avg(traded) AS traded FROM net GROUP BY config, slip", also=_SCEN)
def _(spark, sf):
    slips = spark.createDataFrame([(0.0,), (0.5e-4,), (1e-4,), (2e-4,), (5e-4,)], "slip double")
    return metrics.pnl_scenarios(_stand_in_days(spark, sf), slips).withColumn("total_millions", F.col("total") / 1_000_000)


def _attribution_sql(lags: int = 5) -> dict[str, str]:
    """Least squares on four factors with Bartlett-weighted sums of lagged products of x * residual."""
    five = range(5)
    inverse = [f"e{k}" for k in five]
    meat = lambda i, j: f"sum(g_{i} * g_{j})" + "".join(f" + {1 - lag / (lags + 1)!r} * coalesce(sum(g_{i} * l{lag}_{j} + g_{j} * l{lag}_{i}), 0)" for lag in range(1, lags + 1))
    spread = lambda i: " + ".join(f"x_e{i}_{j} * x_e{i}_{k} * m_{j}_{k}" for j in five for k in five)
    return DAYS | {
        "x": "SELECT d.config AS series, d.date, (gross - fees) / 1000000 AS y, 1.0 AS x_0, f.mkt_rf AS x_1, f.smb AS x_2, f.hml AS x_3, f.wml AS x_4 FROM days d JOIN factors f ON d.date = f.date",
        "sums": f"SELECT series, {', '.join(f'sum(x_{i} * x_{j}) AS a_{i}_{j}' for i in five for j in five)}, {', '.join(f'sum(x_{i} * y) AS b_{i}' for i in five)}, {', '.join(f'{float(i == k)} AS e{k}_{i}' for k in five for i in five)} FROM x GROUP BY series",
    } | _solved("ols", "sums", 5, ["b", *inverse]) | {
        "rest": f"SELECT x.*, y - ({' + '.join(f'x_{i} * x_b_{i}' for i in five)}) AS e FROM x JOIN ols USING (series)",
        "products": f"SELECT series, y, e, {', '.join(f'x_{i} * e AS g_{i}' for i in five)}, date FROM rest",
        "lagged": f"SELECT *, {', '.join(f'lag(g_{i}, {lag}) OVER w AS l{lag}_{i}' for lag in range(1, lags + 1) for i in five)} FROM products WINDOW w AS (PARTITION BY series ORDER BY date)",
        "meat": f"SELECT series, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, {', '.join(f'{meat(i, j)} AS m_{i}_{j}' for i in five for j in five)} FROM lagged GROUP BY series",
        "told": f"SELECT series, n, x_b_0 * 252 AS alpha_annual, x_b_0 / sqrt({spread(0)}) AS alpha_t, r2, x_b_1 AS b_mkt_rf, x_b_1 / sqrt({spread(1)}) AS t_mkt_rf FROM meat JOIN ols USING (series)",
    }


@query("a17_attribution", "series:s n:i alpha_annual:f alpha_t:f r2:f b_mkt_rf:f t_mkt_rf:f", "SELECT * FROM told", "factors", _attribution_sql())
def _(spark, sf):
    return attribution.attribute(_stand_in_days(spark, sf).select(F.col("config").alias("series"), "date", num.net_return().alias("ret")), load(spark, sf, "factors"))


@query("a18_proxy_against_market", "n:i corr:f", "SELECT count(*) AS n, corr(ret, m) AS corr FROM (SELECT d.ret, f.mkt_rf + f.rf AS m FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM daily WHERE sym = 'S0') d JOIN factors f ON d.date = f.date WHERE d.ret IS NOT NULL)", "daily factors")
def _(spark, sf):
    return coverage.proxy_against_market(load(spark, sf, "daily"), load(spark, sf, "factors"), PROXY)


_ROLL = BARS | {"up": "SELECT sym, date, arg_max_null(close, time) AS intraday FROM bars GROUP BY sym, date"}


@query("a18_intraday_against_daily", "sym:s n:i corr:f", "SELECT u.sym, count(*) AS n, covar_pop(intraday, close) / nullif(stddev_pop(intraday) * stddev_pop(close), 0) AS corr FROM up u JOIN daily d ON u.sym = d.sym AND u.date = d.date GROUP BY u.sym", "raw_bars daily", _ROLL)
def _(spark, sf):
    return coverage.intraday_against_daily(_bars(spark, sf), load(spark, sf, "daily"))


def _beta_sql(window: int = 250, min_obs: int = 120, half_life: float = 60.0, ridge: float = 1e-4) -> dict[str, str]:
    """The regressions as self-joined weighted sums over each window's rows, and their normal equations."""
    five, w = range(5), f"pow(0.5, (t.n - s.n) / {half_life})"
    x = ["1.0", "s.mkt_rf", "s.smb", "s.hml", "s.wml"]
    return _EXCESS | {
        "nth": "SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date) - 1 AS n FROM ex",
        "weighted": f"SELECT t.sym, t.date, count(*) AS nobs, sum({w}) AS sw, sum({w} * s.exret) AS swy, sum({w} * s.exret * s.exret) AS yy, {', '.join(f'sum({w} * {x[i]} * {x[j]}) AS p_{i}_{j}' for i in five for j in five)}, {', '.join(f'sum({w} * {x[i]} * s.exret) AS q_{i}' for i in five)} FROM nth t JOIN nth s ON t.sym = s.sym AND s.n BETWEEN t.n - {window - 1} AND t.n WHERE t.n >= {min_obs - 1} GROUP BY t.sym, t.date",
        "normal": f"SELECT *, {', '.join(f'p_{i}_{j} + {ridge if i == j else 0.0} AS a_{i}_{j}' for i in five for j in five)}, {', '.join(f'q_{i} AS b_{i}' for i in five)} FROM weighted",
    } | _solved("solved", "normal", 5, ["b"], 0.0) | {
        "fits": f"SELECT date, sym, x_b_0 AS alpha, x_b_1 AS mkt, x_b_2 AS smb, x_b_3 AS hml, x_b_4 AS wml, nobs, CASE WHEN yy - swy * swy / sw > 0 THEN 1 - (yy - 2 * ({' + '.join(f'x_b_{i} * q_{i}' for i in five)}) + {' + '.join(f'x_b_{i} * x_b_{j} * p_{i}_{j}' for i in five for j in five)}) / (yy - swy * swy / sw) ELSE 0 END AS r2 FROM solved",
    }


@query("a19_w9_median_fit", "median_r2:f n_fits:i", "SELECT median(r2) AS median_r2, count(*) AS n_fits FROM fits", "daily factors", _beta_sql())
def _(spark, sf):
    return exposures.median_fit(exposures.rolling_betas(load(spark, sf, "daily"), load(spark, sf, "factors")))


# ---- windows


@query("w2_w3_trailing", "sym:s time:t cumres30:f cumres60:f rv60:f", "SELECT sym, time, cumres30, cumres60, rv60 FROM sig", "raw_bars daily", SIG)
def _(spark, sf):
    return _sig(spark, sf)


@query("w8_cumulative", "config:s date:d cumulative:f", "SELECT config, date, sum(gross) OVER (PARTITION BY config ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative FROM days", also=DAYS)
def _(spark, sf):
    return metrics.cumulative(_stand_in_days(spark, sf), "gross", ["config"])


@query("w8_cumulative_in_chunks", "config:s date:d cumulative:f", "SELECT config, date, sum(gross) OVER (PARTITION BY config ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative FROM days", also=DAYS)
def _(spark, sf):
    return metrics.cumulative(_stand_in_days(spark, sf), "gross", ["config"], target=200)


@query("w9_h1_rolling_betas", "date:d sym:s alpha:f mkt:f smb:f hml:f wml:f r2:f nobs:i", "SELECT * FROM fits", "daily factors", _beta_sql())
def _(spark, sf):
    return exposures.rolling_betas(load(spark, sf, "daily"), load(spark, sf, "factors"))


@query("w9_regression_windows", "date:d sym:s nobs:i", "SELECT sym, date, least(n + 1, 250) AS nobs FROM nth WHERE n >= 119", "daily factors", _beta_sql())
def _(spark, sf):
    return exposures.rolling_betas(load(spark, sf, "daily"), load(spark, sf, "factors"))


@query("w10_walk_forward_folds", "fold:i train_end:d test_start:d test_end:d", "SELECT * FROM folds", "model_rows", LONG)
def _(spark, sf):
    return _folds(spark, sf)


@query("w11_validation_cut", "cut:d", "SELECT date AS cut FROM ranked WHERE nth - 1 = CAST(floor(0.85 * (SELECT count(*) FROM dates)) AS BIGINT)", "model_rows", LONG)
def _(spark, sf):
    return folds.validation_cut(_long(spark, sf), ["label"])


@query("w12_t2_extremes", "date:d sym:s bkt:i from_top:i from_bottom:i is_top:b is_bottom:b", "SELECT *, a AS from_top, z AS from_bottom, a <= 2 AS is_top, z <= 2 AS is_bottom FROM (SELECT *, row_number() OVER (PARTITION BY date, bkt ORDER BY pred DESC, sym) AS a, row_number() OVER (PARTITION BY date, bkt ORDER BY pred, sym DESC) AS z FROM preds)", "preds")
def _(spark, sf):
    return simulate.extremes(load(spark, sf, "preds"), 2)


# ---- sorts, samples, sets


@query("t1_sorted_daily", "sym:s date:d close:f", "SELECT sym, date, close FROM daily", "daily")
def _(spark, sf):
    return load(spark, sf, "daily").orderBy("sym", "date")


@query("t3_seeded_sample", "fold:i date:d sym:s bkt:i y:f")
def _(spark, sf):
    rows = folds.test_rows(_long(spark, sf), _folds(spark, sf), ["label"])
    return dataset.seeded_sample(rows, 500, 7, ["date", "sym", "bkt", "y", "z30", "z60", "lvs"], ["label", "fold"])


_SAMPLED = LONG | {"population": "SELECT fold, count(*) AS n FROM long JOIN folds ON long.date BETWEEN test_start AND test_end GROUP BY fold"}


def dealt_anew(rows):
    """rows in another partitioning, whose number of tasks grows with their bytes."""
    return rows.hint("rebalance")


@query("t3_sample_audit", "fold:i n:i n_members:i n_over:i n_other_seed:i n_same:i", "SELECT fold, least(500, n) AS n, least(500, n) AS n_members, 0 AS n_over, least(500, n) AS n_other_seed, least(500, n) AS n_same FROM population", "model_rows", _SAMPLED)
def _(spark, sf):
    """Sizes, membership and copies of the sample, by another way than it is drawn; a repartitioned table gives the same one."""
    rows = written(folds.test_rows(_long(spark, sf), _folds(spark, sf), ["label"]), "population")
    draw = lambda r, seed: dataset.seeded_sample(r, 500, seed, ["date", "sym", "bkt", "y", "z30", "z60", "lvs"], ["label", "fold"])
    parts = {"sample": draw(rows, 7), "other": draw(rows, 8), "again": draw(dealt_anew(rows), 7), "all": rows}
    counts = None
    for name, r in parts.items():
        one = r.select(*rows.columns, *[F.lit(int(k == name)).alias(k) for k in parts])
        counts = one if counts is None else counts.unionByName(one)
    each = counts.groupBy(*rows.columns).agg(*[F.sum(k).alias(k) for k in parts])
    over, members = F.greatest(F.col("sample") - F.col("all"), F.lit(0)), F.least("sample", "all")
    return each.groupBy("fold").agg(F.sum("sample").alias("n"), F.sum(members).alias("n_members"), F.sum(over).alias("n_over"), F.sum("other").alias("n_other_seed"), F.sum(F.least("sample", "again")).alias("n_same"))


@query("u1_concatenate", "sym:s n:i", "SELECT sym, count(*) AS n FROM (SELECT sym FROM daily UNION ALL SELECT sym FROM daily WHERE volume > 2) GROUP BY sym", "daily")
def _(spark, sf):
    d = load(spark, sf, "daily")
    return d.unionByName(d.where("volume > 2")).groupBy("sym").agg(F.count("*").alias("n"))


@query("u3_common_dates", "date:d", "SELECT DISTINCT date FROM daily INTERSECT SELECT date FROM factors", "daily factors")
def _(spark, sf):
    return load(spark, sf, "daily").select("date").intersect(load(spark, sf, "factors").select("date"))


@query("u4_with_proxy", "sym:s", "SELECT DISTINCT sym FROM preds UNION SELECT 'S0'", "preds")
def _(spark, sf):
    return clean.with_proxy(load(spark, sf, "preds"), PROXY)


# ---- audits


@query("v1_conservation", "month:s conserved:b", "SELECT month, raw - dropped_outside - dropped_dupes = written AS conserved FROM report", "raw_bars", _REPORT)
def _(spark, sf):
    return clean.conserved(clean.clean_report(load(spark, sf, "raw_bars")))


@query("v2_weekends", "n_rows:i n_days:i weekend_rows:i", "SELECT count(*) AS n_rows, count(DISTINCT date) AS n_days, count(*) FILTER (WHERE dayofweek(date) IN (0, 6)) AS weekend_rows FROM bars", "raw_bars", BARS)
def _(spark, sf):
    return clean.weekend_audit(_bars(spark, sf))


@query("v3_no_look_ahead", "n_days:i look_ahead:i matched:i", "SELECT count(*) AS n_days, count(*) FILTER (WHERE bdate >= date) AS look_ahead, count(bdate) AS matched FROM used", "raw_bars daily", BARS | BETAS | USED)
def _(spark, sf):
    return features.look_ahead_audit(_bars(spark, sf).where(F.col("sym") != PROXY), _betas(spark, sf))


@query("v4_duplicates", "sym:s ts:t n:i", "SELECT sym, ts, count(*) AS n FROM raw_bars GROUP BY sym, ts HAVING count(*) > 1", "raw_bars")
def _(spark, sf):
    return clean.duplicate_audit(load(spark, sf, "raw_bars"), ["sym", "ts"])


# ---- whole workloads


@query("h3_simulate", "config:s date:d gross:f fees:f traded:f sold:f trades:i")
def _(spark, sf):
    return _backtest(spark, sf)[0]


@query("h4_backtest_attribution", "series:s n:i alpha_annual:f r2:f")
def _(spark, sf):
    return _backtest(spark, sf)[1]


_RANK = "rank() OVER (PARTITION BY fold, date, bkt ORDER BY {0}) + (count(*) OVER (PARTITION BY fold, date, bkt, {0}) - 1) / 2.0"
_WALK = _FITTED | _SIZES | {
    "predicted": f"SELECT f.fold, l.*, m.b0 + {' + '.join(f'x_b_{i} * ({c} - mu_{i}) / sd_{i}' for i, c in enumerate(dataset.FEATURES))} AS pred FROM long l JOIN folds f ON l.date BETWEEN f.test_start AND f.test_end JOIN moments m ON m.fold = f.fold JOIN solved s ON s.fold = f.fold JOIN sizes z ON z.fold = f.fold AND z.n_train >= 1000 AND z.n_test >= 100",
    "skill": "SELECT fold, count(*) AS n_test, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS oos_r2 FROM predicted GROUP BY fold",
    "r": f"SELECT fold, date, {_RANK.format('pred')} AS p, {_RANK.format('y')} AS q FROM predicted",
    "d": "SELECT fold, date, covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0) AS ic FROM r GROUP BY fold, date",
    "ic": _IC,
}


@query("job_store_predictions", "date:d sym:s bkt:i pred:f", "SELECT date, sym, bkt, CAST(printf('%.8g', pred) AS DOUBLE) AS pred FROM predicted", "model_rows", _WALK)
def _(spark, sf):
    return panel.store_predictions(load(spark, sf, "model_rows"), "fwdres10", scratch_path(spark, "predictions"), min_train=1000, min_test=100)


_RAW_REPORT = "SELECT month, raw, dropped_outside, dropped_dupes, bad_high_low, written, days_written FROM report"


@query("job_build_store", "month:s raw:i dropped_outside:i dropped_dupes:i bad_high_low:i written:i days_written:i", _RAW_REPORT, "raw_bars", _REPORT)
def _(spark, sf):
    raw, store = scratch_path(spark, "raw"), scratch_path(spark, "store")
    files.write_raw_bars(load(spark, sf, "raw_bars"), raw)
    return panel.build_store(spark, raw, store)


@query("job_build_signals", _SIGS, "SELECT s.sym, s.time, ret5, spyret, resid, cumres30, cumres60, rv60, s.volume / nullif(vbase, 0) AS vsurp, first_value(s.open) OVER (PARTITION BY s.sym, s.date ORDER BY s.time) / nullif(pclose, 0) - 1 AS gap, fwdres10, fwdres15, fwdres30, s.date FROM sig s LEFT JOIN base b ON s.sym = b.sym AND s.date = b.date AND s.bkt = b.bkt LEFT JOIN pc ON s.sym = pc.sym AND s.date = pc.date", "raw_bars daily factors", _beta_sql() | {"betas": "SELECT date, sym, mkt FROM fits"} | {k: v for k, v in _GAPS.items() if k != "betas"})
def _(spark, sf):
    raw, store = scratch_path(spark, "raw"), scratch_path(spark, "store")
    files.write_raw_bars(load(spark, sf, "raw_bars"), raw)
    panel.build_store(spark, raw, store, resume=True, session=None, utc=True)
    panel.build_store(spark, raw, store, resume=True, session=None, utc=True)  # nothing is left to load
    panel.build_signals(spark, store, load(spark, sf, "daily"), load(spark, sf, "factors"), 60, CONFIG)
    return snapshots.read(spark, f"{store}/sig")


@query("walk_forward", "label:s fold:i n_test:i oos_r2:f mean_ic:f t_ic:f coef_z30:f", "SELECT 'fwdres10' AS label, skill.fold, skill.n_test, oos_r2, mean_ic, t_ic, x_b_0 AS coef_z30 FROM skill LEFT JOIN ic USING (fold) JOIN solved USING (fold)", "model_rows", _WALK)
def _(spark, sf):
    return panel.walk_forward(load(spark, sf, "model_rows"), ["fwdres10"], min_train=1000, min_test=100)[1]


@query("minimum_slice", "sym:s time:t ret5:f spyret:f cum6:f", "SELECT r.sym, r.time, r.ret5, p.ret5 AS spyret, sum(coalesce(r.ret5, 0)) OVER (PARTITION BY r.sym, r.date ORDER BY r.time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS cum6 FROM rets r LEFT JOIN rets p ON p.sym = 'S0' AND p.time = r.time WHERE r.sym <> 'S0'", "raw_bars", RETURNS)
def flagship(spark, sf):
    hours = written(_hours(spark, sf), "hours")
    rows = features.with_proxy_return(features.bar_returns(hours), PROXY, hours)
    return rows.withColumn("cum6", F.sum(F.coalesce("ret5", F.lit(0.0))).over(features.in_day().rowsBetween(-5, 0)))
