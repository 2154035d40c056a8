"""Readers and writers of the panel's files."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.calendar import minute_of_text
from tapewright.sources import schemas, store


def _none(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def named(text: str) -> str:
    """A symbol as the name of a file or folder: itself, but for `/` and `%`."""
    return text.replace("%", "%25").replace("/", "%2F")


def _symbol(name: F.Column) -> F.Column:
    return F.replace(F.replace(name, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def _place(path: F.Column) -> F.Column:
    """A file's path as it is: Spark gives it encoded as in an address."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def raw_bar_files(spark: SparkSession, root: str, months: list[str] | None = None, symbols: list[str] | None = None) -> list[tuple[str, str, str, int, int]]:
    """(sym, month, path, bytes, time of change) of files `root/<symbol>/<yyyy-MM>.csv[.gz]`; others aren't listed, nor is any opened."""
    month = "[0-9][0-9][0-9][0-9]-[0-9][0-9]" if months is None else store.one_of(sorted(set(months)))
    sym = "*" if symbols is None else store.one_of(sorted({named(x) for x in symbols}))
    if months == [] or symbols == []:
        return []
    out = []
    for suffix in (".csv", ".csv.gz"):
        for path, size, changed in store.found(spark, f"{root.rstrip('/')}/{sym}/{month}{suffix}"):
            folder, name = path.rsplit("/", 2)[1:]
            out.append((folder.replace("%2F", "/").replace("%25", "%"), name.removesuffix(suffix), path, size, changed))
    return sorted(out)


def read_raw_bars(spark: SparkSession, root: str, months: list[str] | None = None, symbols: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Minute bars from `root/<symbol>/<yyyy-MM>.csv[.gz]`, symbol and month taken from the path.

    months, symbols: only these; all if None. paths: these files, instead of a listing. Files that aren't asked for are neither
    opened nor given to a task, and a later condition on sym or month prunes files as well. Symbols without a file for a month
    have no rows for it, and without any file the result is empty. A cell that can't be read is null. seq orders rows as the
    files do, by month and line, whatever the partitions: it is the same in every reading.

    A task holds one file whole (a symbol's month of minutes has 44,640 lines at most); Spark packs small files into tasks by
    their bytes (spark.sql.files.maxPartitionBytes, openCostInBytes).
    """
    if paths is None:
        paths = [p for _, _, p, _, _ in raw_bar_files(spark, root, months, symbols)]
    if not paths:
        return _none(spark, schemas.RAW_BARS).withColumn("month", F.lit(None).cast("string"))
    path = _place(F.col("_metadata.file_path"))
    texts = spark.read.text([store.literal(p) for p in paths], wholetext=True)
    texts = texts.select(_symbol(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)).alias("sym"), F.regexp_extract(path, r"/([^/]+?)\.csv(\.gz)?$", 1).alias("month"), F.endswith(path, F.lit(".gz")).alias("gz"), "value")
    lines = texts.select("sym", "month", "gz", F.posexplode(F.split("value", "\n")).alias("line", "text")).where((F.col("line") > 0) & (F.rtrim(F.col("text")) != ""))
    cells = F.from_csv(F.rtrim(F.col("text"), F.lit("\r")), schemas.RAW_BARS_CSV.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE"})
    month = F.try_to_number(F.replace("month", F.lit("-"), F.lit("")), F.lit("999999")).cast("long")
    seq = month * (1 << 32) + F.when(F.col("gz"), 1 << 31).otherwise(0) + F.col("line")
    out = lines.select("sym", "month", cells.alias("c"), seq.alias("seq")).select("sym", "month", "c.*", "seq")
    return out.withColumn("ts", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + (ts - TIMESTAMP'1970-01-01T00:00:00Z')"))  # UTC whatever the session's zone


def _told(column: str) -> F.Column:
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit(f"a row without {column} has no file")))


def _write_named(rows: DataFrame, root: str, keys: list[str], suffix: str, **options) -> None:
    """CSV files named by their keys, `root/<key>/<key><suffix>`: written beside, then renamed; files of the same names are replaced."""
    spark, staged = rows.sparkSession, f"{root}/_staged-{uuid.uuid4().hex}"
    writer = rows.write.partitionBy(*keys).option("header", True).option("maxRecordsPerFile", 0)
    try:
        writer.options(**options).csv(staged)
        moves = []
        for path, _, _ in store.found(spark, f"{staged}/{'/'.join(f'{k}=*' for k in keys)}/part-*"):
            labels = [unquote(part.split("=", 1)[1]) for part in path.split("/")[-1 - len(keys) : -1]]
            moves.append((path, f"{root}/{'/'.join(map(named, labels))}{suffix}"))
        store.move(spark, moves)
    finally:
        store.remove(spark, staged)


def write_raw_bars(bars: DataFrame, root: str) -> None:
    """Raw bars (ts in UTC) as `root/<symbol>/<yyyy-MM>.csv.gz`, rows in order of seq: what read_raw_bars reads. Files that are there are replaced."""
    rows = bars.select(_told("sym").alias("sym"), F.date_format(_told("ts"), "yyyy-MM").alias("month"), "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), *[f.name for f in schemas.RAW_BARS_CSV.fields[1:]])
    _write_named(rows.repartition("sym", "month").sortWithinPartitions("sym", "month", "seq").drop("seq"), root.rstrip("/"), ["sym", "month"], ".csv.gz", compression="gzip")


def write_daily(daily: DataFrame, root: str) -> None:
    """Daily prices as `root/<symbol>.csv`, in order of date: what read_daily reads. Files that are there are replaced."""
    rows = daily.select(_told("sym").alias("sym"), *[f.name for f in schemas.DAILY_CSV.fields])
    _write_named(rows.repartition("sym").sortWithinPartitions("sym", "date"), root.rstrip("/"), ["sym"], ".csv")


def select_months(bars: DataFrame, months: list[str] | None, time: str = "ts") -> DataFrame:
    """Rows of the given months ('yyyy-MM'), or all."""
    return bars if months is None else bars.where(F.date_format(time, "yyyy-MM").isin(months))


def read_daily(spark: SparkSession, root: str) -> DataFrame:
    """Daily prices from `root/<symbol>.csv`, in order of symbol and date."""
    pattern = f"{root.rstrip('/')}/*.csv"
    if not store.exists(spark, pattern):
        return _none(spark, schemas.DAILY_CSV).withColumn("sym", F.lit(None).cast("string"))
    read = spark.read.schema(schemas.DAILY_CSV).option("header", True).csv(pattern)
    return read.select(_symbol(F.regexp_extract(_place(F.col("_metadata.file_path")), r"/([^/]+)\.csv$", 1)).alias("sym"), "*").orderBy("sym", "date")


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FACTORS).option("header", True).csv(path)


def parse_factor_text(texts: DataFrame, names: list[str], missing: float = -0.99) -> DataFrame:
    """(date, *names) from whole factor files (column `value`): the first run of lines that begin with yyyyMMDD and a comma.

    Percent become decimals; a row with a value at or below `missing` goes.
    """
    lines = texts.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"), F.xxhash64("value").alias("file"))
    dated = F.col("line").rlike(r"^\s*\d{8}\s*,")
    ends = lines.groupBy("file").agg(F.min(F.when(dated, F.col("at"))).alias("first"))
    stops = lines.join(ends, "file").where(~dated & (F.col("at") > F.col("first"))).groupBy("file").agg(F.min("at").alias("stop"))
    block = lines.join(ends, "file").join(stops, "file", "left").where(dated & (F.col("at") >= F.col("first")) & (F.col("at") < F.coalesce("stop", F.lit(2**31 - 1))))
    cells = F.split("line", ",")
    values = [(F.expr(f"try_cast(trim(get(cells, {i + 1})) AS double)") / 100).alias(n) for i, n in enumerate(names)]
    out = block.withColumn("cells", cells).select(F.to_date(F.trim(F.get("cells", F.lit(0))), "yyyyMMdd").alias("date"), *values)
    ok = F.lit(True)
    for n in names:
        ok = ok & F.coalesce(F.col(n) > missing, F.lit(False))
    return out.where(ok)


def read_factor_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return parse_factor_text(spark.read.text(path, wholetext=True), names)


def merge_factors(three: DataFrame, momentum: DataFrame) -> DataFrame:
    """Two factor tables on the dates that both have."""
    return three.join(momentum, "date").orderBy("date")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with the bucket 'HH:MM' as minute of day, in order of date, symbol and bucket."""
    return spark.read.schema(schemas.PREDS_CSV).option("header", True).csv(path).withColumn("bkt", minute_of_text("bkt")).orderBy("date", "sym", "bkt")


def write_by_date(df: DataFrame, path: str, *order: str, rows_a_file: int | None = None) -> None:
    """Parquet partitioned by date, each file in the given order; dates that are there already are replaced, others stay.

    Rows are dealt out by ranges of date and order, whose bounds Spark samples from them: small dates share a task, and a date
    of more rows than a task's share is several files, each a range of the order (of symbols, first of all). rows_a_file: about
    so many rows to a task, by a count of all; else there are spark.sql.shuffle.partitions tasks, which Spark joins where they
    are small.
    """
    sort = order or ("sym", "time")
    keys = ["date", *sort]
    dealt = df.repartitionByRange(*keys) if rows_a_file is None else df.repartitionByRange(max(1, -(-df.count() // rows_a_file)), *keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_flat(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def predictions_text(preds: DataFrame) -> DataFrame:
    """As predictions are exported: 'HH:MM' buckets, eight significant digits."""
    return preds.select("date", "sym", F.format_string("%02d:%02d", F.floor(F.col("bkt") / 60).cast("int"), F.col("bkt") % 60).alias("bkt"), F.format_string("%.8g", "pred").alias("pred"))


def day_results_text(days: DataFrame) -> DataFrame:
    """As day results are exported: days since 2000-01-01, money with two decimals."""
    money = [F.round(c, 2).alias(c) for c in ("gross", "fees", "traded", "sold")]
    return days.select(F.datediff("date", F.lit("2000-01-01").cast("date")).alias("qdate"), *money, "trades")


def export_dataset(sig: DataFrame) -> DataFrame:
    """Rows a model may see: both trailing features that matter there, and a positive volatility."""
    from tapewright.functions.calendar import minute_of_day

    rows = sig.where("cumres30 IS NOT NULL AND rv60 IS NOT NULL AND rv60 > 0")
    return rows.select("date", "sym", minute_of_day("time").alias("bkt"), "cumres30", "cumres60", "rv60", "vsurp", "gap", "fwdres10", "fwdres15", "fwdres30")
