"""Date-partitioned tables that change all at once.

A load writes its rows into a folder of its own, `data/load=<id>/date=<date>/`, which no reader looks at. Then a manifest, a
small text that names the folder of every date, appears under the next number by one rename: readers take the newest manifest,
so they see a load whole or not at all, and a load that dies before that leaves the table as it was. Older manifests keep
working until vacuum() removes what they alone refer to. One writer at a time: a second one finds the number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.sources import store
from tapewright.sources.files import write_by_date


@dataclass(frozen=True)
class Snapshot:
    """version 0 has nothing. folders: date (yyyy-MM-dd) to load. schema: of the table, as JSON. sources: loads that list the files they read."""

    version: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    schema: dict | None = None
    sources: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Staged:
    load: str
    dates: list[str]
    schema: dict


def current(spark: SparkSession, path: str) -> Snapshot:
    manifests = [p for p, _, _ in store.found(spark, f"{path}/manifests/*.json")]
    return Snapshot(**json.loads(store.text_of(spark, manifests[-1]))) if manifests else Snapshot()


def read(spark: SparkSession, path: str, dates: list[str] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
    """The table as of now (or of a snapshot), or only the given dates of it, of which no other folder is listed."""
    from pyspark.sql.types import StructType

    at = snapshot or current(spark, path)
    if at.schema is None:
        raise FileNotFoundError(f"{path} has no snapshot")
    wanted = at.folders if dates is None else {d: at.folders[d] for d in dates if d in at.folders}
    schema = StructType.fromJson(at.schema)
    if not wanted:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/load={load}/date={d}" for d, load in sorted(wanted.items())]
    rows = spark.read.schema(schema.add("load", "string") if "load" not in schema.names else schema).option("basePath", f"{path}/data").parquet(*folders)
    return rows.select(*StructType.fromJson(at.schema).names)


def stage(rows: DataFrame, path: str, *order: str, rows_a_file: int | None = None, sources: DataFrame | None = None) -> Staged:
    """Writes rows (with a date) where no reader looks yet, and the list of the files they come from."""
    load = uuid.uuid4().hex
    folder = f"{path}/data/load={load}"
    write_by_date(rows, folder, *order, rows_a_file=rows_a_file)
    if sources is not None:
        sources.write.parquet(f"{path}/sources/load={load}")
    dates = [p.rsplit("date=", 1)[1] for p, _, _ in store.found(rows.sparkSession, f"{folder}/date=*")]
    if "__HIVE_DEFAULT_PARTITION__" in dates:
        raise ValueError("rows without a date have no place in the table")
    return Staged(load, dates, json.loads(rows.schema.json()))


def commit(spark: SparkSession, path: str, staged: Staged, before: Snapshot, gone: list[str] | None = None, with_sources: bool = False) -> Snapshot:
    """The next snapshot: staged dates take the place of theirs, dates in `gone` (all if None) that weren't staged go, others stay."""
    kept = {} if gone is None else {d: f for d, f in before.folders.items() if d not in set(gone)}
    sources = [*(before.sources if gone is not None else []), *([staged.load] if with_sources else [])]
    after = Snapshot(before.version + 1, kept | dict.fromkeys(staged.dates, staged.load), staged.schema, sources)
    store.put_new(spark, f"{path}/manifests/{after.version:010d}.json", json.dumps(after.__dict__))
    return after


def replace(rows: DataFrame, path: str, *order: str, rows_a_file: int | None = None) -> Snapshot:
    """The table becomes these rows. They may be read from the table itself."""
    before = current(rows.sparkSession, path)
    return commit(rows.sparkSession, path, stage(rows, path, *order, rows_a_file=rows_a_file), before)


def source_files(spark: SparkSession, path: str, snapshot: Snapshot) -> DataFrame | None:
    """What stage() was told of the files that a snapshot's rows come from."""
    if not snapshot.sources:
        return None
    return spark.read.parquet(*[f"{path}/sources/load={x}" for x in snapshot.sources])


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests but the newest `keep`, and the loads that those left don't refer to; returns how many loads went."""
    manifests = [p for p, _, _ in store.found(spark, f"{path}/manifests/*.json")]
    used: set[str] = set()
    for p in manifests[-keep:]:
        at = Snapshot(**json.loads(store.text_of(spark, p)))
        used |= set(at.folders.values()) | set(at.sources)
    for p in manifests[:-keep]:
        store.remove(spark, p)
    loads = {p.rsplit("load=", 1)[1] for kind in ("data", "sources") for p, _, _ in store.found(spark, f"{path}/{kind}/load=*")}
    for x in loads - used:
        for kind in ("data", "sources"):
            store.remove(spark, f"{path}/{kind}/load={x}")
    return len(loads - used)


def dates_of(rows: DataFrame) -> list[str]:
    """Distinct dates, as many as a calendar has."""
    return [r[0] for r in rows.where("date IS NOT NULL").select(F.col("date").cast("string")).distinct().collect()]


def in_months(dates: list[str], months: list[str]) -> list[str]:
    return [d for d in dates if d[:7] in set(months)]
