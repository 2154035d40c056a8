"""What several operators share: scratch tables, shipped files, byte-balanced batches."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that an operator's memo of words may take in a worker process before it is emptied.
MEMO_MOST = 32 << 20
#: Rows of texts in an Arrow batch: both sides hold a batch whole, and by_bytes divides it further.
ARROW_ROWS = 500
#: New words that a trained model looks at at once.
WORDS_AT_ONCE = 8192
_resident: dict = {}
_own_folder: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, as in tests on one machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        found = _own_folder[0]
    return found.rstrip("/")


class Memo(dict):
    """Values by key in a worker process, with the bytes they take; `room` empties it beyond `most`, so memory is bounded whatever the keys."""

    def __init__(self, most: int = MEMO_MOST):
        super().__init__()
        self.most, self.held = most, 0

    def fill(self, keys: list, values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.held += 100 * len(keys) + sum(map(sys.getsizeof, keys)) + sum(map(sys.getsizeof, values))

    def room(self) -> bool:
        """True if it had to be emptied."""
        full = self.held > self.most
        if full:
            self.clear()
            self.held = 0
        return full


def resident(key: tuple, build: Callable[[], object]):
    """What an operator keeps in a worker process between tasks (its model and memos). Workers are used again by later stages: another operator's is let go first."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _hand_back()
        _resident[key] = build()
    return _resident[key]


def _hand_back() -> None:
    """Free memory of this process goes back to the system, where the C library can do that."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder, read again: it cuts the lineage, and a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steady(df: DataFrame, name: str) -> DataFrame:
    """df, if its rows come straight from files, so that every reading, and every task that is run again, has the same rows in the same order; else df written."""
    nodes, left = set(), [df._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        nodes.add(node.getClass().getSimpleName())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return df if nodes <= {"LogicalRelation", "SubqueryAlias", "Project", "Filter"} else written(df, name)


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """rows with the columns of their class (null for rows without one). classes: a row for each value of keys, with its number of rows n.

    Classes of more rows than a quarter of a partition's even share meet their rows by broadcast: there are under four of them
    a shuffle partition. The others meet in a shuffle, in which no key stands out; rows with a null key don't take part in it.
    """
    share = total / (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large, small = classes.where(F.col(n) > share), classes.where(F.col(n) <= share)
    rest, there = rows.columns, F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    sided = rows.where(there).join(F.broadcast(large), keys, "left")
    shuffled = sided.where(F.col(n).isNull()).select(rest).join(small, keys, "left")
    return sided.where(F.col(n).isNotNull()).unionByName(shuffled).unionByName(rows.where(~there), allowMissingColumns=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, path: str, limit: int = 64 << 20):
    """A vocabulary file as a broadcast of its bytes, so that executors need no such file; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} is over {limit} bytes: too large to broadcast")
    return spark.sparkContext.broadcast(data)


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text, mod 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def by_bytes(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (one row at least), null texts as empty ones."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)
    _hand_back()  # the worker waits for other tasks, maybe of a stage without Python


def row_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (tuples with bytes among them) in record batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 16 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > most:
            yield _record_batch(held, schema)
            held, size = [], 0
    if held:
        yield _record_batch(held, schema)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """From now on at most ARROW_ROWS rows in this session's Arrow batches: with Spark's default of 10,000 a whole partition of texts is one batch, held in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()
