"""Paths of whatever store Spark can read: listing, checked renames, small texts. All through Hadoop's file systems, none through local files."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Characters that mean something in a glob.
_SPECIAL = re.compile(r"[\\*?\[\]{},^]")


def literal(text: str) -> str:
    """text as a glob that matches only itself."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def one_of(texts: list[str]) -> str:
    """A glob of any of the texts."""
    return "{" + ",".join(map(literal, texts)) + "}" if len(texts) != 1 else literal(texts[0])


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def found(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of what a glob matches, in order of path."""
    statuses = _store(spark, pattern).globStatus(_path(spark, pattern)) or []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in statuses)


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(found(spark, pattern))


def move(spark: SparkSession, moves: list[tuple[str, str]], threads: int = 16) -> None:
    """Renames each first path to the second one, replacing a file that is there. A rename that doesn't happen is an error."""
    if len({to for _, to in moves}) < len(moves):
        raise ValueError("several files for one path")

    def one(pair: tuple[str, str]) -> None:
        source, to = (_path(spark, p) for p in pair)
        store = _store(spark, pair[1])
        store.mkdirs(to.getParent())
        if store.exists(to):
            store.delete(to, False)
        try:
            renamed = store.rename(source, to)
        except Py4JJavaError as e:
            raise OSError(f"{pair[0]} could not be renamed to {pair[1]}") from e
        if not renamed:
            raise OSError(f"{pair[0]} could not be renamed to {pair[1]}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, moves))


def remove(spark: SparkSession, path: str) -> None:
    _store(spark, path).delete(_path(spark, path), True)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text under a new name, whole or not at all: it is written beside and renamed. An error if the name is taken."""
    to, beside = _path(spark, path), _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    store = _store(spark, path)
    out = store.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(to) or not store.rename(beside, to):
        store.delete(beside, False)
        raise FileExistsError(path)


def text_of(spark: SparkSession, path: str) -> str:
    stream = _store(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
