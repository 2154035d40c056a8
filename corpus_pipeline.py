"""A corpus pipeline over `documents`: toxicity, language, exact copies, near copies, packing.

Each stage reads all that the one before kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import language_id, toxicity
from tapewright.llm.common import table, written
from tapewright.llm.exact_dedup import exact_dedup
from tapewright.llm.minhash_dedup import minhash_dedup
from tapewright.llm.packing import pack


#: Up to so many rows to leave out are broadcast as their numbers; beyond, they and the documents meet in a shuffle.
BROADCAST_IDS = 2_000_000


def _bare(docs: DataFrame) -> bool:
    """Whether docs are rows of files, with columns chosen or computed at most: no other step can repeat, add or choose rows."""
    nodes, left = set(), [docs._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        nodes.add(node.getClass().getSimpleName())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return nodes <= {"LogicalRelation", "SubqueryAlias", "Project"}


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, list[str], DataFrame]:
    """docs with what tells its rows apart, the names of those columns, and (key, text) of every row.

    Rows of files are told apart by their file and their place in it, so no document is written again, once it is counted that
    no place is there twice (a file may be named twice). All other rows (of joins, samples, unions) get numbers and are written
    once, so that these don't change. A key is (no_id, doc_id, place): unlike doc_id it is never null and never repeated, and
    keys are in the order of doc_id, null ids last.
    """
    place = ["file", "row"]
    while set(place) & set(docs.columns):
        place = [f"{c}_" for c in place]
    file, row = place
    placed = None
    if _bare(docs):
        try:
            placed = docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
            if placed.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
                placed = None
        except AnalysisException:  # files without places
            placed = None
    if placed is None:
        placed = written(docs.select("*", F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(row)), name)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"))
    return placed, place, placed.select(key.alias("key"), "text")


def without(docs: DataFrame, place: list[str], gone: DataFrame, name: str) -> DataFrame:
    """Rows of docs whose place isn't in a key of `gone`, without the place."""
    rows = written(gone.select(F.col("key.file").alias(place[0]), F.col("key.row").alias(place[1])), name)
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    return docs.join(rows, place, "left_anti").drop(*place)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more by a machine trained on the labelled ones go.

    Null and empty texts are scored as empty ones, long texts whole; equal rows have equal scores and share their fate. Without
    labels or documents nothing is learned, and all rows have the same score. All columns of a row stay as they are.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or unlike any of the languages learned, go.

    Texts are read whole; equal rows share their fate; a tie between languages doesn't matter here. Where no row names its
    language, all rows with a letter stay. An empty table gives an empty one.
    """
    return language_id.with_known_language(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (but for white space) one stays, whatever their ids: the longest, then the smallest doc_id, null ids last.

    Null, empty and blank texts are equal. Of rows equal in everything the first by its place stays. An empty table gives an empty one.
    """
    docs, place, keyed = numbered(docs, "numbered")
    return without(docs, place, exact_dedup(keyed, "key").where("NOT kept"), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by a similarity of 0.8 or more of five-word shingles, one with the smallest doc_id stays, null ids last.

    Texts without words (null, empty, blank) all stay; of rows equal in everything the first by its place stays. An empty table gives an empty one.
    """
    docs, place, keyed = numbered(docs, "near-numbered")
    return without(docs, place, minhash_dedup(keyed, "key", least=80).where("NOT kept"), "near-copies")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row for each piece of a document; null and empty texts are their end id, repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", packed),
]
#: The first stages are trained models and the last needs a tokenizer: SQL can't state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
