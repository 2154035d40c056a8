"""Interaction of text filters: what each would remove in every order in which they could be applied.

Direct replay. A first pass writes a narrow row a document: which filters it fails, its part, its labels. Each row meets the
120 orders, whose number is fixed (five letters), by broadcast; the five steps of an order are exploded, the first step whose
filter the document fails is where it is removed, and conditional counts by part, order and step are combined in each task
before anything is shuffled, so that a part of any size sends 600 rows a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import table, with_class, written

#: The filters, and what each looks for.
LETTERS = "ABCDE"
BLANK_RUN = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> Column:
    """Bits 0 to 3 of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * upper > 10 * F.char_length(text), F.rlike(text, F.lit(MARKS))]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every document: `fails` has a bit a filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("own"))
    rows = written(narrow, "audit-rows")
    groups = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "audit-copies")
    rows = with_class(rows, groups, ["digest"], rows.count())
    copy = F.coalesce(F.col("first") < F.col("id"), F.col("first").isNotNull() & F.col("id").isNull())
    rows = rows.select("id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("fails"))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    both = rows.where("id IS NOT NULL").join(told, "id", "left").unionByName(rows.where("id IS NULL"), allowMissingColumns=True)
    return both.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replayed(flags: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts, shapley) from rows of flagged()."""
    named = ["".join(p) for p in permutations(LETTERS)]
    steps = [F.col(f"m{i}") for i in range(5)]
    orders = flags.sparkSession.createDataFrame([(i, o, *(1 << LETTERS.index(c) for c in o)) for i, o in enumerate(named)], "nth int, filter_order string, " + ", ".join(f"m{i} int" for i in range(5)))
    first = F.lit(6)
    for i in reversed(range(5)):
        first = F.when(F.col("fails").bitwiseAND(steps[i]) != 0, i + 1).otherwise(first)
    crossed = flags.crossJoin(F.broadcast(orders.drop("filter_order"))).select("part", "nth", "fails", "good", "toxic", first.alias("first"), F.posexplode(F.array(*steps)).alias("step", "mask"))
    step, here = F.col("step") + 1, F.col("first") == F.col("step") + 1
    failing = F.col("fails").bitwiseAND(F.col("mask")) != 0
    counts = [F.col("first") > step, here, failing & (F.col("first") < step), F.col("fails") == F.col("mask"), here & F.col("good"), here & F.col("toxic")]
    sums = written(crossed.groupBy("part", "nth", "step", "mask").agg(*[F.count_if(c).alias(n) for n, c in zip(COUNTS, counts, strict=True)]), "audit-sums")
    worth = sums.groupBy("part", "mask").agg(F.sum("removed").alias("shapley"))
    return sums.join(worth, ["part", "mask"]).join(F.broadcast(orders.select("nth", "filter_order")), "nth").select("part", "filter_order", (F.col("step") + 1).cast("int").alias("step"), *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part.

    Filters: A under 100 words; B under 80 % distinct words; C over 10 % of A-Z; D one of MARKS; E the text of a smaller doc_id.
    A null text counts as empty (it fails A only, and E where another empty one comes before), a null lang is the part ''. Long
    texts are read whole. Of rows with one text those without the smallest doc_id fail E: rows that share that id all pass, a
    null id fails where any row with an id has the text, and rows without ids pass among themselves. Ids labelled more than once
    are good (toxic) if any of their labels says so. Texts are told apart by SHA-256. An empty table has no parts, so no rows.
    Other columns are not read.
    """
    return replayed(flagged(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(t.doc_id > min(t.doc_id) OVER (PARTITION BY text) AS INT) AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS masks FROM m a, m b, m c, m d, m e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
r AS (SELECT part, good, toxic, fails, filter_order, masks, coalesce(list_min([i FOR i IN [1, 2, 3, 4, 5] IF (fails & masks[i]) <> 0]), 6) AS first FROM f, o),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM r),
g AS (
  SELECT part, filter_order, step, masks[step] AS mask, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
    count(*) FILTER (WHERE (fails & masks[step]) <> 0 AND first < step) AS redundant, count(*) FILTER (WHERE fails = masks[step]) AS unique_fails,
    count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, masks[step])
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, mask) AS BIGINT) AS shapley FROM g
"""
