"""Connected components of a table of links, on executors only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import written


#: Nodes that a task's forest holds at once.
NODES_HELD = 500_000


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links (a, b), as few as keep connected what they connect: each node but the smallest with the smallest it reaches. At most a link a node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low), np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low), np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forest(frames):
    """A spanning forest of the links in one partition: each node with the smallest one it reaches here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > NODES_HELD:  # bounded memory: hand over and begin anew
            yield pd.DataFrame([(k, root(k)) for k in parent if root(k) != k], columns=["a", "b"], dtype="int64")
            parent.clear()
    yield pd.DataFrame([(k, root(k)) for k in parent if root(k) != k], columns=["a", "b"], dtype="int64")


def _large_star(e: DataFrame) -> DataFrame:
    n = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return n.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = written(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = e.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a long, b long): the smallest node it reaches. Nodes without a link aren't listed.

    First each partition replaces its links by a spanning forest, then large and small stars alternate until nothing moves;
    a round is written to the shared folder, and of it only a count and a checksum come to the driver. The smallest neighbours
    are written as well: a plain table on that side of the join lets Spark broadcast it if it is small, and else split a hub's
    rows over several tasks.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    # written first: what found the links may run in Python as well, and then each task would hold two Python workers
    e = written(written(ordered, "links").mapInPandas(_forest, "a long, b long").distinct(), "links")
    sign = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(e)
    while before[0]:
        e = written(_small_star(_large_star(e)), "links")
        now = sign(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
