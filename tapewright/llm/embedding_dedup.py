"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one node. Nodes are dealt to clusters: centroids are fitted on a bounded sample, a node belongs to its
   OVERLAP nearest ones and is at home in the nearest. Clusters that come out too large are divided again in the same way.
2. Each cluster (a shard) builds a graph: every node keeps, of its nearest neighbours, those that no kept one is much closer
   to (robust pruning), with the reverse edges. Adjacency lists of a node in several shards are united.
3. Every node is looked up in its PROBES nearest shards and in all that are nearly as near: a greedy best-first search from its
   own place in the shard, if it is there, and from rows that together lead to every row of the shard; from what is in range
   the search goes on as long as neighbours lie within the range and a margin around it.
4. What it finds is verified by the cosine in double precision. A pair counts where its larger node is at home, so tasks hand
   on only sums of links and what links connect, at most a row a node, and never the pairs.
5. Recall is audited against brute force for a bounded set of nodes over all nodes, and where those have too few links to
   tell, by questions planted near nodes; below RECALL the number of probes is doubled, up to all shards, and if that isn't
   enough, all blocks of nodes are compared exactly.

A cluster of more than SHARD_MOST nodes is several shards (by a hash of the node), all of which its queries search, in as
many turns as its own questions need, so a task's memory is bounded whatever the data.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import table, with_class, written
from tapewright.llm.components import components, spanning

LEAST = 0.95
SHARD, SHARD_MOST, QUERIES_MOST = 1000, 4000, 4000
#: Clusters of more nodes are divided again, and how often at most.
DIVIDED, LEVELS = 32_000, 4
OVERLAP, PROBES = 3, 6
#: Clusters whose centroid is less than so much further off (in cosine) than the nearest one are searched as well.
NEARLY = 0.02
SAMPLE, CENTROIDS_MOST, CHUNK_BYTES = 20_000, 4096, 64 << 20
DEGREE, POOL, ALPHA, BEAM, MARGIN, EXPANDED = 24, 96, 1.2, 32, 0.10, 16
#: The audit takes AUDITED nodes, four times as many while it has seen fewer than SEEN links, AUDITED_MOST at most.
AUDITED, AUDITED_MOST, SEEN, RECALL = 256, 4096, 200, 0.99
PAIRS_HELD = 1 << 20
#: Questions that a shard's search takes together.
TOGETHER = 256
#: Bytes of audited vectors at most.
AUDIT_BYTES = 64 << 20
_log = logging.getLogger(__name__)


def unit(values) -> np.ndarray | None:
    """The vector over its length in double precision, or None if it is null, empty, zero or holds null or non-finite components."""
    if values is None:
        return None
    v = np.array([np.nan if x is None else x for x in values] if isinstance(values, list) else values, np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # neither overflow nor underflow in the squares
    return v / np.sqrt((v * v).sum())


def _units(batches):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for x in batch.column("vec").to_pylist():
            v = unit(x)
            row = (None,) * 4
            if v is not None:
                b = v.tobytes()
                h = xxhash.xxh3_128_intdigest(b)
                row = signed(h >> 64), signed(h & ((1 << 64) - 1)), b, len(v)
            for column, y in zip(columns, row, strict=True):
                column.append(y)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "h1", "h2", "vec", "dim"])


def _matrix(column) -> np.ndarray:
    parts = list(column)
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 1))


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread starting rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        to = np.concatenate([(x[i : i + 1024] @ c.T).argmax(axis=1) for i in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        n = np.linalg.norm(sums, axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists by robust pruning of each row's POOL nearest rows, with reverse edges."""
    n, block = len(x), 256
    pool_of = min(POOL, n - 1)
    kept = np.full((n, DEGREE), -1, np.int64)
    for start in range(0, n, block):
        near = x[start : start + block] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        pool = np.argpartition(-near, pool_of - 1, axis=1)[:, :pool_of]
        order = np.argsort(-np.take_along_axis(near, pool, axis=1), axis=1, kind="stable")
        pool = np.take_along_axis(pool, order, axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, pool, axis=1), 0))
        rows, alive, at = x[pool], np.ones(pool.shape, bool), np.arange(len(pool))
        for k in range(min(DEGREE, pool_of)):  # the nearest row that is left is kept, and those much closer to it go
            first = alive.argmax(axis=1)
            some = alive[at, first]
            if not some.any():
                break
            kept[start + at[some], k] = pool[at[some], first[some]]
            between = np.sqrt(np.maximum(2 - 2 * np.matmul(rows, rows[at, first][:, :, None])[:, :, 0], 0))
            alive &= ~(ALPHA * between <= apart)
            alive[at, first] = False
    source, place = np.nonzero(kept >= 0)
    to = kept[source, place]
    order = np.lexsort((source, to))
    to, source_of = to[order], source[order]
    first = np.searchsorted(to, np.arange(n + 1))
    back = [source_of[first[i] : first[i + 1]][: 2 * DEGREE] for i in range(n)]
    return [np.unique(np.concatenate([own[own >= 0], b])) for own, b in zip(kept, back, strict=True)]


def entries(x: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Rows from which the graph leads to all rows: the medoid, then the most central row not reached yet, until none is left."""
    seen, out = np.zeros(len(x), bool), []
    for start in np.argsort(-(x @ x.mean(axis=0)), kind="stable"):
        if seen[start]:
            continue
        out.append(start)
        seen[start] = True
        at = np.array([start])
        while len(at):
            at = np.unique(np.concatenate([lists[i] for i in at]))
            at = at[~seen[at]]
            seen[at] = True
    return np.array(out, np.int64)


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Adjacency lists as rows of one length, filled up with the row itself."""
    out = np.repeat(np.arange(len(lists))[:, None], max([1, *map(len, lists)]), axis=1)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def range_search(x: np.ndarray, near: np.ndarray, starts: np.ndarray, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of rows of x with a cosine of at least `least` with a row of q, as far as the graph leads there from `starts` and from the question's own row (-1: none).

    Questions are searched together: in a step each expands the best EXPANDED rows of its beam, until nothing in any beam is
    left. A beam is the BEAM best rows seen, and all that are in range or within MARGIN of it.
    """
    cos = q.astype(np.float32) @ x.astype(np.float32).T  # shows the way; links are verified in double precision
    seen = np.zeros(cos.shape, bool)
    seen[:, starts] = True
    there = np.flatnonzero(own >= 0)
    seen[there, own[there]] = True
    done = np.zeros(cos.shape, bool)
    active = np.arange(len(q))
    step = min(EXPANDED, len(x))
    while len(active):
        known = np.where(seen[active], cos[active], np.float32(-np.inf))
        worst = np.partition(known, len(x) - min(BEAM, len(x)), axis=1)[:, -min(BEAM, len(x))]
        known[(known < np.minimum(worst, least - MARGIN)[:, None]) | done[active]] = -np.inf
        best = np.argpartition(-known, step - 1, axis=1)[:, :step]
        open_ = np.take_along_axis(known, best, axis=1) > -np.inf
        row, _ = np.nonzero(open_)
        at = best[open_]
        done[active[row], at] = True
        seen[active[row][:, None], near[at]] = True
        active = active[open_.any(axis=1)]
    return np.nonzero(seen & (cos >= least - 1e-5))


def fitted_centroids(members: DataFrame, most: int) -> DataFrame:
    """(dim, cluster, k, chunks, data) for each cluster of more than `most` nodes, fitted on about SAMPLE of them: k centroids, and in how many chunks its rows are dealt to them."""
    sizes = members.groupBy("dim", "cluster").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    draw = F.pmod(F.xxhash64("node"), F.lit(1_000_003)) / 1_000_003
    sample = members.join(sizes, ["dim", "cluster"]).where(draw < SAMPLE / F.col("rows")).select("dim", "cluster", "rows", "node", "vec")

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, rows = _matrix(frame.sort_values("node")["vec"]), int(frame["rows"].iloc[0])
        k = int(min(len(x), CENTROIDS_MOST, -(-rows // SHARD)))
        return pd.DataFrame({"dim": [key[0]], "cluster": [key[1]], "k": [k], "chunks": [-(-rows * x.shape[1] * 8 // CHUNK_BYTES)], "data": [centroids(x, k).tobytes()]})

    return sample.groupBy("dim", "cluster").applyInPandas(fit, "dim int, cluster long, k int, chunks int, data binary")


def divided(rows: DataFrame, centres: DataFrame, most: int, nearly: float = 0.0) -> DataFrame:
    """rows (dim, cluster, home, node, vec, n), those of clusters with centroids dealt to their `most` nearest new clusters and to all that are `nearly` as near; they are at home in the nearest. All clusters get new numbers."""
    chunk = F.pmod(F.xxhash64("node", F.lit(17)), F.col("chunks")).cast("int")
    asked = rows.join(centres.select("dim", "cluster", "chunks"), ["dim", "cluster"]).withColumn("chunk", chunk).drop("chunks")
    given = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near = []
        if len(left):
            c = np.frombuffer(right["data"].iloc[0], np.float64).reshape(right["k"].iloc[0], -1)
            x, base = _matrix(left["vec"]), left["cluster"].to_numpy() * CENTROIDS_MOST
            for start in range(0, len(x), 4096):
                cos = x[start : start + 4096] @ c.T
                order = np.argsort(-cos, axis=1, kind="stable")
                wanted = np.maximum((cos > cos.max(axis=1, keepdims=True) - nearly).sum(axis=1), most)
                near += [b + own[:w] for b, own, w in zip(base[start : start + 4096], order, wanted, strict=True)]
        return left[["dim", "home", "node", "vec", "n"]].assign(near=near)

    key = ["dim", "cluster", "chunk"]
    dealt = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(deal, "dim int, home boolean, node long, vec binary, n long, near array<long>")
    dealt = dealt.select("dim", "home", "node", "vec", "n", F.posexplode("near").alias("nth", "cluster"))
    dealt = dealt.select("dim", "cluster", (F.col("home") & (F.col("nth") == 0)).alias("home"), "node", "vec", "n")
    others = rows.join(centres.select("dim", "cluster"), ["dim", "cluster"], "left_anti").withColumn("cluster", F.col("cluster") * CENTROIDS_MOST)
    return others.select(dealt.columns).unionByName(dealt)


class Shards:
    """Overlapping clusters of nodes (node, vec, dim, n), and in each of them a graph."""

    def __init__(self, nodes: DataFrame):
        self.base = nodes.select("dim", F.lit(0).cast("long").alias("cluster"), F.lit(True).alias("home"), "node", "vec", "n")
        self.levels: list[DataFrame] = []
        members, most = self.base, SHARD
        for level in range(LEVELS):
            centres = written(fitted_centroids(members, most), "centroids")
            if centres.isEmpty():
                break
            self.levels.append(centres)
            members = written(divided(members, centres, 2 if level else OVERLAP), "members")
            most = DIVIDED
        self.most_probes = max([1, *(c.agg(F.max("k")).first()[0] for c in self.levels)])
        shards = members.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("shards"))
        self.shards = written(shards, "shards")
        members = members.join(self.shards, ["dim", "cluster"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(3)), F.col("shards")).cast("int")).drop("shards")
        key = ["dim", "cluster", "shard"]
        graph = members.groupBy(*key).applyInPandas(_build, "node long, near array<long>")
        united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # as many lists as the node has shards
        self.graph = written(members.join(united, "node", "left").select(*key, "home", "node", "vec", "n", F.coalesce("near", F.array().cast("array<long>")).alias("near")), "graph")

    def asked(self, probes: int, questions: DataFrame | None = None) -> DataFrame:
        """The nodes, or others like them, as questions to their nearest clusters."""
        rows = self.base if questions is None else questions.select("dim", F.lit(0).cast("long").alias("cluster"), F.lit(True).alias("home"), "node", "vec", "n")
        for level, centres in enumerate(self.levels):
            rows = divided(rows, centres, max(2, 2 * probes // 3) if level else probes, NEARLY)
        return rows.select("dim", "cluster", "node", "vec", "n")


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    node = frame["node"].to_numpy()
    lists = pruned_graph(_matrix(frame["vec"])) if len(node) > 1 else [np.zeros(0, np.int64)] * len(node)
    return pd.DataFrame({"node": node, "near": [node[x] for x in lists]})


class Tally:
    """Links as sums a node and as what they connect; pairs are held only until PAIRS_HELD."""

    def __init__(self):
        self.pairs: list[tuple] = []
        self.out: list[tuple] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Links between nodes a and b, which stand for n_a and n_b vectors."""
        self.pairs.append((a, b, n_a, n_b))
        self.held += len(a)
        if self.held > PAIRS_HELD:
            self._settle()

    def _settle(self) -> None:
        if self.held:
            a, b, n_a, n_b = map(np.concatenate, zip(*self.pairs, strict=True))
            node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([n_b, n_a]), len(node)).astype(np.int64)
            p, q = spanning(a, b)
            self.out += [(node, node, sums), (p, q, np.zeros(len(p), np.int64))]
        self.pairs, self.held = [], 0

    def frame(self) -> pd.DataFrame:
        """(a, b, links): a node's sum where a = b, else what connects a and b."""
        self._settle()
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({c: np.concatenate(none + [x[i] for x in self.out]) for i, c in enumerate(("a", "b", "links"))})


TALLY = "a long, b long, links long"


def _search(least: float):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node")
        tally = Tally()
        if len(left) and len(right):
            x, node, n, home = _matrix(left["vec"]), left["node"].to_numpy(), left["n"].to_numpy(), left["home"].to_numpy(bool)
            lists = []
            for own in left["near"]:  # neighbours in other shards aren't here
                own = np.asarray(own, np.int64)
                at = np.minimum(np.searchsorted(node, own), len(node) - 1)
                lists.append(np.unique(at[node[at] == own]))
            starts, near = entries(x, lists), padded(lists)
            asked, asked_n = right["node"].to_numpy(), right["n"].to_numpy()
            own_at = np.minimum(np.searchsorted(node, asked), len(node) - 1)
            own_at = np.where(node[own_at] == asked, own_at, -1)
            vectors = right["vec"].to_numpy()
            for i in range(0, len(asked), TOGETHER):
                q = _matrix(vectors[i : i + TOGETHER])
                question, found = range_search(x, near, starts, q, own_at[i : i + TOGETHER], least - 1e-6)
                ok = home[found] & (node[found] > asked[i + question])
                question, found = question[ok], found[ok]
                for k in range(0, len(found), 16384):
                    a, b = question[k : k + 16384], found[k : k + 16384]
                    sure = (q[a] * x[b]).sum(axis=1) >= least
                    a, b = i + a[sure], b[sure]
                    tally.add(asked[a], node[b], asked_n[a], n[b])
        return tally.frame()

    return search


def turns_of(asking: DataFrame) -> DataFrame:
    """(dim, cluster, turns): in how many parts the questions to each cluster's shards come, of about QUERIES_MOST each."""
    return asking.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / QUERIES_MOST).cast("long").alias("turns"))


def links_of(shards: Shards, least: float, probes: int, questions: DataFrame | None = None) -> DataFrame:
    """The tally of verified links by graph search in `probes` clusters a node, of all nodes or of other questions."""
    asking = written(shards.asked(probes, questions), "questions")
    turns = written(turns_of(asking), "turns")
    asked = asking.join(turns, ["dim", "cluster"]).join(shards.shards, ["dim", "cluster"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    # a shard that many nodes ask is read by several tasks, each with some of the questions
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("node", F.lit(5)), F.col("turns"))).drop("turns")
    left = shards.graph.join(turns, ["dim", "cluster"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
    key = ["dim", "cluster", "shard", "turn"]
    return written(left.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(least), TALLY), "links")


def _compare(least: float):
    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[~frame["right"]], frame[frame["right"]]
        tally = Tally()
        if len(left) and len(right):
            x, y = _matrix(left["vec"]), _matrix(right["vec"])
            (p, m), (q, n) = ((f["node"].to_numpy(), f["n"].to_numpy()) for f in (left, right))
            for start in range(0, len(x), 256):
                i, j = np.nonzero(x[start : start + 256] @ y.T >= least - 1e-6)
                i += start
                if key[1] == key[2]:  # a block with itself
                    i, j = i[p[i] < q[j]], j[p[i] < q[j]]
                for at in range(0, len(i), 16384):
                    a, b = i[at : at + 16384], j[at : at + 16384]
                    ok = (x[a] * y[b]).sum(axis=1) >= least
                    a, b = a[ok], b[ok]
                    tally.add(p[a], q[b], m[a], n[b])
        return tally.frame()

    return compare


def exact_links(nodes: DataFrame, least: float) -> DataFrame:
    """The tally of all links: every block of about SHARD_MOST nodes meets every block with vectors of its length once."""
    blocks = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(13)), F.col("blocks")).cast("int")
    dealt = nodes.select("node", "vec", "dim", "n").join(written(blocks, "blocks"), "dim").withColumn("block", block)
    left = dealt.select("dim", F.col("block").alias("lb"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("rb"), "node", "vec", "n", F.lit(False).alias("right"))
    right = dealt.select("dim", F.explode(F.sequence(F.lit(0), "block")).alias("lb"), F.col("block").alias("rb"), "node", "vec", "n", F.lit(True).alias("right"))
    return written(left.unionByName(right).groupBy("dim", "lb", "rb").applyInPandas(_compare(least), TALLY), "links")


def _planted(least: float):
    def plant(frames):
        """Vectors near nodes: as far from them as a link allows, or up to half as far, in a direction drawn by the node's number."""
        for f in frames:
            out = []
            for node, vec in zip(f["node"], f["vec"], strict=True):
                v = np.frombuffer(vec, np.float64)
                rng = np.random.default_rng(int(node))
                side = rng.normal(size=len(v))
                side -= (side @ v) * v
                length = np.sqrt(side @ side)
                angle = np.arccos(min(1.0, least + 1e-9)) * rng.uniform(0.5, 1.0)
                out.append(unit(np.cos(angle) * v + np.sin(angle) * side / length).tobytes() if length > 0 else bytes(vec))
            yield f.assign(node=-1 - f["node"], vec=out)[["node", "vec", "dim", "n"]]

    return plant


def planted_recall(nodes: DataFrame, shards: Shards, least: float, probes: int) -> tuple[int, int]:
    """(found, planted): of AUDITED nodes, how many does a question near them find. Always measurable, whether the nodes have links or not."""
    some = written(nodes.orderBy(F.xxhash64("node", F.lit(12)), "node").limit(AUDITED).select("node", "vec", "dim", F.lit(1).cast("long").alias("n")), "audited")
    questions = written(some.mapInPandas(_planted(least), "node long, vec binary, dim int, n long"), "planted")
    links = links_of(shards, least, probes, questions)
    own = links.where("a != b").select(F.least("a", "b").alias("q"), F.greatest("a", "b").alias("node")).where("q < 0")
    hit = own.where(F.col("node") == -1 - F.col("q")).distinct().count()
    return hit, some.count()


def recall_of(nodes: DataFrame, links: DataFrame, least: float) -> tuple[int, int, int]:
    """(found, true, nodes audited): links of a bounded set of nodes, found and by brute force over all nodes. It grows until SEEN links are seen, AUDITED_MOST nodes or AUDIT_BYTES at most."""
    spark, audited = nodes.sparkSession, AUDITED
    most = min(AUDITED_MOST, max(16, AUDIT_BYTES // (8 * (nodes.agg(F.max("dim")).first()[0] or 1))))
    while True:
        audited = min(audited, most)
        some = nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").select("node", "vec", "dim").limit(audited).collect()
        sent = spark.sparkContext.broadcast([(r["node"], bytes(r["vec"]), r["dim"]) for r in some])

        def brute(batches, sent=sent):
            by_dim, sums = {}, {}
            for dim in {d for _, _, d in sent.value}:
                own = [(n, v) for n, v, d in sent.value if d == dim]
                by_dim[dim] = np.array([n for n, _ in own]), _matrix([v for _, v in own])
                sums[dim] = np.zeros(len(own), np.int64)
            for batch in batches:
                for dim, part in batch.to_pandas().groupby("dim"):
                    if dim in by_dim:
                        q, x = by_dim[dim]
                        near = (_matrix(part["vec"]) @ x.T >= least) & (part["node"].to_numpy()[:, None] != q)
                        sums[dim] += part["n"].to_numpy() @ near
            for dim, (q, _) in by_dim.items():
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(sums[dim])], ["a", "true"])

        true = nodes.select("node", "vec", "dim", "n").mapInArrow(brute, "a long, true long").groupBy("a").agg(F.sum("true").alias("true"))
        got = links.where("a = b").groupBy("a").agg(F.sum("links").alias("found"))
        both = true.join(got, "a", "left").agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum("true"), F.lit(0))).first()
        sent.destroy()
        if both[1] >= SEEN or len(some) < audited or audited >= most:
            return both[0], both[1], len(some)
        audited *= 4


def audited_links(nodes: DataFrame, least: float) -> DataFrame:
    """The tally of links, with a recall of RECALL or more by the audit, which is logged."""
    shards = Shards(nodes)
    probes = PROBES
    while True:
        asked = min(probes, shards.most_probes)
        links = links_of(shards, least, asked)
        found, true, audited = recall_of(nodes, links, least)
        _log.info("%d of %d links of %d audited vectors found in %d clusters each", found, true, audited, asked)
        good = found >= RECALL * true
        if good and true < SEEN:  # too few to tell
            hit, planted = planted_recall(nodes, shards, least, asked)
            _log.info("%d of %d questions planted near vectors found them", hit, planted)
            good = hit >= RECALL * planted
        if good:
            return links
        if probes >= shards.most_probes:
            _log.warning("the graph search is under a recall of %s: all blocks are compared", RECALL)
            return exact_links(nodes, least)
        probes *= 2


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different
    lengths with each other: 0 links, a component of their own, kept. Equal vectors are links of each other. A row with a null
    id has no component and is kept. Repeated ids are rows of their own. An empty table gives an empty result. Other columns
    are not read.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = written(vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vec")).mapInArrow(_units, f"id {id_type}, h1 long, h2 long, vec binary, dim int"), "units")
    equal = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    nodes = written(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = audited_links(nodes, least)

    degree = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    known = components(links.where("a != b").select("a", "b"))
    named = nodes.select("node", "h1", "h2", "id", "n").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = written(named.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    of_node = named.join(smallest, "component").join(degree, "node", "left").select("h1", "h2", "n", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    slim = rows.select("id", "h1", "h2")
    out = with_class(slim, written(of_node, "vector-classes"), ["h1", "h2"], slim.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
