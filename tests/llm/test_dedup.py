"""De-duplication against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import tapewright.llm.components as parts
import tapewright.llm.embedding_dedup as emb
import tapewright.llm.minhash_dedup as mh
from compare import duck, rows
from fixtures import EDGES, edge_docs, words
from tapewright.llm.common import with_class
from tapewright.llm.components import components
from tapewright.llm.exact_dedup import OP8_SQL, Entries, exact_dedup, merge, op8_exact_dedup


def closed(nodes, links):
    """Smallest reachable node of each."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (7, 6)]
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    want = closed({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert {x["node"]: x["component"] for x in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_in_parts(monkeypatch):
    """Handed over in parts, forests connect what the links connect; so does spanning()."""
    monkeypatch.setattr(parts, "NODES_HELD", 10)
    r = random.Random(2)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(70)]
    frames = [pd.DataFrame(links[i : i + 5], columns=["a", "b"]) for i in range(0, 70, 5)]
    got = [tuple(x) for f in parts._forest(frames) for x in f.itertuples(index=False)]
    nodes = {x for p in links for x in p}
    assert closed(nodes, got) == closed(nodes, links)
    a, b = parts.spanning(*np.array(links).T)
    assert closed(nodes, zip(a, b, strict=True)) == closed(nodes, links) and len(a) < len(nodes)
    assert [len(x) for x in parts.spanning(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_exact_sql(spark, sf):
    assert rows(op8_exact_dedup(spark, sf).toPandas()) == rows(duck(sf).sql(OP8_SQL).df())


def test_exact_edges_and_rounds(spark):
    docs = edge_docs(spark).repartition(7)
    got = exact_dedup(docs, fan=2, segment=2).collect()
    bare = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = Counter(bare(t) for _, t in EDGES)
    assert len(got) == len(EDGES) and sum(r["kept"] for r in got) == len(groups)
    assert sorted(r["group_size"] for r in got) == sorted(groups[bare(t)] for _, t in EDGES)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 11)}
    assert by[1]["keep_id"] == by[2]["keep_id"] == by[3]["keep_id"] == 3  # most code points
    assert by[0]["keep_id"] == by[5]["keep_id"] == 0 and not by[5]["kept"]
    twice = exact_dedup(docs.where("doc_id = 0").union(docs.where("doc_id = 0"))).collect()
    assert sorted(r["kept"] for r in twice) == [False, True]
    assert exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("fan, segment", [(2, 16), (4, 50), (16, 8), (16, 1 << 16)])
def test_exact_rounds_equal_brute_force(spark, fan, segment):
    """A third of the rows are one text in many spellings; ids repeat or are missing, and so are keys made of several columns."""
    r = random.Random(fan)
    texts = ["a b c" if r.random() < 0.33 else f"t{r.randrange(250)}" for _ in range(900)]
    texts = [(" " * r.randrange(3)).join(t) for t in texts]
    data = [(r.choice([None, r.randrange(600)]) if i % 50 == 0 else r.randrange(600), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    groups = {}
    for i, t in data:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i is None, i or 0))
    want = Counter()
    for i, t in data:
        g = groups[t.replace(" ", "")]
        want[i, None if min(g)[1] else min(g)[2], len(g)] += 1
    got = exact_dedup(docs, fan=fan, segment=segment).collect()
    assert Counter((x["doc_id"], x["keep_id"], x["group_size"]) for x in got) == want
    assert sum(x["kept"] for x in got) == len(groups)
    keyed = docs.selectExpr("struct(doc_id IS NULL AS no_id, doc_id, monotonically_increasing_id() AS row) AS key", "text")
    by_key = exact_dedup(keyed, "key", fan=fan, segment=segment).collect()
    assert Counter((x["key"]["doc_id"], x["keep_id"]["doc_id"], x["group_size"]) for x in by_key) == want


def test_entries_whose_first_words_are_equal_stay_apart():
    """Digests that agree in their first 64 bits, in any order of runs, and hashes or lengths that differ under one digest."""
    keys = [(5, 1, 0, 0, 7, 3), (5, 0, 0, 0, 7, 3), (5, 1, 0, 0, 7, 3), (5, 1, 0, 0, 8, 3), (5, 1, 0, 0, 7, 4), (4, 9, 0, 0, 0, 0)]
    nums = [(1, i, 1) for i in range(len(keys))]
    out = merge(Entries(np.array(keys, np.uint64), np.array(nums, np.int64), pa.array([9, 1, 2, 3, 4, None])))
    assert [tuple(map(int, w)) for w in out.words] == sorted(set(keys))
    assert dict(zip(map(tuple, out.words.tolist()), out.ids.to_pylist(), strict=True))[5, 1, 0, 0, 7, 3] == 2
    assert sorted(out.nums[:, 2].tolist()) == [1, 1, 1, 1, 2]


def test_near_copies_and_vectors_sql(spark, sf):
    assert rows(mh.op2_minhash_dedup(spark, sf).toPandas()) == rows(duck(sf).sql(mh.OP2_SQL).df())
    assert rows(emb.op3_embedding_dedup(spark, sf).toPandas()) == rows(duck(sf).sql(emb.OP3_SQL).df())


def test_rows_meet_their_classes_however_large(spark):
    """Hot classes by broadcast, others by shuffle, rows without a class with nulls; no row is lost or repeated."""
    data = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL ELSE 10 + id % 400 END AS k", "'x' AS other")
    classes = data.where("k IS NOT NULL").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").selectExpr("k", "n", "k * 2 AS twice")
    got = {r["id"]: (r["k"], r["twice"]) for r in with_class(data, classes, ["k"], 2000).collect()}
    assert got == {r["id"]: (r["k"], None if r["k"] is None else 2 * r["k"]) for r in data.collect()}


def near_docs():
    """Families of edited texts, chains near the limit, exact copies, short texts, and a large group of near copies."""
    out = []
    for f in range(12):
        base = words(120 + 10 * f, f)
        for v in range(6):
            w = list(base)
            r = random.Random(100 * f + v)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"edit{r.randrange(9999)}"
            out.append(" ".join(w))
    base = words(300, 77)
    for v in range(120):
        w = list(base)
        w[v * 2 % 300] = f"mark{v}"
        out.append(" ".join(w))
    chain = words(200, 5)
    for v in range(12):  # each is near the next only
        chain = list(chain)
        chain[v * 10] = f"step{v}"
        chain[v * 10 + 5] = f"stride{v}"
        out.append(" ".join(chain))
    return out + ["one two three", "one two three", "ONE two\tthree", "one two", "", "   ", None] + [t for _, t in EDGES]


@pytest.mark.parametrize(("least", "ids"), [(85, mh.BROADCAST_IDS), (80, 0)])
def test_near_copies_equal_brute_force(spark, monkeypatch, least, ids):
    monkeypatch.setattr(mh, "BLOCK", 16)
    monkeypatch.setattr(mh, "SETS_BLOCK", 16)
    monkeypatch.setattr(mh, "BROADCAST_IDS", ids)
    texts = near_docs()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = {r["doc_id"]: r for r in mh.minhash_dedup(docs, least=least).collect()}

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    want = closed(range(len(sets)), links)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("least", "shingles"), [(85, 185), (80, 135)])
def test_recall_of_pairs_exactly_at_the_limit(spark, least, shingles):
    """Pairs that share exactly `least` % of their shingles (three words changed far apart): 2 in 10,000 may be missed, and of 600 none is here."""
    docs, r = [], random.Random(least)
    for i in range(600):
        w = [f"p{i}w{k}" for k in range(shingles + 4)]
        v = list(w)
        for at in r.sample(range(6, shingles - 6, 12), 3):
            v[at] = f"p{i}e{at}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = mh.minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), least=least).collect()
    assert sum(x["component_id"] == x["doc_id"] - 1 for x in got if x["doc_id"] % 2) >= 599
    assert all(x["component_id"] == x["doc_id"] for x in got if x["doc_id"] % 2 == 0)


def test_near_copies_edges(spark):
    docs = edge_docs(spark)
    got = mh.minhash_dedup(docs).collect()
    assert len(got) == len(EDGES)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert {r["doc_id"]: r["component_id"] for r in got}[6] == 0
    twice = docs.where("doc_id IN (0, 4)")
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in mh.minhash_dedup(twice.union(twice)).orderBy("doc_id").collect()] == [(0, 0, True)] * 2 + [(4, 4, True)] * 2
    assert mh.minhash_dedup(docs.limit(0)).count() == 0


def test_keys_guarantee_the_distance():
    """Signatures exactly `most` apart always share a key, wherever they differ."""
    rng = np.random.default_rng(0)
    for least in (85, 80):
        most = mh.most_apart(least)
        a = rng.integers(0, 1 << 16, (400, mh.HASHES)).astype(np.uint16)
        b = a.copy()
        for row in range(400):
            b[row, rng.choice(mh.HASHES, most, replace=False)] ^= 1
        x, y = (mh.keys_of(s, mh.with_error(most)) for s in (a, b))
        assert (x == y).any(axis=1).all()


def vectors(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[:150] = v[rng.integers(150, 300, 150)] + rng.normal(size=(150, dim)) * 0.12
    v[20:40] = v[300]
    return v


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(emb, "SHARD", 100)
    monkeypatch.setattr(emb, "SHARD_MOST", 150)
    v = vectors()
    data = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, node long").repartition(3)
    got = {r["vec_id"]: r for r in emb.embedding_dedup(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = closed(range(len(v)), zip(*np.nonzero(near), strict=True))
    found, true = sum(got[i]["n_links"] for i in range(len(v))), int(near.sum())
    assert found <= true and found >= 0.99 * true
    right = sum(got[i]["component_id"] == want[i] for i in range(len(v)))
    assert right >= 0.99 * len(v)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1005))
    assert got[1006]["component_id"] == 1005 and got[1005]["n_links"] == 1
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert emb.embedding_dedup(df.limit(0)).count() == 0


def test_planted_vectors_through_the_query(spark, tmp_path):
    """A table with pairs on both sides of the limit, chains, equal rows and odd vectors: the query gives what its SQL gives."""
    rng = np.random.default_rng(21)
    v = rng.normal(size=(700, 24))
    at = lambda i, cos: cos * (u := v[i] / np.linalg.norm(v[i])) + np.sqrt(1 - cos * cos) * (w := (r := rng.normal(size=24)) - (r @ u) * u) / np.linalg.norm(w)
    for k in range(60):
        v[100 + k] = at(k, 0.951) * 3
        v[200 + k] = at(k, 0.949) / 7
    for k in range(40):  # each near the one before it
        v[301 + k] = at(300 + k, 0.97)
    v[400:420] = v[5] * 2
    data = [(i * 3, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0] * 5), (9005, [2.0] * 5)]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(emb.OP3_SQL).df()
    assert (want["n_links"] > 0).sum() > 180
    assert rows(emb.op3_embedding_dedup(spark, str(tmp_path)).toPandas()) == rows(want)


def test_audit_without_links_is_by_planted_questions(spark, monkeypatch):
    """Vectors far from each other: the search is judged by questions near them, and one that finds nothing is not accepted."""
    v = np.random.default_rng(22).normal(size=(900, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    nodes = df.selectExpr("vec_id AS node", "embedding").rdd.map(lambda r: (r[0], bytearray(emb.unit(r[1]).tobytes()), 32, 1)).toDF("node long, vec binary, dim int, n long")
    monkeypatch.setattr(emb, "SHARD", 100)
    shards = emb.Shards(nodes)
    hit, planted = emb.planted_recall(nodes, shards, 0.95, min(emb.PROBES, shards.most_probes))
    assert planted == emb.AUDITED and hit >= 0.99 * planted
    monkeypatch.setattr(emb, "range_search", lambda *_: (np.zeros(0, np.int64),) * 2)
    assert emb.planted_recall(nodes, shards, 0.95, 2)[0] == 0
    asked = []
    monkeypatch.setattr(emb, "exact_links", lambda nodes, least: asked.append(1) or spark.createDataFrame([], emb.TALLY))
    emb.audited_links(nodes, 0.95)
    assert asked == [1]


def grouped_vectors(groups=10, size=130, dim=16):
    """Groups of near, unequal vectors far from each other, and what brute force links."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(groups, dim)), size, axis=0) + rng.normal(size=(groups * size, dim)) * 0.1
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return v, near


@pytest.mark.parametrize("lost", [False, True])
def test_groups_larger_than_the_pool(spark, monkeypatch, lost):
    """Each group is an island of its shard's graph; if the search finds nothing at all, the links are found exactly."""
    if lost:
        monkeypatch.setattr(emb, "range_search", lambda *_: (np.zeros(0, np.int64),) * 2)
        monkeypatch.setattr(emb, "SHARD_MOST", 500)
    else:
        monkeypatch.setattr(emb, "exact_links", None, raising=False)
    v, near = grouped_vectors()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r for r in emb.embedding_dedup(df).collect()}
    want = closed(range(len(v)), zip(*np.nonzero(near), strict=True))
    found, true = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert true >= found >= (1 if lost else 0.99) * true
    assert sum(got[i]["component_id"] == want[i] for i in want) >= (1 if lost else 0.99) * len(v)


def test_clusters_divided_twice(spark, monkeypatch):
    """Levels of clusters, a hot group of near vectors that no centroid divides well, and an audit that passes."""
    monkeypatch.setattr(emb, "SHARD", 40)
    monkeypatch.setattr(emb, "DIVIDED", 120)
    monkeypatch.setattr(emb, "CENTROIDS_MOST", 6)
    monkeypatch.setattr(emb, "SHARD_MOST", 150)
    monkeypatch.setattr(emb, "PAIRS_HELD", 500)
    v, near = grouped_vectors(12, 70)
    v = np.vstack([v, np.random.default_rng(6).normal(size=(1, 16)) + np.random.default_rng(7).normal(size=(300, 16)) * 0.02])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    nodes = df.selectExpr("vec_id AS node", "embedding").rdd.map(lambda r: (r[0], bytearray(emb.unit(r[1]).tobytes()), 16, 1)).toDF("node long, vec binary, dim int, n long")
    shards = emb.Shards(nodes)
    assert len(shards.levels) >= 2 and shards.graph.where("home").count() == len(v)  # at home once
    got = {r["vec_id"]: r for r in emb.embedding_dedup(df).collect()}
    want = closed(range(len(v)), zip(*np.nonzero(near), strict=True))
    found, true = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert true >= found >= 0.99 * true
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.99 * len(v)
    assert all(got[i]["n_links"] > 0 for i in want if got[i]["component_id"] != i)


def test_questions_to_a_hot_cluster_come_in_turns(spark, monkeypatch):
    monkeypatch.setattr(emb, "QUERIES_MOST", 100)
    asking = spark.range(1300).selectExpr("id AS node", "2 AS dim", "CAST(if(id < 1000, 0, 1 + id % 30) AS int) AS cluster")
    assert {r["cluster"]: r["turns"] for r in emb.turns_of(asking).collect()} == {0: 10, **dict.fromkeys(range(1, 31), 1)}
