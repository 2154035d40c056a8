"""Passages that repeat across documents, against SQL and brute force."""

import random

import numpy as np
import pytest

import tapewright.llm.substring_dedup as sd
from compare import duck, rows
from fixtures import EDGES, edge_docs, words
from tapewright.llm.substring_dedup import OP12_SQL, op12_substring_dedup, substring_dedup


def test_sql(spark, sf):
    assert rows(op12_substring_dedup(spark, sf).toPandas()) == rows(duck(sf).sql(OP12_SQL).df())


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(docs, window):
    """docs: (id, text); the rows' (id, words, kept text)."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        w = split(t)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key(i):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def made(seed, window, n=60):
    """Documents of fresh words, shared passages of lengths around the window's at any place, edited copies, lines repeated within a document and by chains of owners."""
    r = random.Random(seed)
    passages = [words(k, 1000 * seed + k) for k in (window // 2, window - 1, window, window + 1, window * 2, window * 3 + 7, 400)]
    line = words(window // 2, 99)
    docs = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - window // 2))
            w += r.choice([words(r.randrange(1, 60), 7 * seed + 31 * i), p[a:], p, line * r.randrange(1, 5), p[:a]])
        docs.append((i, w))
    for i in range(n, n + 25):  # copies of a copy, edited here and there
        w = list(r.choice(docs)[1])
        for _ in range(r.randrange(0, 4)):
            if w:
                w[r.randrange(len(w))] = r.choice(["edit", f"edit{i}"])
        docs.append((i, w))
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return [(ids[i], r.choice([" ", "  ", "\n"]).join(w)) for i, w in docs]


@pytest.mark.parametrize(("seed", "window", "small"), [(1, 50, False), (2, 50, True), (3, 7, True), (4, 10, False)])
def test_equals_brute_force(spark, monkeypatch, seed, window, small):
    if small:
        monkeypatch.setattr(sd, "BATCH_LEAST", 3000)
        monkeypatch.setattr(sd, "BATCH_SHARE", 1)
    docs = made(seed, window)
    docs += [(docs[0][0], docs[1][1]), (docs[0][0], docs[1][1]), (None, docs[2][1]), (None, docs[2][1] + " more"), (None, None), (5000, ""), (5001, "\xa0é " * 300), (5002, "\xa0é " * 300)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, t double").repartition(5)
    got = substring_dedup(df, window).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["kept_text"]) for r in got)) == sorted((i is None, i or 0, n, t) for i, n, t in plain(docs, window))
    by = {i: split(t) for i, t in docs if [j for j, _ in docs].count(i) == 1}
    for r in got:
        if r["doc_id"] in by:
            w = by[r["doc_id"]]
            for a, z in reversed(r["removed"]):
                del w[a:z]
            assert " ".join(w) == r["kept_text"]


def test_long_texts_and_long_words(spark):
    """Texts and words longer than what is hashed at once."""
    base = [f"quite-a-long-word-{i % 49_999}" for i in range(60_000)]
    giant = "x" * (sd.HASHED + 9000)
    docs = [(1, " ".join(base)), (2, " ".join(["start", *base[100:50_100], giant, *base[3:70], "end"])), (3, " ".join([*words(60, 1), giant, *base[3:70]])), (4, giant)]
    got = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 50).collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept_text"]) for r in got) == sorted(plain(docs, 50))


def test_hashes_in_pieces_are_hashes(monkeypatch):
    text = " ".join(words(3000, 5)).encode()
    whole = sd._grams(text, 25)[0]
    monkeypatch.setattr(sd, "HASHED", 700)
    assert (sd._Rolling()(*(lambda x, a, z: (x, a[:2976], z[24:]))(*sd.words_of(text)), 0) == whole).all() and len(np.unique(whole)) == len(whole)


def test_edges(spark):
    docs = edge_docs(spark)
    got = substring_dedup(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["kept_text"]) for r in got) == sorted((i or -1 if i != 0 else -1, n, t) for i, n, t in plain(EDGES, 50))
    assert substring_dedup(docs.limit(0)).count() == 0
