"""Phrase mining against SQL and plain counting."""

import random
import re
from collections import Counter

import pytest

import tapewright.llm.phrases as ph
from compare import duck, rows
from fixtures import EDGES, edge_docs
from tapewright.llm.phrases import OP11_SQL, op11_phrase_mining, phrase_mining


def test_sql(spark, sf):
    assert rows(op11_phrase_mining(spark, sf).toPandas()) == rows(duck(sf).sql(OP11_SQL).df())


def plain(docs, least, longest, inside, most):
    """docs: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in good.items():
        longer = [b for (x, v), b in good.items() if x == lang and len(v) > len(w) and 100 * b >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not longer:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most], 1)]


def made(seed=0, n=60):
    r = random.Random(seed)
    words = "Alpha beta, gamma delta. epsilon zeta eta\ttheta iota; kappa\n lambda é ß".split(" ")
    fixed = ["new york city hall", "New  York city", "in order to", "a a a a a a"]
    return [(" ".join(r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randrange(5, 80))), r.choice(["en", None, "de", "und"])) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counting(spark, monkeypatch, small):
    if small:  # many batches, texts cut within pieces
        monkeypatch.setattr(ph, "BATCH_BYTES", 300)
        monkeypatch.setattr(ph, "CUT_BYTES", 20)
    docs = made() + [(t, "en") for _, t in EDGES if t is None or len(t) < 1000]
    df = spark.createDataFrame([(i, t, g, 3.0) for i, (t, g) in enumerate(docs)], "doc_id long, text string, lang string, n double").repartition(3)
    for least, most in ((5, 2000), (3, 7)):
        got = [tuple(r) for r in phrase_mining(df, most=most, least=least).collect()]
        assert sorted(got) == sorted(plain(docs, least, 4, 80, most))


def test_counts_past_64_bits(spark):
    big = 10**15
    df = spark.createDataFrame([(3 * big, [4 * big], [5 * big + 1])], "f long, heads array<long>, tails array<long>")
    assert df.select(ph._worst_cut(2).alias("c")).select("c.score").first()[0] == 2_000_000 * 3 * big // (9 * big + 1)


def test_long_text_and_nothing(spark):
    docs = edge_docs(spark)
    got = {r["phrase"]: r for r in phrase_mining(docs, least=4).where("lang = 'en'").collect()}
    want = {p: (a, l, r, s) for _, _, p, a, l, r, _, s in plain([(t, "en") for _, t in EDGES], 4, 4, 80, 2000)}
    assert {p: (r["a"], r["l"], r["r"], r["score"]) for p, r in got.items()} == want and want
    assert phrase_mining(docs.limit(0)).count() == 0
    assert phrase_mining(docs.where("doc_id < 3")).count() == 0
