"""Trained operators against plain computations of the same models, and their bounds."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from fixtures import words
from tapewright.llm import language_id, toxicity

START, END = language_id.START, language_id.END


def plain_kneser_ney(counts):
    """p(last character | those before) of a string, by the recursive definition over dictionaries."""
    grams = defaultdict(float)
    for w, n in counts.items():
        x = START + w + END
        for i in range(1, len(x)):
            grams[x[max(0, i - 4) : i + 1]] += n
    by_order = {k: {g: n for g, n in grams.items() if len(g) == k} for k in range(1, 6)}
    for k in range(4, 0, -1):
        before = defaultdict(set)
        for g in by_order[k + 1]:
            before[g[1:]].add(g[0])
        for g, chars in before.items():
            by_order[k][g] = by_order[k].get(g, 0) + len(chars)
    discount = {}
    for k, own in by_order.items():
        n1, n2 = (sum(v == m for v in own.values()) for m in (1, 2))
        discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

    def p(g):
        if not g:
            return 1 / 500
        own = {h: n for h, n in by_order[len(g)].items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        d = discount[len(g)]
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:])

    def word(w):
        x = START + w + END
        out = 0.0
        for i in range(1, len(x)):
            g = x[max(0, i - 4) : i + 1]
            out += math.log(p(g))
        return out

    return word


def test_language_model_equals_the_plain_one():
    r = random.Random(0)
    counts = {"".join(r.choice("abcdé") for _ in range(r.randrange(1, 9))): r.randrange(1, 6) for _ in range(60)}
    model, plain = language_id.fit(counts), plain_kneser_ney(counts)
    asked = [*list(counts)[:25], "zzz", "abq", "a", "édéd" * 4, "cab" * 9]
    scored = language_id.Scorer([model]).of(asked)
    for w, row in zip(asked, scored, strict=True):
        assert row[0] == pytest.approx(plain(w), rel=1e-5), w
        assert row[language_id.CHARACTERS] == len(w) + 1 and row[language_id.RUNS] == 1


def test_language_of_a_text_is_the_least_cross_entropy(monkeypatch):
    """Sums over words, whatever the blocks in which new words are scored, and the memo's emptying."""
    monkeypatch.setattr(language_id, "WORDS_AT_ONCE", 3)
    corpora = [{"the": 5, "then": 2, "there": 2, "other": 1}, {"der": 4, "die": 4, "oder": 2, "dort": 1}]
    models, plain = [language_id.fit(c) for c in corpora], [plain_kneser_ney(c) for c in corpora]
    scorer = language_id.Scorer(models)
    scorer.at.most = 2000
    texts = ["the other then", "die oder der", "1 2 ?", "The, DER; there-the!", ""] * 3
    got = np.vstack([scorer.of([t]) for t in texts])
    best, score, low, rejected = language_id.decide(models, got)
    find = language_id._letters()
    for t, row, b, e in zip(texts, got, best, low, strict=True):
        own = [x.lower() for x in find(t)]
        if not own:
            assert b == -1
            continue
        sums = [sum(map(p, own)) for p in plain]
        n = sum(len(x) + 1 for x in own)
        assert row[:2] == pytest.approx(sums, rel=1e-4) and b == int(np.argmax(sums)) and e == pytest.approx(-max(sums) / n, rel=1e-4)
    assert rejected.tolist() == [not find(t) for t in texts] and ((score >= 0) & (score <= 1)).all()


def test_length_and_repetition_reject_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = language_id.train(docs)
    some = [r["text"] for r in docs.where("text IS NOT NULL AND length(text) BETWEEN 200 AND 900").orderBy("doc_id").limit(10).collect()]
    clean = [(i, f"{t} " * k) for i, t in enumerate(some) for k in (1, 60, 600)]
    r = random.Random(1)
    noise = [(-1, "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(500))), (-2, "xqzj kvvw pqrx " * 50), (-3, "日本語のテスト " * 30)]
    got = language_id.language_id(spark.createDataFrame(clean + noise, "doc_id long, text string"), models).collect()
    assert {r["doc_id"] for r in got if r["rejected"]} == {-1, -2, -3}


def plain_kernel(a, b):
    def phi(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if w[i].isalpha() and w[j].isalpha() and w[k].isalpha():
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = phi(a), phi(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(t, 0) for t, v in x.items()) / norm if norm else 0.0


def test_toxicity_equals_the_plain_machine(monkeypatch):
    """Scores from landmarks by definition: closest word, inverse root of the landmarks' kernels, margin, logistic scale; and the machine is at the least of its objective."""
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 5)
    insults = ["idiot", "moronic", "scumbag"]
    texts, toxic = [], []
    for i in range(200):
        w = words(30, i)
        if i % 4 == 0:
            w[i % 30] = insults[i % 3]
        texts.append(" ".join(w)), toxic.append(i % 4 == 0)
    machine = toxicity.fit(texts, np.array(toxic))
    marks = machine.landmarks
    gram = np.array([[plain_kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    near = lambda w: [k if (k := plain_kernel(w, m)) >= toxicity.NEAR else 0.0 for m in marks]
    plain = lambda t: np.max([near("".join(c for c in w)) for w in t.lower().split()], axis=0) @ root
    asked = texts[:12] + ["some idiots here", "nothing at all", "moronically speaking", "i.d.i.o.t"]
    z = np.array([plain(t) for t in asked])
    want = 1 / (1 + np.exp(-(machine.scale[0] * (z @ machine.weight[:-1] + machine.weight[-1]) + machine.scale[1])))
    assert machine.score(asked) == pytest.approx(want, abs=1e-3)
    x = np.hstack([machine.kernels.of(texts).astype(float) @ machine.root, np.ones((len(texts), 1))])
    y = np.where(toxic, 1.0, -1.0)
    cost = lambda w: 0.5 * (w[:-1] @ w[:-1]) + (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    r, least = np.random.default_rng(0), cost(machine.weight)
    assert all(cost(machine.weight + d) >= least - 1e-9 for d in r.normal(size=(50, len(machine.weight))) * 1e-3)


def test_training_is_bounded_with_repeated_ids(spark, monkeypatch):
    """One text of an id is read, and about so many bytes."""
    seen = []
    monkeypatch.setattr(toxicity, "written", lambda df, name: seen.append(df.collect()) or df)
    docs = spark.createDataFrame([(i % 4, f"text {i} idiot") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] * 5, "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert 0 < len(seen[0]) == len({r["doc_id"] for r in seen[0]}) <= 4
    monkeypatch.setattr(language_id, "written", lambda df, name: seen.append(df.collect()) or df)
    language_id.train(spark.createDataFrame([(i % 4, f"text {i}", "en") for i in range(400)], "doc_id long, text string, lang string"))
    assert 0 < len(seen[1]) == len({r["doc_id"] for r in seen[1]}) <= 4
    some = spark.createDataFrame([(i, "word " * 20, "en") for i in range(400)], "doc_id long, text string, lang string")
    whole, part = (language_id.Model.loads(language_id.train(some, most_bytes=n)[0][1]) for n in (1 << 30, 8000))
    assert len(whole.gram) == len(part.gram)
