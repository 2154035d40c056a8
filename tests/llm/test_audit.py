"""The filter audit against SQL and a plain replay."""

import re
from itertools import permutations

from compare import duck, rows
from fixtures import EDGES, edge_docs, words
from tapewright.llm.filter_audit import OP13_SQL, filter_audit, op13_filter_audit


def test_sql(spark, sf):
    assert rows(op13_filter_audit(spark, sf).toPandas()) == rows(duck(sf).sql(OP13_SQL).df())


def plain(docs, labels):
    """docs: (id, text, lang); every order replayed document by document."""
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        smaller = [j for j, u, _ in docs if (u or "") == t and j is not None and (i is None or j < i)]
        upper = sum("A" <= c <= "Z" for c in t)
        said = [(q, x) for j, q, x in labels if j == i and i is not None]
        fails.append((lang or "", {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * upper > 10 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": bool(smaller)}, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out = {}
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, c in enumerate(order, 1):
                here = [f for f in left if f[1][c]]
                left, before = [f for f in left if not f[1][c]], gone
                gone = gone + here
                alone = sum(f[1][c] and sum(f[1].values()) == 1 for f in fails if f[0] == part)
                out[part, order, step] = [len(left), len(here), sum(f[1][c] for f in before), alone, sum(f[2] for f in here), sum(f[3] for f in here)]
    return out


def test_edges_equal_plain_replay(spark):
    more = [(100 + i, " ".join(words(90 + i * 4, i)) + (" 5%" if i % 3 == 0 else "") + (" AB CD EF GH" * (i % 4) * 3), [None, "fr", "en"][i % 3]) for i in range(12)]
    docs = [(i, t, "en") for i, t in EDGES] + more + [(200, more[0][1], "fr"), (200, more[0][1], "fr"), (None, more[1][1], None), (7, more[0][1], "en")] * 2
    labels = [(100, 1, 0), (101, 0, 1), (103, None, 1), (103, 1, None), (200, 0, 1), (None, 1, 1), (7, 1, 1), (12, 1, 0)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, lang string, fails int").repartition(5)
    got = filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(docs, labels)
    assert len(got) == len(want)
    shapley = {}
    for (part, order, step), v in want.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    for r in got:
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == want[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_nothing(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.limit(0), none).count() == 0
    assert filter_audit(docs, none).count() == 600
