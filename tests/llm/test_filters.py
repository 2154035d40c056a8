"""Licence scans, URL rules, toxicity, languages, and the pipeline."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from compare import duck, rows
from fixtures import EDGES, edge_docs, words
from tapewright.llm import language_id, toxicity
from tapewright.llm.license_scan import OP4_SQL, PHRASES, TEMPLATES, license_scan, op4_license_scan
from tapewright.llm.url_filter import OP5_SQL, DigestFile, op5_url_filter, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENCES = [
    "Released under the MIT License. And UNDER THE mit-license, again; under the mit license",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0. apache license version",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "This program is free software: you can redistribute it and/or modify it under the terms of the General Public thing",
    "under the under the mit license", "mit license under the",
]


def test_licences_equal_brute_force(spark):
    texts = LICENCES + [t for _, t in EDGES]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in license_scan(docs).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[3]["labels"] == "mit" and got[3]["base_labels"] == ""
    assert got[4]["labels"] == "gpl" and got[5]["labels"] == ""  # a mandatory phrase is missing
    assert license_scan(docs.limit(0)).count() == 0


def test_licence_sql(spark, sf):
    assert rows(op4_license_scan(spark, sf).toPandas()) == rows(duck(sf).sql(OP4_SQL).df())


def licence_texts():
    """Every passage: whole, spoilt in up to a quarter of its words, cut at either end, beside others, among other words; and whole headers as files have them."""
    r = random.Random(4)
    out = list(LICENCES)
    for t, (_, text, _) in enumerate(TEMPLATES):
        w = text.split()
        out += [text, " ".join(words(30, t)) + " " + text.upper().replace(" ", "\n * ", 3) + ". " + " ".join(words(20, t + 1)), " ".join(w[1:]), " ".join(w[len(w) // 6 :]), " ".join(w[:-1]), text + " " + text]
        for _ in range(4):
            spoilt = list(w)
            for i in r.sample(range(len(w)), r.randint(1, 1 + len(w) // 4)):
                spoilt[i] = r.choice(["other", "license", "the", "software"])
            out.append("x " + " ".join(spoilt))
        out.append(" ".join(w[: len(w) // 2] + ["and", "more"] + w[len(w) // 2 :]))
    for _ in range(40):
        out.append(" -- ".join(r.choice(TEMPLATES)[1] for _ in range(r.randint(2, 5))))
    out.append("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice")
    out.append("/* SPDX-License-Identifier: Apache-2.0 */ // SPDX-License-Identifier: MIT")
    return out


def test_licence_passages_by_query_and_sql(spark, tmp_path):
    texts = licence_texts()
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = op4_license_scan(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(OP4_SQL).df())
    by = dict(zip(got["doc_id"], got["labels"], strict=True))
    at = {t: i for i, t in enumerate(texts)}
    assert all(label in by[at[text]].split(",") for label, text, _ in TEMPLATES)
    assert {x for v in by.values() for x in v.split(",") if x} == {label for label, _, _ in TEMPLATES}
    assert by[len(texts) - 2] == "bsd" and by[len(texts) - 1] == "apache-2,mit"
    assert (got["labels"] != got["base_labels"]).sum() > 200 and ((got["score"] > 0) & (got["score"] < 1)).sum() > 50 and (got["score"] == 0).sum() > 50


def test_url_sql(spark, sf):
    assert rows(op5_url_filter(spark, sf).toPandas()) == rows(duck(sf).sql(OP5_SQL).df())


URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "https://a.example.org/en/12?x", "https://notexample.org/es/", "https://org", "https://x.org?q=/es/", "https://b.com/fr/x#f", "https://com/de/", "x://y://z.com/de/"]


@pytest.mark.parametrize("most", [1000, 0])
def test_urls_either_way(spark, most):
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(URLS)] + [(0, URLS[5], "r", 1)], "page_id long, url string, rule string, row int")
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/de/", "allow"), (None, "block")], "rule string, verdict string")
    got = url_filter(pages, rules, most_rules=most)
    want = [(0, "", "", None, "allow"), (0, "a.example.org", "/en/12", "example.org/en/1", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.org", "/es/1", "example.org/es/", "block"),
            (5, "a.example.org", "/en/12", "example.org/en/1", "block"), (6, "notexample.org", "/es/", "org/", "allow"), (7, "org", "", None, "allow"), (8, "x.org", "", None, "allow"), (9, "b.com", "/fr/x", "com/fr/", "allow"), (10, "com", "/de/", "com/de/", "block"), (11, "y:", "//z.com/de/", None, "allow")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert url_filter(pages.limit(0), rules, most_rules=most).count() == 0


def test_equal_digests_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr("tapewright.llm.url_filter.digest", lambda key: len(key))  # many collisions
    DigestFile.write(str(tmp_path / "r"), {"ab/": [1], "cd/": [7, 8], "xyz/": [], "": [5]})
    f = DigestFile(str(tmp_path / "r"))
    assert [f.values(int(f.find([k])[0])) for k in ("ab/", "cd/", "xyz/", "")] == [[1], [7, 8], [], [5]]
    assert [int(x) for x in f.find(["cd/", "ab/", "zz/", "q/", "xyz/"]) >= 0] == [1, 1, 0, 0, 1]


INSULTS = ["idiot", "moronic", "scumbag"]


def toxic_rows(n=400):
    out = []
    for i in range(n):
        w = words(40, i)
        if i % 4 == 0:
            w[i % 40] = INSULTS[i % 3]
        out.append((i, " ".join(w), i % 4 == 0))
    return out


def test_toxicity_learns_insults_and_their_disguises(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in toxic_rows()], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(y), 1) for i, _, y in toxic_rows()] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    held = [(i, y) for i, _, y in toxic_rows() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    asked = ["you i.d.i.o.t here", "you id-iot here", "you idxiot here", "a i d i o t there", "IDIOT!", "what an idi00ot"]
    scored = toxicity.toxicity(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    assert all(r["predicted"] == 1 for r in scored), [(asked[r["doc_id"]], r["score"]) for r in scored]
    edges = toxicity.toxicity(edge_docs(spark), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in edges)
    none = toxicity.train(docs.limit(0), labels)
    assert toxicity.toxicity(docs.limit(3), none).count() == 3


def test_gap_kernel_equals_its_definition():
    def phi(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if w[i].isalpha() and w[j].isalpha() and w[k].isalpha():
                        out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    names = ["idiot", "i.d.i.o.t", "banana"]
    own = toxicity.embedded(names)
    for a in range(3):
        for b in range(3):
            x, y = phi(names[a]), phi(names[b])
            want = sum(x[t] * y[t] for t in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            assert own[:, a] @ own[:, b] == pytest.approx(want, abs=1e-5)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = language_id.train(docs)
    got = language_id.language_id(docs, models).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    edges = {r["doc_id"]: r for r in language_id.language_id(edge_docs(spark), models).collect() if r["doc_id"] != 11}
    assert all(edges[i]["lang_pred"] == "und" and edges[i]["score"] == 0 and edges[i]["rejected"] for i in (1, 2, 3, 10))
    assert edges[0]["lang_pred"] != "und"
    assert language_id.train(docs.limit(0)) == []
    assert {r["lang_pred"] for r in language_id.language_id(docs.limit(3), []).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0), models).count() == 0


def test_kneser_ney_sums_to_one():
    model = language_id.fit({"abba": 5, "abc": 3, "cab": 2})
    alphabet = "abc" + language_id.END
    for context in ("", "a", "ab", "abb"):
        total = 0.0
        for c in alphabet:
            grams, contexts, _ = language_id.hashes([context + (c if c != language_id.END else "")])
            at = len(context)
            total += float(np.exp(model.log_p(grams[:, [at]], contexts[:, [at]]))[0])
        left = 1 - (500 - len(alphabet)) / 500 * 0.5
        assert 0.5 < total <= 1.0001 and left > 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        ids = kept.select("doc_id")
        assert ids.exceptAll(docs.select("doc_id")).count() == 0
        assert kept.count() <= docs.count(), name
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    """What the dedup and packing stages keep, from the rows that the trained stages keep."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf).persist()
    own = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    best = {}
    for i, t in own.items():
        bare = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[bare] = min(best.get(bare, (1, 0)), (-len(t), i))
    left = {i: own[i] for _, i in best.values()}
    from tapewright.llm.minhash_dedup import shingle_sets

    sets = {i: set(s.tolist()) for i, s in zip(left, shingle_sets(list(left.values())), strict=True)}
    parent = {i: i for i in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(left)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    want = {i for i in ids if root(i) == i}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert got == want




@pytest.mark.parametrize("ids", [0, corpus_pipeline.BROADCAST_IDS])
def test_pipeline_tells_rows_of_files_apart(spark, sf, tmp_path, monkeypatch, ids):
    """Documents read from files: of rows equal in everything one stays, by broadcast and by shuffle."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", ids)
    text = [" ".join(words(60, 500 + i)) for i in range(4)]
    data = [(1, text[0], 9, "a"), (1, text[0], 9, "a"), (2, text[1], 9, "a"), (2, text[2], 9, "a"), (None, text[0], 9, "a"), (3, text[3] + " tail", 9, "a"), (4, text[3], 9, "a"), (5, None, 9, "a"), (6, "", 9, "a")]
    spark.createDataFrame(data, "doc_id long, text string, file int, row string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    exact = corpus_pipeline.drop_copies(spark, docs, sf)
    assert exact.columns == docs.columns
    assert Counter(r["doc_id"] for r in exact.collect()) == Counter([1, 2, 2, 3, 4, 5])
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert near.columns == docs.columns
    assert Counter(r["doc_id"] for r in near.collect()) == Counter([1, 2, 2, 3, 5, 6])


def test_pipeline_drops_rows_and_not_ids(spark, sf):
    """Repeated rows, repeated ids with other texts and null ids: of each class of copies exactly one row stays."""
    base = [words(80, 900 + i) for i in range(5)]
    near = lambda i, k: " ".join([*base[i][:k], "edit", *base[i][k + 1 :]])
    text = [" ".join(w) for w in base]
    schema = "doc_id long, text string, row string"
    copies = [(5, text[0]), (5, text[0]), (7, text[0]), (1, text[1]), (2, text[1]), (2, text[2]), (None, text[3]), (None, text[3]), (None, text[0]), (9, text[4])]
    docs = spark.createDataFrame([(*x, "r") for x in copies], schema).repartition(3)
    kept = corpus_pipeline.drop_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, text[0]), (1, text[1]), (2, text[2]), (None, text[3]), (9, text[4])])
    rows = [(5, text[0]), (5, near(0, 40)), (1, text[1]), (2, near(1, 40)), (2, text[2]), (None, near(2, 30)), (None, text[3]), (None, near(3, 40)), (9, text[4])]
    docs = spark.createDataFrame([(*x, "r") for x in rows], schema).repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert {x for x in kept if x[0] in (1, 2, 9)} == {(1, text[1]), (2, text[2]), (9, text[4])}
    assert sum(kept.values()) == 5 and sum(x[0] == 5 for x in kept) == 1 and sum(x[0] is None for x in kept) == 1


def test_every_licence_of_several_is_found():
    """All pairs of passages in one text, all triples and quadruples of the first 22, and passages with a fifth of their words changed."""
    from itertools import combinations

    from tapewright.llm.license_scan import TEMPLATES, Index, words_of

    index = Index(TEMPLATES, PHRASES, {b"license": 3, b"software": 2}, 1000)
    for n in (1, 2, 3, 4):
        for some in combinations(TEMPLATES if n <= 2 else TEMPLATES[:22], n):
            text = " and then some other words ".join(t for _, t, _ in some)
            assert index.scan(words_of(text))[4] >= {label for label, _, _ in some}, some
    everything = " between ".join(t for _, t, _ in TEMPLATES)
    for t, (label, template, must) in enumerate(index.templates):
        held = {i for p in must for i in range(len(template)) if template[i : i + len(p)] == p for i in range(i, i + len(p))}
        free = [i for i in index.rare[t] if i not in held][: len(template) - index.enough[t]]
        changed = [b"changed" if i in free else w for i, w in enumerate(template)]
        others = words_of(" between ".join(x for k, (_, x, _) in enumerate(TEMPLATES) if index.templates[k][0] != label))
        assert label in index.scan([*others, b"x", *changed])[4]
    assert index.scan(words_of(everything))[4] == {label for label, _, _ in TEMPLATES}


@pytest.mark.parametrize("most", [100_000, 0])
def test_rules_of_very_many_lengths(spark, monkeypatch, most):
    import tapewright.llm.url_filter as urls

    monkeypatch.setattr(urls, "KEYS_HELD", 1000)
    pages = spark.createDataFrame([(1, "http://w.a.com/" + "x" * 10_020), (2, "http://a.com/" + "x" * 30_000), (3, "http://b.com/xx")], "page_id long, url string")
    rules = spark.range(10_050).selectExpr("concat('a.com/', repeat('x', CAST(id AS int))) AS rule", "if(id % 2 = 0, 'block', 'allow') AS verdict").unionByName(spark.createDataFrame([("noslash", "block")], "rule string, verdict string"))
    got = {r["page_id"]: (len(r["rule"] or ""), r["verdict"]) for r in url_filter(pages, rules, most_rules=most).collect()}
    assert got == {1: (10_026, "block"), 2: (10_055, "allow"), 3: (0, "allow")}
