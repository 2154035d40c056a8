"""Licence scans by a positional index of rare tokens.

Templates (characteristic passages of licences, several a licence, and their identifiers) are indexed by word and position. A
first pass counts over all documents how many hold each template word, which gives the words' inverse document frequencies.
The second pass looks up a file's words among the rarest ones of each template, gathers the positions at which those words
would put a template's beginning, and takes a beginning that two of them agree on (or one, where the template has one such word); it is a match if enough of the template's words
stand at their places and all of its mandatory key phrases occur there. So many of a template's words are looked up that two
of them are at their places wherever enough of all its words are; a file that holds too few of them is passed over.

The phrases asked for by name are found beside it at all their places, from the position of their rarest word.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import by_bytes, small_batches, table

#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Passages by label: (label, passage, mandatory phrases in it).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("artistic-2", "this program is free software you can redistribute it and or modify it under the terms of the artistic license", ["artistic license"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ["endorse or promote products derived from this software"]),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["without a written agreement is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["without any express or implied warranty"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies or substantial portions"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed under the license is distributed on an as is basis"]),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ["each contributor hereby grants to you a perpetual worldwide", "copyright license to reproduce"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["in the hope that it will be useful", "gnu general public license for more details"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["copy of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["copy of the gnu lesser general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ["copy of the gnu affero general public license"]),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version", ["interacting with it remotely through a computer network"]),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", ["a copy of the mpl was not distributed with this file"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell or distribute this software"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["you must not claim that you wrote the original software"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked as such"]),
    ("bsl-1", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", ["machine executable object code generated by a source language processor"]),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights", ["waives abandons and surrenders all of affirmer s copyright"]),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", ["distribute your contributions under the same license as the original"]),
    ("ofl-1", "original or modified versions of the font software may be bundled redistributed and or sold with any software provided that each copy contains the above copyright notice and this license", ["versions of the font software may be bundled redistributed and or sold"]),
    ("postgresql", "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", ["this paragraph and the following two paragraphs appear in all copies"]),
    ("artistic-2", "you may distribute verbatim copies of the source form of the standard version of this package in any medium without restriction either gratis or for a distributor fee", ["source form of the standard version of this package"]),
]
#: Identifiers by label, as a file's first lines have them.
IDENTIFIERS = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"),
    ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("isc", "isc"), ("unlicense", "unlicense"),
    ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc0", "cc0 1 0"), ("bsl-1", "bsl 1 0"),
    ("epl-2", "epl 2 0"), ("ofl-1", "ofl 1 1"), ("postgresql", "postgresql"), ("zlib", "zlib"), ("artistic-2", "artistic 2 0"),
]
TEMPLATES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for label, name in IDENTIFIERS]
#: The share of a template's words that must stand at their places.
LEAST = 0.8

#: A-Z to a-z, other ASCII that is neither letter nor digit to a space; bytes beyond ASCII stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of letters and digits of ASCII and of anything beyond it."""
    return text.encode().translate(_WORDS).split()


class Index:
    def __init__(self, templates, phrases, frequency: dict[bytes, int], n_docs: int):
        self.idf = lambda w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1))
        self.templates = [(label, words_of(text), [words_of(p) for p in must]) for label, text, must in templates]
        self.known = {w for _, words, _ in self.templates for w in words}
        self.needed = [2 if len(set(words)) > 1 else 1 for _, words, _ in self.templates]
        self.counts = [Counter(words) for _, words, _ in self.templates]
        #: how many of a template's words must stand at their places, and the places of its rarest words that are looked up
        self.enough = [next(n for n in range(len(words) + 1) if n >= LEAST * len(words) or n / len(words) >= LEAST) for _, words, _ in self.templates]
        self.rare = [
            sorted(range(len(words)), key=lambda i: (-self.idf(words[i]), words[i], i))[: len(words) - enough + needed]
            for (_, words, _), enough, needed in zip(self.templates, self.enough, self.needed, strict=True)
        ]
        #: templates by the words that are looked up, once for each of their places
        self.postings: dict[bytes, list[int]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            for i in self.rare[t]:
                self.postings.setdefault(words[i], []).append(t)
        self.phrases = []
        for text, label in phrases:
            words = words_of(text)
            anchor = min(range(len(words)), key=lambda i: (-self.idf(words[i]), i))
            self.phrases.append((words, label, anchor))

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """(places of phrases, first, last, labels of phrases, labels of templates, score)."""
        own = self.known.intersection(words)
        places: list[int] = []
        base: set[str] = set()
        where: dict[bytes, list[int]] = {}

        def at(w: bytes) -> list[int]:
            if w not in where:
                found, i = [], -1
                try:
                    while True:
                        i = words.index(w, i + 1)
                        found.append(i)
                except ValueError:
                    where[w] = found
            return where[w]

        for phrase, label, anchor in self.phrases:
            for i in at(phrase[anchor]):
                if i >= anchor and words[i - anchor : i - anchor + len(phrase)] == phrase:
                    places.append(i - anchor)
                    base.add(label)
        found, best = set(), 1.0 if base else 0.0
        votes: Counter = Counter()
        hits = Counter(t for w in own if w in self.postings for t in self.postings[w])
        for t, n in hits.items():
            template = self.templates[t][1]
            if n >= self.needed[t] and sum(m for w, m in self.counts[t].items() if w in own) >= self.enough[t]:
                for position in self.rare[t]:
                    if template[position] in own:
                        for i in at(template[position]):
                            votes[t, i - position] += 1
        for (t, start), n in votes.items():
            label, template, must = self.templates[t]
            if n < self.needed[t]:
                continue
            same = sum(words[start + k] == w for k, w in enumerate(template) if 0 <= start + k < len(words))
            score = same / len(template)
            if score >= LEAST:
                span = words[max(0, start) : start + len(template)]
                if all(any(span[i : i + len(p)] == p for i in range(len(span) - len(p) + 1)) for p in must):
                    found.add(label)
                    best = max(best, score)
        return len(places), min(places, default=None), max(places, default=None), base, found, best


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of a small vocabulary occurs, and how many documents there are. The result has as many rows as the vocabulary."""

    def count(batches):
        seen, n = Counter(), 0
        for batch in by_bytes(batches, "text"):
            for text in batch.column("text").to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    got = docs.select(docs[text_col].alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {bytes(r["word"]) if r["word"] is not None else None: r["n"] for r in got}
    return {w: n for w, n in by_word.items() if w is not None}, by_word.get(None, 0)


def license_scan(docs: DataFrame, templates=None, phrases=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    A null or empty text has no words, no places, empty labels and score 0. The score is the best template's share of words
    at their places, and 1 where a phrase stands. Long texts are scanned whole, repeated rows each; an empty table gives an
    empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = {w for _, text, _ in templates for w in words_of(text)} | {w for text, _ in phrases for w in words_of(text)}
    frequency, n_docs = word_frequencies(docs, vocabulary, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        index = Index(templates, phrases, frequency, n_docs)
        for batch in by_bytes(batches, "text"):
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                n_base, first, last, base, found, score = index.scan(words)
                for column, x in zip(rows, (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | found)), score), strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(scan, f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join(f"({', '.join(str(x) if isinstance(x, int) else repr(x) for x in r)})" for r in rows)


#: Templates match where LEAST of their words stand at their places and the words there hold all mandatory phrases.
OP4_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS nth FROM w),
phrases(phrase, label, word, n) AS (VALUES {_values((p, label, p.split()[0], len(p.split())) for p, label in PHRASES)}),
base AS (SELECT w.doc_id, label, nth FROM places JOIN phrases USING (word) JOIN w ON w.doc_id = places.doc_id AND array_to_string(ws[nth + 1:nth + n], ' ') = phrase),
based AS (SELECT doc_id, count(*) AS n_base, min(nth) AS first_word, max(nth) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
template(t, label, word, place, n) AS (VALUES {_values((t, label, w, k, len(text.split())) for t, (label, text, _) in enumerate(TEMPLATES) for k, w in enumerate(text.split()))}),
must(t, phrase) AS (VALUES {_values((t, p) for t, (_, _, ps) in enumerate(TEMPLATES) for p in ps)}),
votes AS (SELECT doc_id, t, label, nth - place AS start, n, CAST(count(*) AS DOUBLE) / n AS share FROM places JOIN template USING (word) GROUP BY doc_id, t, label, nth - place, n HAVING CAST(count(*) AS DOUBLE) / n >= {LEAST}),
held AS (SELECT votes.*, ' ' || array_to_string(ws[greatest(start, 0) + 1:start + n], ' ') || ' ' AS span FROM votes JOIN w USING (doc_id)),
matched AS (SELECT doc_id, label, share FROM held WHERE NOT EXISTS (SELECT 1 FROM must WHERE must.t = held.t AND NOT contains(span, ' ' || phrase || ' '))),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, share AS score FROM matched UNION ALL SELECT doc_id, label, 1.0 FROM base) AS u GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""
