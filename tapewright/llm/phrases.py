"""Phrase mining by hierarchical pair naming.

A batch of texts of one language becomes a sequence of small local codes, one a word, 0 between pieces. Level by level, the
adjacent names of two overlapping (k-1)-grams are a pair: a batch counts its own distinct pairs and sends them, packed, to the
ranges of their hashes; there all batches meet, frequent pairs get a global id, and each batch is told the ids of its own, so
that the next level looks at frequent names only. Texts aren't read again, and what is shuffled is a batch's distinct pairs,
not its words, so that a pair that stands everywhere is one entry a batch. An id's pair is
its two parents, the phrase without its last word and without its first: following them gives the counts of both sides of
every cut, and a phrase is contained in a longer frequent one as often as in its most frequent child.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import by_bytes, row_batches, small_batches, table, written

#: How texts are cut and folded, and what stands for a missing language.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
SCALE = 2_000_000
#: Bytes of text after which a task hands over the batches it has begun, one a language.
BATCH_BYTES = 16 << 20
#: Bytes that are cut into words at once.
CUT_BYTES = 1 << 20
#: Ranges of pairs' hashes for each shuffle partition; one range is counted at a time.
RANGES = 4
#: A language's best phrases are sought in so many parts first.
PARTS = 64

_FOLD = bytes(10 if c in PIECE_ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = pa.schema([("batch", pa.int64()), ("lang", pa.string()), ("code", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("codes", pa.binary())])
_LEVEL = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("id", pa.int64()), ("l", pa.int64()), ("r", pa.int64())])
_SHAPE = "range int, kind int, batch long, n long, data binary, id long, l long, r long"
#: Kinds of rows between levels: a frequent pair, what a batch is told of its pairs or sends of them, a batch's codes.
NAMED, PART, CODES = 0, 1, 2


def _sealed(codes: np.ndarray) -> tuple[int, bytes]:
    return len(codes), pa.compress(codes.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _opened(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<u4")


class _Codes(dict):
    """Words by code, from 2 on in order of their first place; 0 is the end of a piece, 1 nothing at all."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class _Batch:
    """The words of one language in a task, as codes."""

    def __init__(self, cut: int) -> None:
        self.codes, self.parts, self.cut = _Codes({b"\n": 0, b"": 1}), [], cut

    def add(self, text: str) -> None:
        data = text.encode().translate(_FOLD)
        start = 0
        while start < len(data):
            end = len(data)
            if end - start > self.cut:  # after a word, however long it is
                ends = [x for x in (data.find(b" ", start + self.cut), data.find(b"\n", start + self.cut)) if x >= 0]
                end = min(ends, default=end)
            words = data[start:end].replace(b"\n", b" \n ").split(b" ")
            got = np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words))
            self.parts.append(got[got != 1])
            start = end
        self.parts.append(np.zeros(1, np.uint32))

    def rows(self, batch: int, lang: str) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes, minlength=len(self.codes))
        n, data = _sealed(codes)
        yield pa.RecordBatch.from_pylist([{"batch": batch, "lang": lang, "n": n, "codes": data}], schema=_ROWS)
        words = list(self.codes)
        for i in range(2, len(words), 50_000):
            part = words[i : i + 50_000]
            k = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([batch] * k, pa.int64()), pa.array([lang] * k, pa.string()), pa.array(np.arange(i, i + k), pa.int32()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[i : i + k], pa.int64()), pa.nulls(k, pa.binary())], schema=_ROWS)


def _coded(most: int, cut: int):
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each batch with its codes, and one for each of its words."""
        task, made, held, open_ = TaskContext.get().partitionId(), 0, 0, {}
        for frame in by_bytes(frames):
            for text, lang in zip(frame.column("text").to_pylist(), frame.column("lang").to_pylist(), strict=True):
                if text:
                    open_.setdefault(lang, _Batch(cut)).add(text)
            held += pc.sum(pc.fill_null(pc.binary_length(frame.column("text")), 0)).as_py() or 0
            if held > most:
                for lang, b in open_.items():
                    yield from b.rows(task << 32 | made, lang)
                    made += 1
                open_, held = {}, 0
        for lang, b in open_.items():
            yield from b.rows(task << 32 | made, lang)
            made += 1

    return run


def _shut(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, byte by byte: bytes that are mostly equal take no room."""
    return pa.compress(b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _open(n: int, columns: int, data: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 8 * n * columns, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8")[:, 0] for p in planes]


def _mixed(l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    h = l.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ r.astype(np.uint64)
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(c)
    return h ^ (h >> np.uint64(33))


def _pairs(ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        """A batch's distinct pairs of adjacent named codes by range of their hashes, and its sequence in codes of those pairs."""
        batch, seq, code, ids = rows["batch"][0].as_py(), None, [], []
        plain = rows.filter(pc.equal(rows["kind"], NAMED))
        code.append(plain["n"].to_numpy()), ids.append(plain["id"].to_numpy())
        for kind, n, data in zip(*(rows[c].to_pylist() for c in ("kind", "n", "data")), strict=True):
            if kind == CODES:
                seq = _opened(n, data)
            elif kind == PART:
                for column, to in zip(_open(n, 2, data), (code, ids), strict=True):
                    to.append(np.cumsum(column) if to is code else column)
        code, ids = np.concatenate(code), np.concatenate(ids)
        if seq is None or not len(code):
            return _LEVEL.empty_table()
        known = np.zeros(max(int(seq.max(initial=0)), int(code.max())) + 1, np.int64)
        known[code] = np.arange(1, len(code) + 1)
        here = known[seq]
        both = (here[:-1] > 0) & (here[1:] > 0)
        u, inverse, n = np.unique(here[:-1][both] * (len(code) + 1) + here[1:][both], return_inverse=True, return_counts=True)
        left, right = ids[u // (len(code) + 1) - 1], ids[u % (len(code) + 1) - 1]
        of = ((_mixed(left, right) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((right, left, of))  # a pair's code is its place in this order, so a range's codes follow each other
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(1, len(order) + 1)
        new = np.zeros(len(both), np.uint32)
        new[both] = place[inverse]
        left, right, n, of = left[order], right[order], n[order], of[order]
        cuts = np.searchsorted(of, np.arange(ranges + 1))
        out = []
        for r in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
            a, z = int(cuts[r]), int(cuts[r + 1])
            out.append((r, PART, batch, z - a, _shut(np.diff(left[a:z], prepend=0), right[a:z], n[a:z]), a + 1, None, None))
        if out:
            size, data = _sealed(new)
            out.append((batch % ranges, CODES, batch, size, data, None, None, None))
        return pa.Table.from_batches(row_batches(out, _LEVEL), _LEVEL)

    return run


def _counted(least: int):
    def named(at: int, parts: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
        """Of one range: frequent pairs with their ids, and what each batch is told of its own."""
        sizes = [n for _, n, _, _ in parts]
        columns = [_open(n, 3, data) for _, n, _, data in parts]
        left, right, n = (np.concatenate(c) for c in ([np.cumsum(x[0]) for x in columns], [x[1] for x in columns], [x[2] for x in columns]))
        order = np.lexsort((right, left))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
        first = np.flatnonzero(fresh)
        total = np.add.reduceat(n[order], first)
        kept = total >= least
        number = np.where(kept, (at << 32) + np.cumsum(kept) - 1, -1)
        for i in np.flatnonzero(kept).tolist():
            j = order[first[i]]
            yield (at, NAMED, None, int(total[i]), None, int(number[i]), int(left[j]), int(right[j]))
        ids = np.empty(len(order), np.int64)
        ids[order] = number[np.cumsum(fresh) - 1]
        start = 0
        for (batch, _, base, _), size in zip(parts, sizes, strict=True):
            own = ids[start : start + size]
            start += size
            told = np.flatnonzero(own >= 0)
            if len(told):
                yield (at, PART, batch, len(told), _shut(np.diff(told + base, prepend=0), own[told]), None, None, None)

    def rows(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        at, parts = None, []
        for frame in frames:
            for r, kind, batch, n, data, base in zip(*(frame.column(c).to_pylist() for c in ("range", "kind", "batch", "n", "data", "id")), strict=True):
                if r != at and parts:
                    yield from named(at, parts)
                    parts = []
                at = r
                if kind == CODES:
                    yield (r, kind, batch, n, data, None, None, None)
                else:
                    parts.append((batch, n, base, data))
        if parts:
            yield from named(at, parts)

    return lambda frames: row_batches(rows(frames), _LEVEL)


def _named_words(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f) of frequent words, and the rows that tell each batch of its own."""
    words = rows.where("codes IS NULL")
    sums = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    named = written(sums.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "words-named")
    told = words.select("batch", "code", "lang", "word").join(named.drop("f"), ["lang", "word"]).select(F.lit(NAMED).alias("kind"), "batch", F.col("code").cast("long").alias("n"), "id")
    codes = rows.where("codes IS NOT NULL").select(F.lit(CODES).alias("kind"), "batch", "n", F.col("codes").alias("data"))
    return named, codes.unionByName(told, allowMissingColumns=True).select("kind", "batch", "n", "data", "id")


def _next_level(rows: DataFrame, ranges: int, least: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, l, r, f) of the frequent pairs of adjacent named codes, and the rows that tell each batch of its own."""
    sent = rows.groupBy("batch").applyInArrow(_pairs(ranges), _SHAPE).repartition("range").sortWithinPartitions("range")
    level = written(sent.mapInArrow(_counted(least), _SHAPE), name)
    return level.where(F.col("kind") == NAMED).select("id", "l", "r", F.col("n").alias("f")), level.where(F.col("kind") != NAMED).select("kind", "batch", "n", "data", "id")


def _phrases(named: DataFrame, shorter: DataFrame, name: str) -> DataFrame:
    """(id, lang, phrase, last, f, heads, tails, l, r): the counts of all beginnings and ends of a phrase, from those of its two parents."""
    p = shorter.select(F.col("id").alias("l"), "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
    s = shorter.select(F.col("id").alias("r"), "last", F.concat("tails", F.array("f")).alias("tails"))
    return written(named.join(p, "l").join(s, "r").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "heads", "tails", "l", "r"), name)


def _worst_cut(words: int) -> F.Column:
    """(score, k, l, r) of the cut with the lowest score, then the smallest k; the product of counts may pass 64 bits."""
    cuts = []
    for k in range(1, words):
        l, r = F.col("heads")[k - 1], F.col("tails")[words - k - 1]  # noqa: E741
        share = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * F.col("f").cast("decimal(20,0)"), (l.cast("decimal(20,0)") + r.cast("decimal(20,0)")))
        cuts.append(F.struct(share.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def phrase_mining(docs: DataFrame, most: int = 2000, least: int = 30, longest: int = 4, inside: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    A phrase of at least `least` occurrences scores floor(SCALE * a / (l + r)) at its worst cut; one that lies in a longer one
    with `inside` % of its count or more goes. Ties go by count, then by phrase in byte order. Null and empty texts have no
    words, a null lang is UNKNOWN, long texts are cut between words and read whole, repeated rows count each. An empty table, or
    one without phrases that are frequent, gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")).mapInArrow(_coded(BATCH_BYTES, CUT_BYTES), "batch long, lang string, code int, word string, n long, codes binary"), "words")
    totals = rows.where("codes IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named, rows = _named_words(rows, least)
    none = F.array().cast("array<bigint>")
    levels = [named.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))]
    for words in range(2, longest + 1):
        named, rows = _next_level(rows, ranges, least, f"pairs-{words}")
        levels.append(_phrases(named, levels[-1], f"phrases-{words}"))
    found = None
    for i, level in enumerate(levels[1:], 1):
        own = level.withColumn("cut", _worst_cut(i + 1))
        if i + 1 < len(levels):
            children = levels[i + 1].select(F.col("l").alias("id"), F.col("f").alias("child")).unionByName(levels[i + 1].select(F.col("r").alias("id"), F.col("f").alias("child")))
            own = own.join(children.groupBy("id").agg(F.max("child").alias("child")), "id", "left").where(F.coalesce(100 * F.col("child") < inside * F.col("f"), F.lit(True)))
        own = own.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        found = own if found is None else found.unionByName(own)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM p, (VALUES (1), (2), (3), (4)) AS v(m)),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
t AS (SELECT lang, sum(f) AS n FROM c WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (
  SELECT x.*, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts x JOIN c l ON l.lang = x.lang AND l.phrase = x.head JOIN c r ON r.lang = x.lang AND r.phrase = x.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, j, unnest([array_to_string(w[i:i + j - 1], ' ') FOR i IN range(1, m - j + 2)]) AS phrase FROM (SELECT *, unnest(range(2, m)) AS j FROM cand)),
held AS (SELECT lang, phrase, max(a) AS b FROM parts GROUP BY lang, phrase),
left_over AS (SELECT w.* FROM worst w LEFT JOIN held h ON w.lang = h.lang AND w.phrase = h.phrase WHERE h.b IS NULL OR 100 * h.b < 80 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""
