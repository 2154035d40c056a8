"""Removal of passages that repeat across documents, by fixed-block anchors.

A window is `window` consecutive words; a block half as many. Every window holds a block that begins at a multiple of the
block's length, so documents are indexed by those blocks alone, which don't overlap, and every rolling block of every document
probes the index:

1. A task hashes the rolling blocks of a batch of documents and sends each distinct one once, with the batch's place of it: a
   passage that many documents share costs a batch one probe. Places that repeat it stay with the batch.
2. Per range of hashes, probes meet the blocks of the smallest document; what hits goes back to its batch.
3. Hits of one document on one diagonal whose blocks follow each other are extended to maximal repeats: they are wholly equal.
   Only at the ends of such repeats are there windows still to be judged. Those, and the windows around the blocks they hit,
   are hashed (128 bits) in one pass over the texts of the documents concerned; the smallest document of each is its owner.
4. Words in a repeat, or in a window with a smaller owner, go.

No pairs of documents are made: a passage shared by n documents is n rows at each step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import by_bytes, row_batches, small_batches, steady, table, written

#: A missing id counts as this one, after all others.
NO_ID = 2**63 - 1
#: Bytes of words hashed at once; a longer run of them has a hash of its own.
HASHED = 1 << 20
#: Bytes of text in a batch: at least, at most, and for each range of hashes.
BATCH_LEAST, BATCH_MOST, BATCH_SHARE = 2 << 20, 32 << 20, 10_000
#: Ranges of hashes for each shuffle partition.
RANGES = 4

_PRINT = (1 << 40) - 1
_BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_ROWS = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
_BLOCKS = np.dtype([("m", "<u8"), ("id", "<i8"), ("t", "<i8"), ("at", "<i4"), ("place", "<u4")])
_HITS = np.dtype([("place", "<u4"), ("at", "<i4"), ("id", "<i8"), ("t", "<i8")])
_NEEDS = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("spans", pa.binary()), ("starts", pa.binary()), ("at", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("s", pa.int32())])


class _Rolling:
    """Two 64-bit hashes of byte ranges: polynomials in an odd base over random values of bytes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(12)
        self.values = [rng.integers(0, 1 << 64, 256, np.uint64) for _ in range(2)]
        self.bases = [int(rng.integers(0, 1 << 62)) * 4 + 3 for _ in range(2)]
        self.powers, self.inverses = ([self._powers(f(b)) for b in self.bases] for f in (int, lambda b: pow(b, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(HASHED + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """Hashes of data[start:end], both in order."""
        out = np.zeros(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            a = int(starts[i])
            k = int(np.searchsorted(ends, a + HASHED, "right"))
            if k <= i:
                h = xxhash.xxh3_128_intdigest(data[a : int(ends[i])].tobytes())
                out[i] = np.uint64(h >> 64 if which else h & (1 << 64) - 1)
                i += 1
                continue
            part = data[a : int(ends[k - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.values[which][part] * self.powers[which][: len(part)], out=sums[1:])
            low = starts[i:k] - a
            out[i:k] = (sums[ends[i:k] - a] - sums[low]) * self.inverses[which][low]
            i = k
        return out


_rolling: list[_Rolling] = []


def rolling() -> _Rolling:
    if not _rolling:
        _rolling.append(_Rolling())
    return _rolling[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each with one blank after it, and where each word starts and ends."""
    x = np.frombuffer(text.translate(_BLANK), np.uint8)
    blank = x == 32
    before = np.empty_like(blank)
    before[:1], before[1:] = True, blank[:-1]
    x = x[~(blank & before)]
    if len(x) and x[-1] != 32:
        x = np.append(x, np.uint8(32))
    ends = np.flatnonzero(x == 32)
    starts = np.empty_like(ends)
    starts[:1], starts[1:] = 0, ends[:-1] + 1
    return x, starts, ends


def _grams(text: bytes, n: int, which: int = 0, at: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Hashes of the runs of n words that start at `at` (all if None), and the number of words."""
    x, starts, ends = words_of(text)
    at = np.arange(max(len(ends) - n + 1, 0)) if at is None else at
    return rolling()(x, starts[at], ends[at + n - 1], which) if len(at) else np.zeros(0, np.uint64), len(ends)


class _Batch:
    """Documents of a task whose rolling blocks are sent together."""

    def __init__(self, window: int) -> None:
        self.window, self.block, self.hashes, self.docs, self.held = window, (window + 1) // 2, [], [], 0

    def add(self, doc: int, t: int, text: str) -> None:
        data = text.encode()
        h, n = _grams(data, self.block)
        self.held += len(data)
        if n >= self.window:
            self.docs.append((doc, t, n))
            self.hashes.append(_mixed(h))

    def rows(self, batch: int, ranges: int) -> Iterator[tuple]:
        if not self.docs:
            return
        docs = np.array(self.docs, np.int64)
        offsets = np.concatenate([[0], np.cumsum(docs[:, 2])])
        lengths = [len(h) for h in self.hashes]
        m = np.concatenate(self.hashes)
        of = np.repeat(np.arange(len(docs)), lengths)
        at = np.concatenate([np.arange(n) for n in lengths])
        place = offsets[of] + at
        order = np.argsort(m, kind="stable")
        fresh = np.ones(len(m), bool)
        fresh[1:] = m[order][1:] != m[order][:-1]
        leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(m)), 0))]
        again = np.column_stack([place[leader[~fresh]], place[order[~fresh]]]).astype("<u4")
        yield (batch % ranges, 2, batch, docs.astype("<i8").tobytes(), again.tobytes())
        own = np.flatnonzero(at % self.block == 0)
        blocks = np.zeros(len(own), _BLOCKS)
        blocks["m"], blocks["id"], blocks["t"], blocks["at"], blocks["place"] = m[own], docs[of[own], 0], docs[of[own], 1], at[own], place[own]
        blocks.sort(order=["m", "id", "t", "at"])
        blocks = blocks[np.concatenate([[True], blocks["m"][1:] != blocks["m"][:-1]])]
        range_of = lambda v: ((v >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(range_of(blocks["m"]), np.arange(ranges + 1))
        sent = np.sort(order[fresh])
        sent_range = range_of(m[sent])
        by_range = np.argsort(sent_range, kind="stable")
        cuts = np.searchsorted(sent_range[by_range], np.arange(ranges + 1))
        prints = (m[sent] & np.uint64(_PRINT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        for r in range(ranges):
            if bounds[r] < bounds[r + 1]:
                yield (r, 0, batch, blocks[bounds[r] : bounds[r + 1]].tobytes(), None)
            mine = by_range[cuts[r] : cuts[r + 1]]
            if len(mine):
                gaps = np.diff(place[sent[mine]], prepend=0).astype("<u4")  # places as steps, whose upper bytes are mostly 0
                yield (r, 1, batch, prints[mine].tobytes(), gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _sent(window: int, ranges: int):
    """Rows of kind 0 (blocks), 1 (probes) and 2 (documents of a batch)."""
    most = min(BATCH_MOST, max(BATCH_LEAST, BATCH_SHARE * ranges))

    def send(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        task, made, batch = TaskContext.get().partitionId(), 0, _Batch(window)
        for frame in by_bytes(frames):
            for doc, t, text in zip(*(frame.column(c).to_pylist() for c in ("id", "t", "text")), strict=True):
                batch.add(doc, t, text)
            if batch.held > most:
                yield from batch.rows(task << 32 | made, ranges)
                made, batch = made + 1, _Batch(window)
        yield from batch.rows(task << 32 | made, ranges)

    return lambda frames: row_batches(send(frames), _ROWS)


def _hit(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return row_batches(_hits(frames), _ROWS)


def _hits(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows in order of range and kind: blocks are gathered for one range at a time, then probes stream past them."""
    held, at = [], None
    blocks = None
    for frame in frames:
        for r, kind, batch, data, more in zip(*(frame.column(c).to_pylist() for c in _ROWS.names), strict=True):
            if r != at:
                held, at, blocks = [], r, None
            if kind == 0:
                held.append((batch, np.frombuffer(data, _BLOCKS)))
            elif kind == 2:
                yield (0, 2, batch, data, more)
            elif held or blocks is not None:
                if blocks is None:
                    blocks, held = _smallest(held), []
                batches, found, prints = blocks
                asked = np.zeros((len(data) // 5, 8), np.uint8)
                asked[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
                asked = asked.view("<u8")[:, 0]
                low, high = np.searchsorted(prints, asked, "left"), np.searchsorted(prints, asked, "right")
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                times = high[hit] - low[hit]
                entry = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                places = np.cumsum(np.frombuffer(more, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0], dtype=np.uint32)
                out = np.zeros(len(entry), _HITS)
                out["place"] = np.repeat(places[hit], times)
                for c in ("at", "id", "t"):
                    out[c] = found[c][entry]
                out = out[(batches[entry] != batch) | (found["place"][entry] != out["place"])]  # a block of its own doesn't count
                if len(out):
                    yield (0, 1, batch, out.tobytes(), None)


def _smallest(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each block's entry of the smallest document, in order of what probes see of its hash."""
    batches = np.repeat(np.array([b for b, _ in held], np.int64), [len(x) for _, x in held])
    found = np.concatenate([x for _, x in held])
    order = np.lexsort((found["at"], found["t"], found["id"], found["m"]))
    m = found["m"][order]
    order = order[np.concatenate([[True], m[1:] != m[:-1]])]
    order = order[np.argsort(found["m"][order] & np.uint64(_PRINT), kind="stable")]
    return batches[order], found[order], found["m"][order] & np.uint64(_PRINT)


def _ranges_marked(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [low, high)."""
    step = np.zeros(n + 1, np.int64)
    ok = low < high
    np.add.at(step, low[ok], 1), np.add.at(step, high[ok], -1)
    return np.cumsum(step[:-1]) > 0


def _judged(window: int):
    """Of a batch's documents and hits: repeats that are certain, windows to hash, and the blocks whose windows they may equal."""
    block = (window + 1) // 2

    def judge(rows: pa.Table) -> pa.Table:
        docs = again = None
        hits = [np.zeros(0, _HITS)]
        for kind, data, more in zip(*(rows[c].to_pylist() for c in ("kind", "data", "more")), strict=True):
            if kind == 2:
                docs, again = np.frombuffer(data, "<i8").reshape(-1, 3), np.frombuffer(more, "<u4").reshape(-1, 2)
            else:
                hits.append(np.frombuffer(data, _HITS))
        hits = np.concatenate(hits)
        offsets = np.concatenate([[0], np.cumsum(docs[:, 2])])
        doc_of = lambda place: np.searchsorted(offsets, place, "right") - 1
        if len(again):  # the batch's other places of what was sent once
            hits.sort(order="place")
            low, high = np.searchsorted(hits["place"], again[:, 0], "left"), np.searchsorted(hits["place"], again[:, 0], "right")
            times = high - low
            entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            copied = hits[entry]
            copied["place"] = np.repeat(again[:, 1], times)
            of = doc_of(again[:, 0])
            at = again[:, 0] - offsets[of]
            whole = at % block == 0
            own = np.zeros(int(whole.sum()), _HITS)
            own["place"], own["at"], own["id"], own["t"] = again[whole, 1], at[whole], docs[of[whole], 0], docs[of[whole], 1]
            hits = np.concatenate([hits, copied, own])
        of = doc_of(hits["place"])
        me, mine = docs[of, 0], docs[of, 1]
        ok = (hits["id"] < me) | ((hits["id"] == me) & (hits["t"] < mine))
        hits, of, me = hits[ok], of[ok], me[ok]
        if not len(hits):
            return _NEEDS.empty_table()
        q = hits["place"].astype(np.int64) - offsets[of]
        diagonal = q - hits["at"]
        order = np.lexsort((q, diagonal, hits["t"], hits["id"], of))
        hits, of, me, q, diagonal = hits[order], of[order], me[order], q[order], diagonal[order]
        same = np.zeros(len(q), bool)
        same[1:] = (of[1:] == of[:-1]) & (hits["id"][1:] == hits["id"][:-1]) & (hits["t"][1:] == hits["t"][:-1]) & (diagonal[1:] == diagonal[:-1])
        linked = same.copy()
        linked[1:] &= (q[1:] - q[:-1] == block) & (hits["id"][1:] < me[1:])
        first = np.flatnonzero(~linked)
        last = np.append(first[1:], len(q)) - 1
        long = first < last
        total = int(offsets[-1])
        begin, end = offsets[of[first[long]]] + q[first[long]], offsets[of[last[long]]] + q[last[long]] + block
        certain = _ranges_marked(total, begin, end - window + 1)
        low, high = offsets[of] + np.maximum(q - (window - block), 0), offsets[of] + np.minimum(q, docs[of, 2] - window) + 1
        open_ = _ranges_marked(total, low, high) & ~certain
        before = np.concatenate([[0], np.cumsum(open_)])
        asking = before[np.maximum(high, low)] > before[low]
        covered = _ranges_marked(total, begin, end)
        starts, words = np.flatnonzero(open_), np.flatnonzero(covered)
        out = []
        for d in np.unique(np.concatenate([doc_of(starts), doc_of(words)])):
            s, w = (x[np.searchsorted(x, offsets[d]) : np.searchsorted(x, offsets[d + 1])] - offsets[d] for x in (starts, words))
            edge = np.flatnonzero(np.diff(w, prepend=-2) != 1)
            spans = np.column_stack([w[edge], w[np.append(edge[1:], len(w)) - 1] + 1]) if len(w) else np.zeros((0, 2), np.int64)
            out.append({"id": int(docs[d, 0]), "t": int(docs[d, 1]), "spans": spans.astype("<i4").tobytes(), "starts": s.astype("<i4").tobytes()})
        asked = np.unique(hits[asking][["id", "t", "at"]])
        sources = pa.RecordBatch.from_arrays([pa.array(asked["id"]), pa.array(asked["t"]), pa.nulls(len(asked), pa.binary()), pa.nulls(len(asked), pa.binary()), pa.array(asked["at"])], schema=_NEEDS)
        return pa.Table.from_batches([pa.RecordBatch.from_pylist(out, schema=_NEEDS), sources])

    return judge


def _packed(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they go through two shuffles."""
    for frame in by_bytes(frames):
        data = [t.encode() for t in frame.column("text").to_pylist()]
        zipped = [pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in data]
        kept = [n for n in frame.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(frame.column(n) for n in kept), pa.array(zipped, pa.binary()), pa.array([len(x) for x in data], pa.int64())], names=[*kept, "zipped", "size"])


def _unpacked(zipped: bytes, size: int) -> bytes:
    return pa.decompress(zipped, size, codec="zstd", asbytes=True) if size else b""


def _joined(parts: list[bytes] | None, dtype: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), dtype)


def _hashed(window: int):
    """The windows of a document that are to be judged, and those around the blocks that others asked for."""
    block = (window + 1) // 2

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in by_bytes(frames, "zipped"):
            for doc, t, zipped, size, starts, ats in zip(*(frame.column(c).to_pylist() for c in ("id", "t", "zipped", "size", "starts", "ats")), strict=True):
                text = _unpacked(zipped, size)
                x, begin, end = words_of(text)
                n = len(end)
                want = [_joined(starts)]
                if ats:
                    every = np.arange(0, n - block + 1, block)
                    h = rolling()(x, begin[every], end[every + block - 1], 0)
                    around = every[np.isin(h, h[np.array(ats) // block])]
                    want.append((around[:, None] - np.arange(window - block + 1)).ravel())
                s = np.unique(np.concatenate(want))
                s = s[(s >= 0) & (s <= n - window)]
                if len(s):
                    h1, h2 = (rolling()(x, begin[s], end[s + window - 1], k).view(np.int64) for k in (0, 1))
                    k = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(k, doc)), pa.array(np.full(k, t)), pa.array(s, pa.int32())], schema=_WINDOWS)

    return run


def _kept(window: int):
    def rows(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for frame in by_bytes(frames, "zipped"):
            for doc, zipped, size, spans, starts in zip(*(frame.column(c).to_pylist() for c in ("doc_id", "zipped", "size", "spans", "starts")), strict=True):
                words = _unpacked(zipped, size).split()
                pairs = _joined(spans).reshape(-1, 2).tolist() + [(s, s + window) for s in starts or []]
                gone = _ranges_marked(len(words), *np.array(pairs, np.int64).T) if pairs else np.zeros(len(words), bool)
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                yield doc, len(words), b" ".join(compress(words, ~gone)), [{"start": int(a), "end": int(z)} for a, z in edge.reshape(-1, 2)]

    return lambda frames: row_batches(rows(frames), _KEPT)


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, kept_text, removed): every document without the words that lie in a window which also starts in a document of a smaller doc_id.

    Words are cut at blanks (space and \\x09 to \\x0D) and unchanged; kept ones are joined by one space, `removed` lists the word
    ranges that went. A null text is empty; texts under `window` words lose nothing. Long texts are read whole. Rows that share
    a doc_id lose nothing to each other and each has its row; a null doc_id comes after all others. A passage repeated within
    one document stays. doc_id must be a whole number. An empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # batches are numbered by task and place: a task that is run again must find the same rows in the same order
    texts = steady(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "texts").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t"), "text")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "range int, kind int, batch long, data binary, more binary"
    sent = texts.select("id", "t", "text").mapInArrow(_sent(window, ranges), shape).repartition("range").sortWithinPartitions("range", "kind")
    found = sent.mapInArrow(_hit, shape).groupBy("batch").applyInArrow(_judged(window), "id long, t long, spans binary, starts binary, at int")
    rows = written(found, "anchors")
    needs = written(rows.distinct().groupBy("id", "t").agg(F.collect_list("spans").alias("spans"), F.collect_list("starts").alias("starts"), F.collect_set("at").alias("ats")), "needs")
    packed = texts.mapInArrow(_packed, "doc_id long, id long, t long, zipped binary, size long")
    judged = packed.join(needs.where("size(starts) + size(ats) > 0").select("id", "t", "starts", "ats"), ["id", "t"])
    windows = written(judged.mapInArrow(_hashed(window), "h1 long, h2 long, id long, t long, s int"), "windows")
    owners = written(windows.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("other")).where("owner < other").select("h1", "h2", "owner"), "owners")
    lost = windows.join(owners, ["h1", "h2"]).where("id > owner").groupBy("id", "t").agg(F.collect_set("s").alias("starts"))
    cover = written(lost.join(needs.where("size(spans) > 0").select("id", "t", "spans"), ["id", "t"], "full"), "cover")
    return packed.join(cover, ["id", "t"], "left").mapInArrow(_kept(window), "doc_id long, n_words long, kept_text string, removed array<struct<start: long, end: long>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, unnest([array_to_string(w[i:i + 49], ' ') FOR i IN range(1, len(w) - 48)]) AS g FROM d),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN first USING (g) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
