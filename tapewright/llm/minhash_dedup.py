"""Near-duplicate texts by MinHash signatures and a multi-index Hamming join.

A text's set of word shingles gets HASHES minima, of each of which `BITS` bits are kept: the signature, whose Hamming
distance counts the positions that differ. Signatures are cut into chunks of WIDTH positions. By the pigeonhole principle,
if the chunks' allowed errors plus one add up to `apart` + 1, two signatures at most `apart` apart agree in some chunk
but for its allowed errors. Chunks allow none, or one error; that one is enumerated by its place: a key leaves one position
out. So every pair within `apart` shares a key, and keys are compared by an equi-join.

`apart` lies 3.7 standard deviations above the distance expected at the least similarity asked for.

Which links are looked at: equal sets (by a 128-bit hash) are one node from the start. In a first round each node is compared with the pivot
(smallest node) that it shares most keys with. After that only pairs of different components need a look. Pairs of different
components that share a key and lie at most `apart` apart connect nodes to groups, and in a group nodes of different components
meet with their full sets. Tasks hand on what pairs connect, an edge a node at most, and never the pairs; none is skipped but
those whose ends are connected already, so components come out whole. Large keys and groups are compared block by block.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import Memo, by_bytes, resident, small_batches, table, with_class, written
from tapewright.llm.components import components, spanning

WORDS = 5
HASHES, BITS, WIDTH, DEVIATIONS = 128, 16, 4, 3.7
CHUNKS = HASHES // WIDTH
BLOCK, SETS_BLOCK = 1024, 256
#: Up to so many nodes to look at, their ids are broadcast to the second reading of the texts; beyond, ids and texts meet in a shuffle.
BROADCAST_IDS = 2_000_000
_MULTIPLY = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(HASHES + WORDS + 2)], np.uint64)
_ODD = (_MULTIPLY[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def most_apart(least: int) -> int:
    """The signature distance within which all pairs are found, for a least similarity in hundredths."""
    differ = (1 - least / 100) * (1 - 0.5**BITS)
    return int(HASHES * differ + DEVIATIONS * (HASHES * differ * (1 - differ)) ** 0.5)


def with_error(apart: int) -> int:
    """How many chunks allow one error: (CHUNKS - n) * 1 + n * 2 = apart + 1."""
    n = apart + 1 - CHUNKS
    if n > CHUNKS:
        raise ValueError("chunks with one error don't reach so far")
    return max(n, 0)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of WORDS words; of a shorter text, its whole sequence as one.

    Words are what white space (space, \\t to \\r) leaves, A-Z in lower case. No words: an empty set.
    """
    import xxhash

    memo = resident(("shingles",), Memo)
    memo.room()
    split = [t.encode().lower().split() for t in texts]  # of bytes: both touch ASCII only
    new = list(set(chain.from_iterable(split)).difference(memo))
    memo.fill(new, list(map(xxhash.xxh3_64_intdigest, new)))
    out = []
    for words in split:
        n = len(words)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            if n >= WORDS:
                s = h[: n - WORDS + 1] * _MULTIPLY[0]
                for k in range(1, WORDS):
                    s += h[k : n - WORDS + 1 + k] * _MULTIPLY[k]
                s = np.unique(_mixed(s))
            elif n:
                s = _mixed((h * _MULTIPLY[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                s = h
        out.append(s)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BITS bits of HASHES minima for each set that isn't empty. A shingle's k-th hash is (its low half * an odd number) xor its high half."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    h = np.empty((256, HASHES), np.uint32)  # small enough for the cache
    for row, s in enumerate(sets):
        low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
        best = None
        for a in range(0, len(s), 256):
            own = h[: min(256, len(s) - a)]
            np.multiply(low[a : a + 256, None], _ODD, out=own)
            np.bitwise_xor(own, high[a : a + 256, None], out=own)
            least = own.min(axis=0)
            best = least if best is None else np.minimum(best, least)
        out[row] = best.astype(np.uint16)
    return out


def keys_of(sig: np.ndarray, errors: int) -> np.ndarray:
    """A column of 64-bit keys for each chunk, and for the first `errors` chunks, which allow one, a column for each position left out. The low byte is the column's number."""
    s = sig.astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            chunk = s[:, c * WIDTH : (c + 1) * WIDTH]
            left_out = range(WIDTH) if c < errors else (-1,)
            for gap in left_out:
                h = np.full(len(s), (c + 1) * 8 + gap + 1, np.uint64) * _MULTIPLY[WIDTH + 1]
                for k in range(WIDTH):
                    if k != gap:
                        h = _mixed(h + (chunk[:, k] + np.uint64(1)) * _MULTIPLY[k])
                out.append((h & ~np.uint64(255)) | np.uint64(len(out)))
    return np.column_stack(out).view(np.int64)


def first_shared_slot(x: np.ndarray, y: np.ndarray, errors: int) -> np.ndarray:
    """For rows of signatures that share a key, the number of the first key they share: each pair is looked at there alone."""
    same = (x == y).reshape(len(x), CHUNKS, WIDTH)
    n = same.sum(axis=2)
    chunk = ((n == WIDTH) | ((np.arange(CHUNKS) < errors) & (n == WIDTH - 1))).argmax(axis=1)
    rows = np.arange(len(x))
    gap = np.where(n[rows, chunk] == WIDTH, 0, same[rows, chunk].argmin(axis=1))
    return np.where(chunk < errors, chunk * WIDTH + gap, errors * WIDTH + chunk - errors)


def _set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """Both halves of a 128-bit hash of each set, null for an empty one."""
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
    empty = np.fromiter((not len(s) for s in sets), bool, len(sets))
    return [pa.array(both[:, k], pa.int64(), mask=empty) for k in (0, 1)]


def _signed(batches):
    for batch in by_bytes(batches, "text", 1 << 20):
        sets = shingle_sets(pc.fill_null(batch.column("text"), "").to_pylist())
        full = [s for s in sets if len(s)]
        sig = iter(signatures(full))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), *_set_hashes(sets), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
            ["id", "n_shingles", "h1", "h2", "sig"],
        )


def _keyed(errors: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keys = keys_of(np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES), errors)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))], ["key", "node"])

    return run


def _with_sets(batches):
    for batch in by_bytes(batches, "text", 1 << 20):
        sets = shingle_sets(pc.fill_null(batch.column("text"), "").to_pylist())
        yield pa.RecordBatch.from_arrays([*_set_hashes(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["h1", "h2", "shingles"])


def _blocks(keys: list[str], work):
    """Calls work(table, starts of its blocks) on whole blocks, rows of equal `keys`, of sorted batches."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            begins = _begins(t, keys)
            cut = int(np.flatnonzero(begins)[-1]) if t.num_rows else 0  # the last block may go on in the next batch
            if cut:
                yield work(t.slice(0, cut).combine_chunks(), np.flatnonzero(begins[:cut]))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield work(held.combine_chunks(), np.flatnonzero(_begins(held, keys)))

    return run


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + [f[c] for f in found])) for c in (0, 1)], ["a", "b"])


def _near_edges(least: int, most: int):
    """From blocks of a shared key, left rows first: what pairs of a left and a right row connect that are of different components, at most `most` apart, and whose sizes allow a link. At most an edge a row."""
    errors = with_error(most)

    def work(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, comp, size, key = (t.column(c).to_numpy() for c in ("node", "component", "n_shingles", "key"))
        minor, right = t.column("minor").to_numpy(), t.column("right").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        found, held_left, held_right, held = [], [], [], 0

        def measure() -> None:
            if not held_left:
                return
            x, y = np.concatenate(held_left), np.concatenate(held_right)
            near = [(x[:0], y[:0])]
            for i in range(0, len(x), 8192):
                p, q = x[i : i + 8192], y[i : i + 8192]
                ok = (sig[p] != sig[q]).sum(axis=1) <= most
                p, q = p[ok], q[ok]
                own = first_shared_slot(sig[p], sig[q], errors) == (key[p] & 255)
                near.append((p[own], q[own]))
            found.append(spanning(node[np.concatenate([n[0] for n in near])], node[np.concatenate([n[1] for n in near])]))
            held_left.clear(), held_right.clear()

        for start, end in zip(starts, [*starts[1:], len(node)], strict=True):
            cut = start + int(np.searchsorted(right[start:end], True))
            if start == cut or cut == end:
                continue
            left, other = slice(start, cut), slice(cut, end)
            ok = comp[left, None] != comp[None, other]
            ok &= 100 * np.minimum(size[left, None], size[None, other]) >= least * np.maximum(size[left, None], size[None, other])
            ok &= ~minor[left, None] | (node[left, None] < node[None, other])  # two minor rows meet both ways
            x, y = np.nonzero(ok)
            held_left.append(x + start), held_right.append(y + cut)
            held += len(x)
            if held > 1 << 20:
                measure()
                held = 0
        measure()
        return _edges(found)

    return _blocks(["key", "lb", "rb"], work)


def _links(least: int):
    """From blocks of a near group, left rows first: what links between a left and a right row of different components connect, on the full sets."""

    def work(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, comp, right = (t.column(c).to_numpy() for c in ("node", "component", "right"))
        sets = t.column("shingles").combine_chunks()
        values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
        found = []
        for start, end in zip(starts, [*starts[1:], len(node)], strict=True):
            cut = start + int(np.searchsorted(right[start:end], True))
            if start == cut or cut == end:
                continue
            _, word = np.unique(values[ends[start] : ends[end]], return_inverse=True)
            sizes = np.diff(ends[start : end + 1])
            row = np.repeat(np.arange(end - start), sizes)
            width, n_left = int(word.max()) + 1, cut - start
            step = max(1, (4 << 20) // width)  # rows of a dense part, 16 MB
            p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a in range(0, n_left, step):
                x = _dense(row, word, a, min(n_left, a + step), width)
                for b in range(n_left, end - start, step):
                    y = _dense(row, word, b, min(end - start, b + step), width)
                    shared = x @ y.T  # counts below 2^24 are exact
                    i, j = np.nonzero(100 * shared >= least * (sizes[a : a + len(x), None] + sizes[None, b : b + len(y)] - shared))
                    i, j = i + start + a, j + start + b
                    ok = comp[i] != comp[j]
                    p.append(i[ok]), q.append(j[ok])
            found.append(spanning(node[np.concatenate(p)], node[np.concatenate(q)]))
        return _edges(found)

    return _blocks(["group", "lb", "rb"], work)


def _dense(row: np.ndarray, word: np.ndarray, first: int, end: int, width: int) -> np.ndarray:
    out = np.zeros((end - first, width), np.float32)
    a, b = np.searchsorted(row, [first, end])
    out[row[a:b] - first, word[a:b]] = 1
    return out


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a block begins."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in keys:
        v = t.column(c).to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def _dealt(rows: DataFrame, on_left: Column, on_right: Column) -> DataFrame:
    """Rows dealt to `lefts` x `rights` blocks (lb, rb): those on the left to one lb and all rb, those on the right to one rb and all lb."""
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(on_left).withColumn("lb", own("lefts")).withColumn("rb", steps("rights")).withColumn("right", F.lit(False))
    right = rows.where(on_right).withColumn("rb", own("rights")).withColumn("lb", steps("lefts")).withColumn("right", F.lit(True))
    return left.unionByName(right)


def linked(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * shared shingles >= least * all shingles, on the full sets."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), shared.alias("shared")).where(100 * F.col("shared") >= least * (F.col("sum") - F.col("shared"))).select("a", "b")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each input row.

    least: the least similarity in hundredths, 72 or more. A text without words (null, empty, blank)
    is linked with nothing and is its own component. A row with a null id is linked with nothing either, has no component and
    is kept. Rows that repeat an id are judged by their own texts; rows equal in id and text are one component and, with the
    smallest id in it, all kept. Long texts are read whole, in batches of bounded bytes. An empty table gives an empty result.
    Other columns are not read.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = written(texts.mapInArrow(_signed, f"id {id_type}, n_shingles long, h1 long, h2 long, sig binary"), "signatures")
    equal = rows.where("h1 IS NOT NULL AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = written(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keys = nodes.select("node", "sig").mapInArrow(_keyed(with_error(most_apart(least))), "key long, node long")
    pivots = written(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "pivots")
    shared = written(keys.join(pivots, "key"), "shared-keys")
    active = written(shared.select("node").distinct().join(nodes.select("node", "h1", "h2", "id"), "node"), "active")
    wanted = active.select("id").distinct()
    wanted = F.broadcast(wanted) if active.count() <= BROADCAST_IDS else wanted
    found = texts.join(wanted, "id", "left_semi").select("text").mapInArrow(_with_sets, "h1 long, h2 long, shingles array<long>").dropDuplicates(["h1", "h2"])
    sets = written(found.join(active.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "shingles"), "sets")

    first = shared.where("node != pivot").groupBy("node", "pivot").count().groupBy("node").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    links = linked(first.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets, least)
    known = components(links)

    labelled = shared.select("key", "node").join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"))
    sizes = written(sizes.where(F.col("all") > F.col("most")), "mixed-sizes")  # keys of several components
    # every row stands on the left in one block; those outside the key's largest component also stand on the right
    rows_of = written(labelled.join(sizes, "key").join(nodes.select("node", "n_shingles", "sig"), "node").select(
        "key", "node", "component", "n_shingles", "sig", (F.col("component") != F.col("major")).alias("minor"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("lefts"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rights"),
    ), "mixed-keys")
    blocks = _dealt(rows_of, F.lit(True), F.col("minor")).select("key", "lb", "rb", "right", "node", "component", "n_shingles", "minor", "sig")
    near = blocks.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "right").mapInArrow(_near_edges(least, most_apart(least)), "a long, b long")
    # all that near pairs connect is a group; in it nodes of different components meet with their sets, in blocks
    groups = components(near).withColumnRenamed("component", "group")
    asked = written(groups.join(known, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component")), "near-nodes")
    counts = asked.groupBy("group", "component").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"))
    counts = counts.where(F.col("all") > F.col("most")).select("group", "major", F.ceil(F.col("all") / SETS_BLOCK).cast("int").alias("lefts"), F.ceil((F.col("all") - F.col("most")) / SETS_BLOCK).cast("int").alias("rights"))
    counts = written(counts, "group-sizes")
    dealt = _dealt(asked.join(counts, "group"), F.lit(True), F.col("component") != F.col("major")).select("group", "lb", "rb", "right", "node", "component")
    found = dealt.join(sets, "node").repartition("group", "lb", "rb").sortWithinPartitions("group", "lb", "rb", "right").mapInArrow(_links(least), "a long, b long")
    known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    named = nodes.select("node", "h1", "h2", "id").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = written(named.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    slim = rows.drop("sig")
    counted = slim.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    classes = written(named.join(smallest, "component").select("h1", "h2", "component_id").join(counted, ["h1", "h2"]), "classes")
    both = with_class(slim, classes, ["h1", "h2"], slim.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return both.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS node, s FROM d),
items AS (SELECT node, n, unnest(s) AS x FROM e WHERE doc_id = node AND n > 0),
links AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(node, coalesce(b, node)) AS component_id, doc_id = least(node, coalesce(b, node)) AS kept FROM e LEFT JOIN low ON low.a = node
"""
