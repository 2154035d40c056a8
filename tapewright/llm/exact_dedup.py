"""Exact de-duplication by a tree merge of sorted digest runs.

Tasks sort the digests they read into runs of at most SEGMENT entries: of equal texts one entry stays, with the row that is
kept and a count. Runs then merge in binomial rounds. In each, `fan` runs exchange: each of the fan takes one part of the
digests' range from all of them, merges the sorted parts, and keeps of equal entries the smallest, so after the round there
are as many segments as before, each of a range narrower by fan and of runs wider by fan. After the last round a segment holds
all entries of its range. Segments travel packed, a row each, and stay about as long as a run in every round, whatever the
number of documents; a group of copies, however large, sends one entry a run to the first round and at most about fan to a
merge in any.

Equality is verified at every level by more than the digest: entries also carry a 64-bit hash by another function and the
text's length, and only entries that agree in all three merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import table, with_class, written

#: The characters that texts are compared without, \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
KEYS = ["digest", "check", "size"]
#: Entries of a run.
SEGMENT = 1 << 16


def leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document without its text: id, points, what tells its text from others, row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    bare = F.translate(text, BLANKS, "")
    return docs.select(docs[id_col].alias("id"), F.char_length(text).alias("points"), bare.alias("bare")).select(
        "id", "points", F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"), F.length("bare").alias("size"), F.monotonically_increasing_id().alias("row"),
    )


@dataclass
class Entries:
    """words: digest (four), check and size of each entry; nums: code points and place of the row that stays, and how many rows; ids: its id."""

    words: np.ndarray
    nums: np.ndarray
    ids: pa.Array

    def __len__(self) -> int:
        return len(self.words)

    @staticmethod
    def read(batch: pa.RecordBatch) -> Entries:
        digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
        check = batch.column("check").to_numpy().view(np.uint64)
        words = np.column_stack([digest.astype(np.uint64), check, batch.column("size").to_numpy().astype(np.uint64)])
        nums = np.column_stack([batch.column("points").to_numpy().astype(np.int64), batch.column("row").to_numpy(), np.ones(len(words), np.int64)])
        return Entries(words, nums, batch.column("id"))

    @staticmethod
    def unpack(pieces: pa.Table) -> Entries:
        words = np.frombuffer(b"".join(pieces.column("words").to_pylist()), np.uint64).reshape(-1, 6)
        nums = np.frombuffer(b"".join(pieces.column("nums").to_pylist()), np.int64).reshape(-1, 3)
        return Entries(words, nums, pa.concat_arrays([c.flatten() for c in pieces.column("ids").chunks]))

    def cut(self, level: int, bits: int) -> Iterator[tuple[int, Entries]]:
        """Sorted entries that share the digits before `level`, by their digit there."""
        digit = (self.words[:, 0] >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
        edges = np.searchsorted(digit, np.arange((1 << bits) + 1, dtype=np.uint64))
        for d in np.flatnonzero(np.diff(edges)):
            at = slice(edges[d], edges[d + 1])
            yield int(d), Entries(self.words[at], self.nums[at], self.ids[at])


def _order(words: np.ndarray) -> np.ndarray:
    """The order of the entries by their words. NumPy's stable sort takes ascending stretches as they are and merges them, which is what runs laid end to end ask for."""
    order = np.argsort(words[:, 0], kind="stable")
    by_first = words[order]
    if ((by_first[1:, 0] == by_first[:-1, 0]) & (by_first[1:] != by_first[:-1]).any(axis=1)).any():  # other texts with the same first word
        order = np.lexsort(words.T[::-1])
    return order


def _sort_keys(ids: pa.Array, nulls_last: bool) -> Iterator[pa.Array]:
    """What to sort by, one after another, for Spark's order of the ids: fields of structs in turn, missing ones first inside them."""
    yield pc.cast(pc.is_null(ids) if nulls_last else pc.is_valid(ids), pa.int8())
    if pa.types.is_struct(ids.type):
        for child in ids.flatten():
            yield from _sort_keys(child, False)
    elif not pa.types.is_null(ids.type):
        yield ids


def merge(entries: Entries) -> Entries:
    """One entry for each text, in order: that of the row with the most code points, then the smallest id (null last), then the first."""
    order = _order(entries.words)
    words, nums = entries.words[order], entries.nums[order]
    first = np.ones(len(order), bool)
    first[1:] = (words[1:] != words[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    kept = starts.copy()
    several = np.flatnonzero(np.bincount(group, minlength=len(starts))[group] > 1)
    if len(several):
        columns = [pa.array(group[several]), pa.array(-nums[several, 0]), *_sort_keys(entries.ids.take(pa.array(order[several])), True), pa.array(nums[several, 1])]
        names = [f"k{i}" for i in range(len(columns))]
        best = several[pc.sort_indices(pa.table(columns, names), [(c, "ascending") for c in names]).to_numpy()]
        of = group[best]
        head = np.ones(len(best), bool)
        head[1:] = of[1:] != of[:-1]
        kept[of[head]] = best[head]
    out = nums[kept]
    out[:, 2] = np.add.reduceat(nums[:, 2], starts) if len(starts) else 0
    return Entries(words[kept], out, entries.ids.take(pa.array(order[kept])))


def _pieces(parts: Iterable[tuple[int, int, Entries]], id_type: pa.DataType) -> pa.Table:
    rows = list(parts)
    ids = pa.concat_arrays([e.ids for _, _, e in rows]) if rows else pa.array([], id_type)
    offsets = np.cumsum([0, *(len(e) for _, _, e in rows)], dtype=np.int32)
    columns = [
        pa.array([run for run, _, _ in rows], pa.int64()), pa.array([span for _, span, _ in rows], pa.int64()),
        pa.array([e.words.tobytes() for _, _, e in rows], pa.binary()), pa.array([e.nums.tobytes() for _, _, e in rows], pa.binary()),
        pa.ListArray.from_arrays(pa.array(offsets), ids),
    ]
    return pa.table(columns, ["run", "span", "words", "nums", "ids"])


def _runs(rounds: int, bits: int, segment: int):
    """Sorted runs of a task's rows, cut for the first exchange. A run's number says whom it meets: it is drawn from the task's and its own place, so that numbers are dealt evenly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        held: list[Entries] = []

        def sealed() -> Iterator[pa.RecordBatch]:
            number = (task + place * 40503) % (1 << (bits * rounds))
            whole = merge(Entries(np.concatenate([e.words for e in held]), np.concatenate([e.nums for e in held]), pa.concat_arrays([e.ids for e in held])))
            yield from _pieces(((number >> bits, d, e) for d, e in whole.cut(0, bits)), whole.ids.type).to_batches()

        for batch in batches:
            for start in range(0, batch.num_rows, segment):
                part = batch.slice(start, segment)
                if held and sum(map(len, held)) + part.num_rows > segment:
                    yield from sealed()
                    held, place = [], place + 1
                held.append(Entries.read(part))
        if held:
            yield from sealed()

    return run


def _exchanged(level: int, bits: int):
    """The pieces of fan runs in one range, merged, and cut for the next exchange."""

    def merge_pieces(pieces: pa.Table) -> pa.Table:
        run, span = pieces.column("run")[0].as_py(), pieces.column("span")[0].as_py()
        whole = merge(Entries.unpack(pieces))
        return _pieces(((run >> bits, (span << bits) + d, e) for d, e in whole.cut(level, bits)), whole.ids.type)

    return merge_pieces


def _last(pieces: pa.Table) -> pa.Table:
    """The pieces of all runs in one range, merged: a row for each text."""
    e = merge(Entries.unpack(pieces))
    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(e.words[:, :4].astype(">u8").tobytes())])
    columns = [digest.cast(pa.binary()), pa.array(e.words[:, 4].view(np.int64)), pa.array(e.words[:, 5].astype(np.int32)), e.ids, pa.array(e.nums[:, 1]), pa.array(e.nums[:, 2])]
    return pa.table(columns, [*KEYS, "keep_id", "keep_row", "n"])


def tree_merged(rows: DataFrame, total: int, fan: int, segment: int) -> DataFrame:
    """(digest, check, size, keep_id, keep_row, n), one row for each text of the leaves. fan is a power of two."""
    if fan < 2 or fan & (fan - 1):
        raise ValueError("fan must be a power of two")
    bits, rounds = fan.bit_length() - 1, 1
    while fan**rounds * segment < total:
        rounds += 1
    id_type = rows.schema["id"].dataType.simpleString()
    packed = f"run long, span long, words binary, nums binary, ids array<{id_type}>"
    pieces = rows.mapInArrow(_runs(rounds, bits, segment), packed)
    for level in range(1, rounds):
        pieces = pieces.groupBy("run", "span").applyInArrow(_exchanged(level, bits), packed)
    return pieces.groupBy("run", "span").applyInArrow(_last, f"digest binary, check long, size int, keep_id {id_type}, keep_row long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 16, segment: int = SEGMENT) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Texts are equal when they are so without BLANKS; a null text counts as empty, so null, empty and blank texts are one
    group. Of a group stays the row with the most code points, then the smallest id (null ids last), then the first row:
    repeated rows have one that is kept. Long texts are read whole. An empty table gives an empty result. Other columns are
    not read. Runs have `segment` entries at most, and `fan` of them (a power of two) meet in a round.
    """
    all_rows = written(leaves(docs, id_col, text_col), "digests")
    total = all_rows.count()
    groups = written(tree_merged(all_rows, total, fan, segment), "groups")
    both = with_class(all_rows, groups, KEYS, total)
    return both.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept, text_sha256
FROM t
"""
