"""Packing of whole documents into sequences by shortest-pack-first over the histogram of piece lengths.

1. Each document's ids are cut into pieces of `width` and a remainder; no id is lost. One Python pass, written once.
2. The histogram of lengths has at most `width` bins whatever the corpus; the driver places its bins longest first, each
   into the shortest packs (those with most room) that still hold it or, if none does, together into new ones, and counts
   packing patterns, not packs.
3. Every piece gets its rank among the pieces of its length from per-partition counts, and a placement is a range of ranks
   of one length, so pieces and patterns meet by an interval lookup in a small table: a length adds at most two patterns, a
   pattern has some sqrt(2 * width) different lengths at most, so its size is bounded whatever the corpus.

Nothing grows on the driver with the input but the counts in the histogram.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from itertools import chain, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import Memo, by_bytes, resident, shipped, small_batches, table, texts_of, written
from tapewright.llm.pieces import PieceCache, batched, kind_of

#: Texts that lower-casing and NFC leave as long as they are: printable ASCII, white space and composed Latin letters.
_LATIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-įĲ-ňŊ-ž]*")
#: pieces.WORD_PATTERN for such texts in lower case, its commonest branch first.
_LATIN_PARTS = re.compile(r"[a-zß-öø-ž]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ž0-9]+", re.ASCII)


def _byte_letters() -> list[str]:
    """A visible character for each byte, as byte-level vocabularies write them: printable ones as they are, others from 256 on."""
    out, n = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


def ids_encoder(data: bytes):
    """A function from texts to lists of parts, each part a list of byte strings of unsigned 32-bit ids."""
    from tokenizers import Tokenizer

    vocab, kind = Tokenizer.from_str(data.decode()), kind_of(data)
    whole = lambda texts: [np.array(x.ids, "<u4").tobytes() for x in vocab.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == "whole":
        return lambda texts: ([[x]] for x in whole(texts))
    if kind == "byte":
        return lambda texts, cache=PieceCache(whole, spaced=True): batched(cache.of, texts)
    letters, model, known, words = _byte_letters(), vocab.model, Memo(), PieceCache(whole, spaced=False)

    def part(p: str) -> bytes:
        ids = array("I", [x.id for x in model.tokenize(p if p.isascii() else "".join(map(letters.__getitem__, p.encode())))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def parts(texts: list[str]) -> list[list[bytes]]:
        """Latin texts are split by the vocabulary's own pattern and each distinct part goes through its BPE model once; words of others go through the whole tokenizer."""
        known.room()
        split = [_LATIN_PARTS.findall(t.lower()) if "<|" not in t and _LATIN.fullmatch(t) else None for t in texts]
        new = list(set(chain.from_iterable(x for x in split if x)).difference(known))
        known.fill(new, list(map(part, new)))
        rest = iter(words.of([t for t, x in zip(texts, split, strict=True) if x is None]))
        return [next(rest) if x is None else list(map(known.__getitem__, x)) for x in split]

    return lambda texts: batched(parts, texts)


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, end rank, first sequence, offset, each) that pack histogram[length] pieces of each length.

    A placement gives every sequence from the first on `each` pieces of the length, one after the other from the offset.

    Lengths are placed longest first into the shortest packs with room; of those left without one, as many as fit share a new
    pack. A pack pattern is a tuple of lengths with the number of packs that follow it; a step takes packs of one pattern and
    moves as many as needed to the pattern with one more length.
    """
    shortest: list[tuple[int, tuple[int, ...]]] = []  # heap of (used, pattern)
    packs: dict[tuple[int, ...], int] = {}
    full: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        used = sum(pattern)
        if used == width:
            full[pattern] = full.get(pattern, 0) + n
        elif pattern in packs:
            packs[pattern] += n
        else:
            packs[pattern] = n
            heapq.heappush(shortest, (used, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if shortest and shortest[0][0] + length <= width:
                pattern = shortest[0][1]
                n = min(left, packs[pattern])
                packs[pattern] -= n
                if not packs[pattern]:
                    del packs[pattern]
                    heapq.heappop(shortest)
            else:  # new packs, each with as many as fit, and one with the rest
                fit = width // length
                if left >= fit:
                    put((length,) * fit, left // fit)
                if left % fit:
                    put((length,) * (left % fit), 1)
                break
            left -= n
            put((*pattern, length), n)
    out, ranks, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, n in sorted([*full.items(), *packs.items()], key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for length, run in groupby(pattern):
            each = len(list(run))
            out.append((length, ranks[length], ranks[length] + each * n, first, offset, each))
            ranks[length] += each * n
            offset += each * length
        first += n
    return out


def pieces(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, part, nth): every document's ids in pieces; nth counts the pieces of one length in a partition. With keep_ids the ids too."""
    small_batches(docs.sparkSession)
    vocab = shipped(docs.sparkSession, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        data = vocab.value
        encode, part = resident(("ids", hash(data)), lambda: ids_encoder(data)), TaskContext.get().partitionId()
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        seen: dict[int, int] = {}
        for batch in by_bytes(batches, "text"):
            rows: list[list] = [[] for _ in range(8)]
            for nth, parts in enumerate(encode(texts_of(batch))):
                data = b"".join(chain.from_iterable(parts)) + tail
                total = len(data) // 4
                for start in range(0, total, width):
                    own = data[4 * start : 4 * (start + width)]
                    n = len(own) // 4
                    seen[n] = seen.get(n, -1) + 1
                    for column, x in zip(rows, (nth, start, n, zlib.crc32(own), total, part, seen[n], own), strict=True):
                        column.append(x)
            columns = [batch.column("id").take(pa.array(rows[0], pa.int64()))] + [pa.array(x, pa.int64()) for x in rows[1:7]]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in rows[7]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long" + ", ids array<int>" * keep_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document.

    Pieces of one sequence stand one after the other from offset 0 and hold `width` ids at most; a sequence is padded to
    `width` unless its ids are as many as a power of two. A null or empty text is just the end id; without an end id it has
    no piece. Long texts are tokenized whole and cut into whole sequences and a remainder. Repeated rows are packed as often as
    they occur. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, width, end_id, id_col, text_col, keep_ids), "pieces")
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `width` rows at most
    places = shortest_pack_first(histogram, width)
    by_length: dict[int, list] = {}
    for length, r0, _, *rest in places:
        by_length.setdefault(length, []).append((r0, *rest))
    rows = [(length, *map(list, zip(*v, strict=True))) for length, v in by_length.items()]
    patterns = spark.createDataFrame(rows, "length long, ranks array<long>, firsts array<long>, offsets array<long>, each array<long>")
    ranked = cut.join(before.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # a placement is the last one of its length that begins at or before the rank
    at = F.size(F.filter("ranks", lambda r: r <= F.col("rank"))) - 1
    placed = ranked.join(F.broadcast(patterns), "length").withColumn("at", at)
    nth, each = F.col("rank") - F.get("ranks", F.col("at")), F.get("each", F.col("at"))
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.get("firsts", F.col("at")) + F.floor(nth / each)).alias("sequence_id"),
        (F.get("offsets", F.col("at")) + nth % each * F.col("length")).alias("offset"), *(["ids"] if keep_ids else []),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
