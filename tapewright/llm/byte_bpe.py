"""Byte-level BPE encoding and decoding from merge ranks, by longest matches with backtracking.

The vocabulary's byte strings are read as Latin-1 text and put into an Aho-Corasick automaton. A piece is encoded from the
left by the longest token at each place; a token may follow another only if BPE would keep the two apart, which is decided
by undoing merges along the border and memoised. Where the longest token can't follow, the next shorter one is tried, and a
dead end takes back the last token. Each place is marked once when given up, so the work is linear in the piece and the
result is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapewright.llm.common import MEMO_MOST, Memo, by_bytes, resident, shipped, small_batches, table, texts_of
from tapewright.llm.pieces import PieceCache, batched


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.bytes_of = {i: t for t, i in ranks.items()}
        self.id_of = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.text_of = {i: t for t, i in self.id_of.items()}
        self.tokens = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.tokens.add_word(t, (i, len(t)))
        self.tokens.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts = self._parts()
        self.size_of = {i: len(t) for t, i in self.id_of.items()}
        self.shorter = {i: next((self.id_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.id_of), -1) for t, i in self.id_of.items()}

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens that each token is merged from; a single byte is merged from itself."""
        parts: dict[int, tuple[int, int]] = {}
        for i in sorted(self.text_of):
            word = list(self.text_of[i])
            while len(word) > 2:  # merge as BPE does, with the ranks below this token's own
                best, at = i, -1
                for k in range(len(word) - 1):
                    r = self.id_of.get(word[k] + word[k + 1], i)
                    if r < best:
                        best, at = r, k
                if at < 0:
                    break
                word[at : at + 2] = [word[at] + word[at + 1]]
            parts[i] = (self.id_of[word[0]], self.id_of[word[1]]) if len(word) == 2 else (i, i)
        return parts

    def fits(self, a: int, b: int) -> bool:
        """True if BPE, merging the two tokens' joint bytes, keeps the border between them."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        limit, text, parts, ids = float("inf"), self.text_of, self.parts, self.id_of
        while True:
            joint = ids.get(text[a] + text[b])
            if joint is not None and joint < limit:
                return False
            if a > b:  # undo the later merge first
                limit, right = a, parts[a][1]
                if right == a:
                    limit, left = b + 1, parts[b][0]
                    if left == b:
                        return True
                    b = left
                else:
                    a = right
            else:
                limit, left = b + 1, parts[b][0]
                if left == b:
                    limit, right = a, parts[a][1]
                    if right == a:
                        return True
                    a = right
                else:
                    b = left

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        text = piece.decode("latin-1")
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [0] * n  # token at each place; matches come by their ends, so the last one written is the longest
        for end, (i, size) in self.tokens.iter(text):
            longest[end + 1 - size] = i
        sizes, shorter, pairs = self.size_of, self.shorter, self.pairs
        dead: set[int] = set()  # places given up
        out: list[int] = []
        at, t, last = 0, longest[0], -1
        while True:
            while t >= 0:
                end = at + sizes[t]
                if end not in dead:
                    if last < 0:
                        break
                    ok = pairs.get((last, t))
                    if self.fits(last, t) if ok is None else ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                if end == n:
                    return out
                last, at, t = t, end, longest[end]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                t = out.pop()
                at -= sizes[t]
                last, t = out[-1] if out else -1, shorter[t]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def coder(data: bytes, pattern: str) -> tuple[ByteBPE, Callable[[list[str]], Iterable[list[list[bytes]]]]]:
    """The tables and a memo of pieces. Texts are cut at spaces only for the pattern that is known to let no match across."""
    import regex

    bpe, find = ByteBPE(read_ranks(data)), regex.compile(pattern).finditer
    known = Memo(2 * MEMO_MOST)  # ids as unsigned 32-bit numbers: small, and no work for the garbage collector

    def encode(pieces: list[str]) -> list[bytes]:
        known.room()
        out, new = [], {}
        for piece in pieces:
            ids = []
            for m in find(piece):
                m = m.group()
                if not m:
                    continue
                got = known.get(m)
                if got is None:
                    got = new.get(m)
                if got is None:
                    got = new[m] = array("I", bpe.encode(m.encode())).tobytes()
                ids.append(got)
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        known.fill(list(new), list(new.values()))
        return out

    if pattern == public_tokenizers.PATTERN:
        return bpe, lambda texts, cache=PieceCache(encode, spaced=True, most=2 * MEMO_MOST): batched(cache.of, texts)
    return bpe, lambda texts: ([[x]] for x in encode(texts))


def byte_bpe(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, and with ids=True the ids and the decoded text as well.

    ranks: path of a `.tiktoken` file; pattern: its split pattern, each match of which is encoded by itself. Null text
    counts as empty: no tokens. Long texts are encoded whole, in parts where the pattern has safe cuts. Repeated or null ids
    stay rows of their own; other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    vocab = shipped(docs.sparkSession, ranks)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        data = vocab.value
        bpe, encode = resident(("bpe", hash(data), pattern), lambda: coder(data, pattern))
        digits = {i: str(i) for i in bpe.bytes_of}
        for batch in by_bytes(batches, "text", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for parts in encode(texts_of(batch)):
                doc = np.frombuffer(b"".join(chain.from_iterable(parts)), np.uint32).tolist()
                decoded = b"".join(map(bpe.bytes_of.__getitem__, doc))
                out[0].append(len(doc))
                out[1].append(hashlib.sha256(" ".join(map(digits.__getitem__, doc)).encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    out[3].append(doc)
                    out[4].append(decoded.decode())
            columns = [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
