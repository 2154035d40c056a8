"""Token counts, byte-level BPE and packing against the libraries themselves."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from fixtures import EDGES, edge_docs
from tapewright.llm.byte_bpe import byte_bpe, coder, read_ranks
from tapewright.llm.packing import ids_encoder, pack, pieces, shortest_pack_first
from tapewright.llm.pieces import chunks, kind_of
from tapewright.llm.token_counts import token_counts

TEXTS = [t or "" for _, t in EDGES]


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    got = token_counts(edge_docs(spark), public_tokenizers.path(name)).collect()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        want = [len(x) for x in model.encode(TEXTS, num_threads=1)]
    else:
        want = [len(x.ids) for x in tokenizer(name).encode_batch(TEXTS, add_special_tokens=False)]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((i, len(t.encode()), n, n > 512) for (i, _), t, n in zip(EDGES, TEXTS, want, strict=True))


def test_empty_tables(spark):
    none = edge_docs(spark).limit(0)
    assert token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert byte_bpe(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_kinds():
    read = lambda n: open(public_tokenizers.path(n), "rb").read()
    assert kind_of(read("byte_bpe_50k.json")) == "byte" and kind_of(read("word_bpe_49k.json")) == "word"
    assert kind_of(b'{"normalizer": {"type": "NFC"}, "model": {}}') == "whole"


def test_chunks_join_to_the_text():
    text = TEXTS[4]
    parts = list(chunks(text, 1000))
    assert "".join(parts) == text and len(parts) > 100 and all(p.startswith(" ") for p in parts[1:])


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_tiktoken(spark, name):
    import tiktoken

    path = public_tokenizers.path(name)
    ranks = read_ranks(open(path, "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe(edge_docs(spark), path, public_tokenizers.PATTERN, ids=True).collect()
    want = Counter()
    for (i, _), t in zip(EDGES, TEXTS, strict=True):
        ids = own.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert Counter(r["decoded"] for r in got) == Counter(TEXTS)


def test_bpe_on_random_bytes_of_the_alphabet():
    import random

    import tiktoken

    data = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    bpe, _ = coder(data, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(data), special_tokens={})
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice("aetoin shrdlu.éß日") for _ in range(r.randrange(1, 60)))
        assert bpe.encode(text.encode()) == own.encode_ordinary(text)


def test_packing_is_whole_and_gapless(spark):
    width = 64
    got = pack(edge_docs(spark), public_tokenizers.path("word_bpe_49k.json"), width).collect()
    want = defaultdict(list)
    for (i, _), t, x in zip(EDGES, TEXTS, tokenizer("word_bpe_49k.json").encode_batch(TEXTS, add_special_tokens=False), strict=True):
        ids = [*x.ids, 1]
        for a in range(0, len(ids), width):
            own = ids[a : a + width]
            want[i].append((a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids)))
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= total / width * 1.02 + 2


def test_histogram_placements():
    h = {10: 3, 7: 5, 3: 4, 1: 2}
    placed = shortest_pack_first(h, 10)
    count, room = Counter(), Counter()
    for length, r0, r1, first, offset, each in placed:
        count[length] += r1 - r0
        for k in range(r1 - r0):
            room[first + k // each] = max(room[first + k // each], offset + (k % each + 1) * length)
    assert count == Counter(h) and max(room.values()) <= 10 and len(room) == 8
    assert shortest_pack_first({}, 10) == []


def test_pieces_keep_ids(spark):
    row = pieces(edge_docs(spark).where("doc_id = 8"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=True).first()
    assert row["ids"] == [*tokenizer("word_bpe_49k.json").encode(TEXTS[8], add_special_tokens=False).ids, 1]


def test_encoder_of_latin_words_equals_the_library():
    data = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    texts = ["Éa Ñandú ''s 'LL ÀÉ İx ſ Ω½ ²3 ǅ", "éa ŉx Ĳ ß ẞ", "ÿŸ Žž ÷ × µ ª º 10² don't CAN'T 'S", "éa Å", "a,b...c;;d--e", "MiXeD123abc4"]
    want = [x.ids for x in tokenizer("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b"".join(b for part in x for b in part), "<u4").tolist() for x in ids_encoder(data)(texts)] == want


@pytest.mark.parametrize(("length", "n"), [(600, 10_000), (300, 9_999), (1, 5_000), (1024, 7), (1025, 7)])
def test_pieces_of_one_length_share_sequences(length, n):
    """A hot length alone needs no more sequences than hold it; with others it leaves little padding."""
    room = Counter()
    for _, r0, r1, first, offset, each in shortest_pack_first({length: n}, 2048):
        for k in range(r1 - r0):
            room[first + k // each] += length
            assert offset % length == 0
    assert len(room) == -(-n // (2048 // length)) and sum(room.values()) == n * length and max(room.values()) <= 2048
    r = np.random.default_rng(length)
    histogram = Counter(np.minimum(2048, np.maximum(1, r.lognormal(5.5, 1, 20_000))).astype(int).tolist()) + Counter({min(length, 700): 10_000})
    placed = shortest_pack_first(histogram, 2048)
    used = max(first + (r1 - r0) // each for _, r0, r1, first, _, each in placed)
    assert used <= 1.1 * sum(k * v for k, v in histogram.items()) / 2048 and len(placed) < 20_000


def test_placements_are_bounded_by_the_width():
    r = np.random.default_rng(3)
    for width in (16, 64, 257):
        for _ in range(20):
            histogram = {k: int(n) for k, n in enumerate(r.geometric(10.0 ** -r.integers(1, 6), width), 1) if r.random() < 0.7}
            placed = shortest_pack_first(histogram, width)
            assert len(placed) <= 2 * width * (int((2 * width) ** 0.5) + 1)
            ranks = Counter()
            for length, r0, r1, *_ in placed:
                ranks[length] += r1 - r0
            assert ranks == Counter(histogram)
