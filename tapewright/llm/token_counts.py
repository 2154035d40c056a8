"""Token counts of whole texts: encoded in batches inside Arrow functions, only lengths come back.

Batches are balanced by bytes and long texts are cut at boundaries that no token crosses (see pieces.py), so a task holds
a few MB at a time whatever the texts' lengths. No shuffle: one pass over two columns.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tapewright.llm.common import MEMO_MOST, by_bytes, resident, shipped, small_batches, table, texts_of
from tapewright.llm.pieces import PieceCache, batched, kind_of

def _counter(name: str, data: bytes):
    """A function from texts to their token counts."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(data.decode())
    lengths = lambda texts: [len(x) for x in vocab.encode_batch_fast(texts, add_special_tokens=False)]
    kind = kind_of(data)
    if kind == "whole":
        return lengths
    cache = PieceCache(lengths, spaced=kind == "byte", most=2 * MEMO_MOST)
    return lambda texts: [sum(map(sum, parts)) for parts in batched(cache.of, texts)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", over: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    tokenizer: path of a `.json` (tokenizers) or `.model` (sentencepiece) file. A null text counts as empty: 0 bytes, 0
    tokens. Special strings inside texts are handled as the library does by default. Null and repeated ids are kept as
    rows of their own; other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    vocab, name = shipped(spark, tokenizer), tokenizer.rsplit("/", 1)[-1]
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        data = vocab.value
        counter = resident(("counts", name, hash(data)), lambda: _counter(name, data))
        for batch in by_bytes(batches, "text"):
            n = counter(texts_of(batch))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
