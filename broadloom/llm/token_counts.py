"""Token counts by rank-synchronous merging of byte-level BPE.

Row-local: one Arrow pass over the texts without any shuffle. See ``byte_bpe`` for the method.

Defined results: a null or empty text has no bytes and no tokens. Special strings inside a text
count as one token each, as the tokenizers library does by default. Very long texts are counted
whole. Other columns of the input are ignored; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from broadloom.llm.byte_bpe import encoder
from broadloom.llm.rows import prepare

LIMIT = 1024


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than ``limit`` tokens.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can open.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            tokens = encoder(tokenizer).count(text)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(tokens), pa.array(np.greater(tokens, limit))],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
