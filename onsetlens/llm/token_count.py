"""Token counts: the library's batch encoding inside Arrow functions, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onsetlens.llm.common import byte_offsets, segments, sums_between, texts_of, words_of
from onsetlens.llm.word_ids import word_tokens

LIMIT = 2048


def token_counts(
    documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) of every whole text.

    ``tokenizer`` is the path of a tokenizers file, without begin, end or added special tokens,
    whose tokens do not span white space.  Texts are dealt into batches of equal bytes; a text
    longer than a batch is cut before white space, where its tokens may be counted apart.
    Only lengths leave the library.  A null text counts as empty: 0 bytes, 0 tokens.  Every row
    gives one row, repeated ids too; an empty table gives none; other columns are not read.
    """
    id_type = documents.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            n_tokens = np.zeros(len(texts), np.int64)
            for rows, part in segments(texts):
                offsets, codes, words = words_of(part)
                np.add.at(n_tokens, rows, sums_between(word_tokens(tokenizer, words, True)[codes], offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(byte_offsets(texts))), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kept = documents.select(documents[id_column].alias("id"), documents[text_column].cast("string").alias("text"))
    counted = kept.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)
