"""Token ids as files: one array of ids per segment, documents found by Elias-Fano codes.

A segment is a run of documents in ascending id order.  Its ids stand one after the other; the
ends of its documents and their ids are Elias-Fano codes, so no table of 64-bit offsets is kept.
Segments are rows of a Parquet table: any store that Spark writes can hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from onsetlens.llm.common import (
    small_batches,
    BUCKETS_PER_PARTITION, order_bounds, order_places, partitions, ragged_take, segments, sums_between, texts_of, words_of,
)
from onsetlens.llm.elias_fano import EliasFano
from onsetlens.llm.word_ids import load_tokenizer, word_tokens
from onsetlens.session import scratch_path

ENCODE_TEXT = 8 << 20  # bytes of text encoded at once: a usual batch of texts whole, so that a word is looked up once
SEGMENT_TOKENS = 500_000  # ids of a segment, but for a longer single document
_SEGMENT = "bucket int, segment int, n_docs long, n_nulls long, n_tokens long, id_bytes int, doc_ids binary, ends binary, ids binary"


def _id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if load_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(doc_id, ids binary, bucket int): the ids of each whole text and ``end_id``, 16 bits each where they fit.

    The bucket by ``bounds`` (``order_bounds``) is found here: a UDF of its own would keep a second
    Python worker for each task, and every worker comes to hold the tokenizer and its words.
    """
    known = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(tokenizer)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            texts = texts_of(batch.column(1))
            last, held = -1, b""
            done: list[bytes] = []
            for rows, part in segments(texts, ENCODE_TEXT):
                offsets, codes, words = words_of(part)
                flat, starts, lengths = word_tokens(tokenizer, words, False)
                ends = np.concatenate([[0], np.cumsum(sums_between(lengths[codes], offsets))]) * kind.itemsize
                ids = ragged_take(flat, starts, lengths, codes).astype(kind).tobytes()
                for i, row in enumerate(rows.tolist()):
                    piece = ids[ends[i] : ends[i + 1]]
                    if row == last:
                        held += piece
                        continue
                    if last >= 0:
                        done.append(held + end)
                    last, held = row, piece
            if last >= 0:
                done.append(held + end)
            places = order_places(batch.column(0), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary()), places], ["doc_id", "ids", "bucket"])

    return documents.mapInArrow(encode, "doc_id long, ids binary, bucket int")


def write_token_file(
    documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Writes the ids of all documents to ``path`` in ascending document id order.

    A null text is an empty one (only ``end_id``); null ids come first; repeated ids keep one
    entry per row, in order of their ids' bytes.  An empty table writes no segment.  Other
    columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kept = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    count = partitions(spark)
    bounds = order_bounds(kept, "doc_id", BUCKETS_PER_PARTITION * count)
    dealt = (
        encode_documents(kept, tokenizer, end_id, bounds)
        .repartition(count, "bucket")
        .sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(tokenizer)
        bucket, number, size = None, 0, 0
        doc_ids: list[int | None] = []
        runs: list[bytes] = []

        def segment():
            known = [d for d in doc_ids if d is not None]
            ends = np.cumsum([len(r) // kind.itemsize for r in runs])
            values = [
                bucket, number, len(runs), len(runs) - len(known), int(ends[-1]), kind.itemsize,
                EliasFano.of(np.array(known, np.int64)).to_bytes(), EliasFano.of(ends).to_bytes(), b"".join(runs),
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            names = [part.split()[0] for part in _SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for doc_id, ids, at in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "ids", "bucket"))):
                if runs and (at != bucket or size + len(ids) > SEGMENT_TOKENS * kind.itemsize):
                    yield segment()
                    number = number + 1 if at == bucket else 0
                    doc_ids, runs, size = [], [], 0
                elif at != bucket:
                    number = 0
                bucket = at
                doc_ids.append(doc_id)
                runs.append(ids)
                size += len(ids)
        if runs:
            yield segment()

    packed = dealt.select("bucket", "doc_id", "ids").mapInArrow(pack, _SEGMENT)
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids_crc32 long) of every document, from the files.

    ``start`` counts the ids of all documents before.  Starts of segments come from one row per
    segment; a window runs over the segments of a bucket, and over one row per bucket.
    """
    stored = spark.read.schema(_SEGMENT).parquet(path)
    sizes = stored.select("bucket", "segment", "n_tokens")
    within = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("segment")) - F.col("n_tokens")
    buckets = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("all"))  # as many rows as order_bounds gives
    before = F.sum("all").over(Window.orderBy("bucket")) - F.col("all")
    firsts = sizes.withColumn("within", within).join(buckets.withColumn("before", before).drop("all"), "bucket")
    starts = firsts.select("bucket", "segment", (F.col("before") + F.col("within")).alias("first"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):  # one segment at a time
                row = batch.slice(place, 1).to_pylist()[0]
                ends = EliasFano.from_bytes(row["ends"]).values()
                known = EliasFano.from_bytes(row["doc_ids"]).values().tolist()
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), row["bucket"], np.int32)),
                        pa.array(np.full(len(ends), row["segment"], np.int32)),
                        pa.array([None] * row["n_nulls"] + known, pa.int64()),
                        pa.array(begins),
                        pa.array(ends - begins),
                        pa.array(sums, pa.int64()),
                    ],
                    ["bucket", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    blobs = stored.select("bucket", "segment", "n_nulls", "id_bytes", "doc_ids", "ends", "ids")
    found = blobs.mapInArrow(unpack, "bucket int, segment int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["bucket", "segment"]).select(
        "doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def document_ids(segment: dict, number: int) -> np.ndarray:
    """The ids of document ``number`` of a segment row, by two selects."""
    ends = EliasFano.from_bytes(segment["ends"])
    ids = np.frombuffer(segment["ids"], f"<u{segment['id_bytes']}")
    return ids[ends.select(number - 1) if number else 0 : ends.select(number)]


def token_file(documents: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the file (below the checkpoint folder unless ``path`` is given) and reads it back."""
    spark = documents.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_file(documents, path, tokenizer, end_id)
    return read_token_file(spark, path)
