"""What several operators share: Arrow batches cut by bytes, words, state of a worker, order buckets."""

from __future__ import annotations

import posixpath
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_BYTES = 4 << 20  # text that a step holds at once, but for a single longer text
BUCKETS_PER_PARTITION = 2


ARROW_ROWS = 2000  # rows that Spark hands to Python at once; whole texts are a few KB on average


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand over whole texts in batches of at most ARROW_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote; what was read from them must be written already."""
    for table in tables:
        jvm = table.sparkSession._jvm
        conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {posixpath.dirname(f) for f in table.inputFiles()}:
            if "/onsetlens/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that tasks of one worker share caches."""
    home = sys.modules.setdefault("_onsetlens_worker", types.ModuleType("_onsetlens_worker")).__dict__
    return home.setdefault(name, {})


def texts_of(column: pa.Array) -> pa.Array:
    """A string column without nulls, with offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def byte_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)
    return raw.astype(np.int64)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes together; a longer text stands alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = np.nan_to_num(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(sizes)
    first, done = 0, 0
    while first < len(sizes):
        last = max(int(np.searchsorted(ends, done + limit, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first, done = last, int(ends[last - 1])


def segments(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row numbers, texts): batches of at most ``limit`` bytes, longer texts cut before white space.

    A cut lies before an ASCII white-space character, at which no word ends or begins twice.
    A run without white space that is longer than ``limit`` stays whole.
    """
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for row, text in enumerate(texts.cast(pa.binary())):
        text = text.as_py() or b""
        at = 0
        while True:
            end = len(text)
            if end - at > limit:
                spots = [p for p in (text.rfind(c, at + 1, at + limit) for c in (b" ", b"\n", b"\t")) if p > 0]
                end = max(spots) if spots else min([p for p in (text.find(c, at + 1) for c in (b" ", b"\n", b"\t")) if p > 0], default=end)
            if held and size + end - at > limit:
                yield np.array(rows), pa.array(held, pa.binary()).cast(pa.string())
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(text[at:end])
            size += end - at
            at = end
            if at >= len(text):
                break
    if held:
        yield np.array(rows), pa.array(held, pa.binary()).cast(pa.string())


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, words): the words of text i are words[c] for c in codes[offsets[i]:offsets[i + 1]].

    Words stand between ASCII white space; the word "" may occur and is to be passed over.
    """
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs flat[starts[c]:starts[c] + lengths[c]] for c in codes, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def order_bounds(ids: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 ascending values that split ``column`` (bigint) into equal shares."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx(F.col(column), shares, 10000).alias("b")).first()["b"]
    return sorted(set(found or []))


def order_places(ids: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The number of ``bounds`` at or below each bigint; 0 for null."""
    found = np.searchsorted(bounds, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
    found[ids.is_null().to_numpy(zero_copy_only=False)] = 0
    return pa.array(found)


def order_bucket(column, bounds: list[int]):
    """``order_places`` of a bigint column."""
    known = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return order_places(ids, known)

    return bucket(column)
