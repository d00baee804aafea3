"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Each paragraph of a document is hashed into cells of (count, xor of digests, xor of checks).
Cells of two versions subtract; peeling cells that hold one digest recovers the paragraphs in
which they differ.  Where peeling stalls, both sketches are made again at twice the size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from onsetlens.llm.common import BATCH_BYTES, BUCKETS_PER_PARTITION, order_bounds, order_bucket, partitions, small_batches

CELLS = 24  # of a stored fingerprint, and of the first try of a comparison
PLACES = 3  # cells that a digest goes to, one in each third of the sketch
TRIES = 40  # sketches per comparison; sizes double while they are below four times the digests

# A paragraph ends at a line break, or at white space behind the end of a sentence.
_BREAK = re.compile(r"\n+|(?<=[.!?])[ \t]+")


def paragraph_digests(text: str) -> np.ndarray:
    """Ascending 64-bit digests of the distinct paragraphs of a text that are not blank."""
    return np.array(sorted({xxhash.xxh3_64_intdigest(p) for p in _BREAK.split(text) if p and not p.isspace()}), np.uint64)


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (two rounds of shift, xor and multiply) of values and a seed."""
    v = values + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


class Sketches:
    """Sketches of many documents side by side in flat arrays; sketch i has sizes[i] cells."""

    def __init__(self, sizes: np.ndarray, seed: int = 0):
        self.sizes, self.seed = sizes, seed
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.offsets[-1])
        self.count, self.key, self.check = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    def places(self, owner: np.ndarray, digests: np.ndarray) -> np.ndarray:
        third = (self.sizes[owner] // PLACES).astype(np.uint64)
        found = [
            self.offsets[owner] + ((_mix(digests, PLACES * self.seed + j + 1) % third) + np.uint64(j) * third).astype(np.int64)
            for j in range(PLACES)
        ]
        return np.concatenate(found)

    @staticmethod
    def checks(digests: np.ndarray) -> np.ndarray:
        return (_mix(digests, 977) >> np.uint64(32)).astype(np.uint32)

    def add(self, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        at = self.places(owner, digests)
        np.add.at(self.count, at, np.tile(np.broadcast_to(np.asarray(sign, np.int32), owner.shape), PLACES))
        np.bitwise_xor.at(self.key, at, np.tile(digests, PLACES))
        np.bitwise_xor.at(self.check, at, np.tile(self.checks(digests), PLACES))
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.sizes, self.seed)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(solved, only left, only right): digests recovered per sketch; empties the cells."""
        cell_owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        left, right = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        # A digest is taken once more at most than it can stand in the sketch: rounds end.
        for _ in range(int(self.sizes.max(initial=0)) + 1):
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.checks(self.key) == self.check))
            if not len(pure):
                break
            owner, digest, sign = cell_owner[pure], self.key[pure], self.count[pure]
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], sign[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            owner, digest, sign = owner[new], digest[new], sign[new]
            np.add.at(left, owner, sign > 0)
            np.add.at(right, owner, sign < 0)
            self.add(owner, digest, -sign)
        open_cells = (self.count != 0) | (self.key != 0)
        return np.bincount(cell_owner[open_cells], minlength=len(self.sizes)) == 0, left, right

    def strings(self) -> list[str]:
        cells = np.zeros(len(self.count), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check
        data, size = cells.tobytes(), cells.itemsize
        return [base64.b64encode(data[a * size : b * size]).decode() for a, b in zip(self.offsets, self.offsets[1:])]


def _flat(sets: list[np.ndarray], chosen) -> tuple[np.ndarray, np.ndarray]:
    picked = [sets[i] for i in chosen]
    owner = np.repeat(np.arange(len(picked)), [len(s) for s in picked])
    return owner, np.concatenate(picked) if len(picked) else np.zeros(0, np.uint64)


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    return Sketches(np.full(len(sets), cells)).add(*_flat(sets, range(len(sets)))).strings()


def likeness(lefts: list[np.ndarray], rights: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Shared over all distinct paragraphs of each pair, from what peeling recovers; 1 for two empty sets.

    A pair whose cells do not peel is tried again with twice the cells, up to four cells per
    digest of both, then with other hash functions.  Should all TRIES stall, its sets are compared.
    """
    n_left = np.array([len(s) for s in lefts], np.int64)
    most = 4 * (n_left + np.array([len(s) for s in rights], np.int64))
    out, open_pairs, size = np.ones(len(lefts)), np.arange(len(lefts)), cells
    for attempt in range(TRIES):
        sizes = np.maximum(np.minimum(size, most[open_pairs]), cells) // PLACES * PLACES
        a = Sketches(sizes, attempt).add(*_flat(lefts, open_pairs))
        b = Sketches(sizes, attempt).add(*_flat(rights, open_pairs))
        solved, only_left, only_right = a.minus(b).peel()
        shared = n_left[open_pairs] - only_left
        union = shared + only_left + only_right
        out[open_pairs] = np.where(union > 0, shared / np.maximum(union, 1), 1.0)
        open_pairs, size = open_pairs[~solved], size * 2
        if not len(open_pairs):
            return out
    for i in open_pairs:
        shared = len(np.intersect1d(lefts[i], rights[i]))
        out[i] = shared / max(1, len(lefts[i]) + len(rights[i]) - shared)
    return out


def _compare(rows: list[tuple], following: list[str], text_sets: list, next_set: np.ndarray, cells: int) -> pa.RecordBatch:
    edited = []
    for (_, text), after in zip(rows, following):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    edited_sets = [paragraph_digests(t) for t in edited]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(fingerprints(text_sets, cells)),
            pa.array(fingerprints(edited_sets, cells)),
            pa.array(likeness(text_sets, edited_sets, cells)),
            pa.array(likeness(text_sets, [*text_sets[1:], next_set], cells)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def fingerprint_documents(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", cells: int = CELLS
) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and how near they and the next one are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending id; the first follows the last.  Null texts are empty.
    Null ids stand first; rows of one id stand in order of their texts, each with a row of its
    own in the result.  A single document follows itself; an empty table gives no rows.  Other
    columns are not read.  ``near_edited`` and ``near_next`` are shared over all distinct
    paragraphs, from the digests that subtracting and peeling the sketches recover.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kept = documents.select(
        documents[id_column].cast("long").alias("doc_id"), F.coalesce(documents[text_column].cast("string"), F.lit("")).alias("text")
    )
    count = partitions(spark)
    bounds = order_bounds(kept, "doc_id", BUCKETS_PER_PARTITION * count)
    bucket = order_bucket(F.col("doc_id"), bounds)
    # First id of each bucket, one row for each of the bounded number of buckets.
    firsts = kept.groupBy(bucket.alias("bucket")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")
    ).collect()
    firsts = sorted((r["bucket"], None if r["nulls"] else r["doc_id"]) for r in firsts)
    if not firsts:
        return spark.createDataFrame([], _RESULT)
    known = [first for _, first in firsts if first is not None]
    wanted = F.col("doc_id").isin(known) if known else F.lit(False)
    if len(known) < len(firsts):
        wanted = wanted | F.col("doc_id").isNull()
    # The first document of a bucket stands once more at the end of the bucket before.
    to = spark.createDataFrame(
        [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)], "bucket int, first long"
    )
    ahead = kept.where(wanted).groupBy("doc_id").agg(F.min("text").alias("text"))
    ahead = ahead.join(F.broadcast(to), F.expr("doc_id <=> first"))  # one row per bucket
    dealt = (
        kept.select(bucket.alias("bucket"), F.lit(False).alias("ahead"), "doc_id", "text")
        .unionByName(ahead.select("bucket", F.lit(True).alias("ahead"), "doc_id", "text"))
        .repartition(count, "bucket")
        .sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("doc_id"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        sets: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for at, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                digests = paragraph_digests(text)
                if rows and (at or size > BATCH_BYTES):
                    following = [*[t for _, t in rows[1:]], text]
                    yield _compare(rows, following, sets, digests, cells)
                    rows, sets, size = [], [], 0
                if not at:  # a row ahead ends its bucket
                    rows.append((doc_id, text))
                    sets.append(digests)
                    size += len(text)

    return dealt.mapInArrow(run, _RESULT)
