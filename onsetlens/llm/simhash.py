"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: two segments of 23 and one of 18.  If two fingerprints differ in four
bits or fewer, then either a segment is equal, and one of the other two differs in at most two
bits; or every segment differs, each in at most two bits, and so does the last one in at most
two of its three blocks of 6 bits.  Segments that differ in at most two bits share an index of
the Golay code, so the keys

* (a segment, the Golay indices of another one), six such pairs of segments, and
* (Golay indices of the first, Golay indices of the second, a block of the third), three blocks

bring together every pair to be linked, and no other condition is needed.  A key has 30 to 41
bits, so unrelated fingerprints seldom meet.  Only distinct fingerprints are keyed: copies are
one row.  A bucket of keys gives links that join its fingerprints, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from onsetlens.llm.common import by_bytes, partitions, small_batches, texts_of
from onsetlens.llm.components import components
from onsetlens.llm.golay import INDICES, LENGTH, indices
from onsetlens.session import materialise

SHINGLE = 4
SEED = 42
BITS = 4  # differing bits of a link; the keys below are complete for four
PIECE = 1 << 20  # bytes of a text split into words at once
ROWS_A_TASK = 2_000_000  # keyed rows
KEYS_EACH = 120  # keys of a fingerprint, about
FEW = 8  # bucket members compared all with all
WHOLE = 1 << 14  # bucket members one task compares; a larger bucket is cut into tiles
TILE = 1 << 13

_BLOCKS, _BLOCK = 3, 6


def word_pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, at most about ``limit`` bytes of it at a time."""
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":  # a word is not cut
            following = [p for p in (text.find(c, end, end + limit) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if p >= 0]
            end = min(following, default=min(end + limit, len(text)))
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, size: int = SHINGLE, limit: int = PIECE) -> int:
    """64 majority bits over the shingles of a text: words of the text, A-Z lower-cased.

    A text of fewer words has one shingle, all of them; one without words has fingerprint 0.
    """
    set_bits, many, carried = np.zeros(64, np.int64), 0, []
    for words in word_pieces(text, limit):
        words = carried + [w.lower() for w in words]
        carried = words[max(len(words) - size + 1, 0) :]
        if len(words) < size:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        hashes = [xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        many += len(hashes)
    if not many and carried:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED)
    return int(np.packbits(2 * set_bits > many, bitorder="little").view("<u8")[0])


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints (uint64)."""
    low = (1 << LENGTH) - 1
    segments = [(prints >> np.uint64(s) & np.uint64(low)).astype(np.int64) for s in (0, LENGTH)]
    segments.append((prints >> np.uint64(2 * LENGTH)).astype(np.int64))
    widths = (LENGTH, LENGTH, 64 - 2 * LENGTH)
    golay = [indices(segment, width) for segment, width in zip(segments, widths)]
    rows, keys = [], []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                values, used = golay[j]
                row, column = np.nonzero(used)
                rows.append(row)
                keys.append((kind << 40) | (segments[i][row] << 12) | values[row, column])
                kind += 1
    (first, first_used), (second, second_used) = golay[0], golay[1]
    both = (first_used[:, :, None] & second_used[:, None, :]).reshape(len(prints), -1)
    pair = ((first[:, :, None] << 12) | second[:, None, :]).reshape(len(prints), INDICES * INDICES)
    row, column = np.nonzero(both)
    for block in range(_BLOCKS):
        part = segments[2] >> (_BLOCK * block) & ((1 << _BLOCK) - 1)
        rows.append(row)
        keys.append((kind << 40) | (pair[row, column] << _BLOCK) | part[row])
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


class Forest:
    """Union-find over the linked fingerprints of a task: a link is new if it joins two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, v: int) -> int:
        parent = self.parent
        top = v
        while (up := parent.get(top, top)) != top:
            top = up
        while v != top:
            v, parent[v] = parent.get(v, v), top
        return top

    def joined(self, a: int, b: int) -> bool:
        a, b = self._root(a), self._root(b)
        if a == b:
            return False
        self.parent[a] = b
        self.parent.setdefault(b, b)
        return True


def spanning_links(prints: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, int]]:
    """Links that connect what the links within ``bits`` connect: fewer than there are members.

    A reached member is compared with those not yet reached, so a bucket that is one group ends
    after few comparisons.
    """
    left = np.arange(len(prints))
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= bits
            for other in left[near].tolist():
                yield at, other
                reached.append(other)
            left = left[~near]


_SIGNED = pa.int64()


def _links_batch(links: list[tuple[int, int]], bucket: np.ndarray | None = None, members: np.ndarray | None = None) -> pa.RecordBatch:
    a, b = (np.array([link[i] for link in links], np.uint64).view(np.int64) for i in (0, 1))
    if members is None:
        columns = [pa.array(a), pa.array(b), pa.nulls(len(a), _SIGNED)]
    else:
        columns = [pa.array(members.view(np.int64)), pa.nulls(len(members), _SIGNED), pa.array(bucket)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "key"])


def _bucket_links(keys: np.ndarray, prints: np.ndarray, forest: Forest, bits: int) -> list[tuple[int, int]]:
    """New links of whole buckets; rows come sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found: list[tuple[int, int]] = []
    small = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    at = np.flatnonzero(small)
    for shift in range(1, FEW):
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= bits]
        found += zip(prints[near].tolist(), prints[near + shift].tolist())
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        part = prints[start : start + size]
        found += ((int(part[i]), int(part[j])) for i, j in spanning_links(part, bits))
    return [(a, b) for a, b in found if forest.joined(a, b)]


def _within_buckets(whole: int, bits: int):
    """(key, print) sorted by key to links (a, b, null); the members of a larger bucket as (a, null, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        too_large = None  # the bucket that is being handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            prints = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            begin = int(np.searchsorted(keys, keys[-1]))
            if begin:  # all buckets but the last are whole
                if too_large is not None and keys[0] == too_large:
                    end = int(np.searchsorted(keys, too_large, side="right"))
                    yield _links_batch([], keys[:end], prints[:end])
                    links = _bucket_links(keys[end:begin], prints[end:begin], forest, bits) if end < begin else []
                else:
                    links = _bucket_links(keys[:begin], prints[:begin], forest, bits)
                if links:
                    yield _links_batch(links)
                keys, prints, too_large = keys[begin:], prints[begin:], None
            if too_large is not None or len(keys) > whole:
                too_large = keys[0]
                yield _links_batch([], keys, prints)
                keys, prints = keys[:0], prints[:0]
            held_keys, held = keys, prints
        if len(held):
            links = _bucket_links(held_keys, held, forest, bits)
            if links:
                yield _links_batch(links)

    return run


def _within_tiles(bits: int):
    """(key, i, j, print) sorted by the first three to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now, held = Forest(), None, []

        def links():
            members = np.concatenate(held)
            pairs = [(int(members[i]), int(members[j])) for i, j in spanning_links(members, bits)]
            return _links_batch([p for p in pairs if forest.joined(*p)]).select(["a", "b"])

        for batch in batches:
            marks = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            prints = batch.column(3).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)]):
                if first == last:
                    continue
                if now is not None and tuple(marks[first]) != now:
                    yield links()
                    held = []
                now = tuple(marks[first])
                held.append(prints[first:last])
        if held:
            yield links()

    return run


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                texts = texts_of(batch.column(1)).cast(pa.binary())
                found = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "print"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for first in range(0, len(prints), 1000):
            part = prints[first : first + 1000]
            row, key = bucket_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], ["key", "print"])


def fingerprint_links(prints: DataFrame, bits: int = BITS, whole: int = WHOLE, tile: int = TILE) -> DataFrame:
    """(a, b): links within ``bits`` that connect all that such links connect.

    ``prints`` holds distinct fingerprints in ``print`` (long) and is read twice.  A bucket of
    more than ``whole`` of them is cut into tiles, and tasks compare pairs of tiles.
    """
    if bits > BITS:
        raise ValueError(f"the keys are complete for at most {BITS} bits")
    spark = prints.sparkSession
    tasks = max(partitions(spark), -(-prints.count() * KEYS_EACH // ROWS_A_TASK))
    keyed = prints.select("print").mapInArrow(_keyed, "key long, print long")
    dealt = keyed.repartition(tasks, "key").sortWithinPartitions("key")
    found = materialise(dealt.mapInArrow(_within_buckets(whole, bits), "a long, b long, key long"), "links")
    links = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("print"))
    if not large.limit(1).count():
        return links
    tiles = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = large.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    # More than ``whole`` members, so two tiles at least, and every tile meets each other one.
    other = F.explode(F.array_remove(F.expr("sequence(0, tiles - 1)"), F.col("tile")))
    met = placed.withColumn("other", other).select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "print")
    paired = met.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.union(paired.mapInArrow(_within_tiles(bits), "a long, b long"))


def simhash_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, bits: int = BITS, whole: int = WHOLE, tile: int = TILE
) -> DataFrame:
    """(id, fingerprint string, component_id long), one row per document.

    A-Z are lower-cased, words stand between ASCII white space, repeated shingles count each
    time; a bit is set if it is set in more than half of their hashes.  Documents are linked if
    their fingerprints differ in ``bits`` bits at most; ``component_id`` is the smallest id
    reachable.  A null text, or one without words, has fingerprint zero and is linked like any
    other.  Rows that repeat an id are documents of their own.  A row with a null id has a
    fingerprint, links nothing and has component null.  An empty table gives an empty result;
    other columns are not read.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(documents[id_column].cast("long").alias("id"), documents[text_column].cast("string").alias("text"))
    prints = materialise(texts.mapInArrow(_fingerprints(shingle), "id long, print long"), "prints")
    classes = materialise(prints.where("id IS NOT NULL").groupBy("print").agg(F.min("id").alias("least")), "classes")
    roots = components(fingerprint_links(classes, bits, whole, tile))
    rooted = classes.join(roots.toDF("node", "root"), F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("print").alias("of"), "component_id")
    return prints.join(named, F.col("print") == F.col("of"), "left").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
