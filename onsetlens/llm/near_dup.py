"""Near-duplicate documents: MinHash bands, Bayesian pruning of candidates, exact verification.

Equal sets are one class from the start.  Classes that share a band are candidates.  A candidate
is compared a batch of signature values at a time and dropped when the posterior that its
similarity reaches the threshold falls below the miss probability.  First each class is confirmed,
on full shingle sets, with one hub: the smallest class of its buckets that is left.  Then buckets
that still span several components are compared tile by tile; the survivors of different
components form families, and a family is confirmed in tiles that hold each set once.  Tiles hand
on joining links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from onsetlens.llm.common import by_bytes, fresh, partitions, ragged_take, small_batches, sums_between, texts_of
from onsetlens.llm.components import components
from onsetlens.llm.shingles import SHINGLE, MinHash, shingle_sets, similar
from onsetlens.session import materialise

PERCENT = 80
BAND_ROWS, BANDS = 6, 40  # a pair at the threshold shares no band with probability (1 - 0.8^6)^40 = 5e-6
BATCH = 48  # signature values compared at a time
MISS = 1e-4  # posterior probability of reaching the threshold at which a candidate is dropped
TILE = 1024  # classes of a bucket, or of a family, in one tile
TILE_SHINGLES = 1 << 20  # shingles of a family in one tile, but for a longer single set
HUB_PARTS = 512  # tasks' worth of groups that the classes of one hub are dealt to


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Matches among n values below which P(similarity >= threshold | matches) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is the chance
    of at most m successes in n + 1 trials at the threshold.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def least_by_batch(n: int, percent: int, miss: float) -> list[int]:
    """``least_matches`` after each batch of n signature values."""
    return [least_matches(min(i + BATCH, n), percent / 100, miss) for i in range(0, n, BATCH)]


def survivors(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Numbers of the rows of ``left`` (or its only row) and ``right`` that no batch prunes."""
    alive = np.arange(len(right))
    matches = np.zeros(len(right), np.int64)
    for number, enough in enumerate(least):
        part = slice(number * BATCH, (number + 1) * BATCH)
        one = left[alive, part] if len(left) > 1 else left[:, part]
        matches = matches + (one == right[alive, part]).sum(axis=1)
        keep = matches >= enough
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _texts(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(documents[id_column].cast("long").alias("id"), documents[text_column].cast("string").alias("text"))


def _sets(size: int, rows: int, bands: int):
    """(id, text) to (id, n, set_a, set_b, bands): size and 128-bit hash of the set, keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(rows * bands)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                sets = shingle_sets(texts_of(batch.column(1)), size)
                marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                keys = []
                for s in sets:
                    values = hashed(s).tobytes() if len(s) else b""
                    step = 2 * rows
                    keys.append([xxhash.xxh3_64_intdigest(values[i * step : (i + 1) * step], i) - (1 << 63) for i in range(bands)] if len(s) else [])
                halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "set_a", "set_b", "bands"],
                )

    return run


def _signatures(size: int, rows: int, bands: int):
    """(id, text) to (id, n, signature, shingles), the last as 64-bit hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = MinHash(rows * bands)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                sets = shingle_sets(texts_of(batch.column(1)), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashed(s).tobytes() for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["id", "n", "signature", "shingles"],
                )

    return run


def _prune(least: list[int]):
    """(a, b, left, right) to the pairs (a, b) that the posterior leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.array([np.frombuffer(v, np.uint16) for v in batch.column(i).to_pylist()]) for i in (2, 3))
            alive = pa.array(survivors(left, right, least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], ["a", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Columns of the runs of rows with equal keys, as lists; rows come sorted by the keys."""
    now, held = None, {}
    for batch in batches:
        columns = batch.to_pydict()
        marks = list(zip(*(columns[k] for k in keys)))
        first = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[first]:
                part = {name: values[first:i] for name, values in columns.items()}
                if marks[first] == now:
                    for name, values in part.items():
                        held[name].extend(values)
                else:
                    if now is not None:
                        yield held
                    now, held = marks[first], part
                first = i
    if now is not None:
        yield held


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1, initial=-(1 << 63))), pa.array(pairs.min(axis=1, initial=(1 << 63) - 1))], ["a", "b"])


def _partners(group: dict, roots: np.ndarray, labels: np.ndarray, q: int) -> np.ndarray:
    """Rows of a tile that row ``q`` is compared with: not yet joined, each pair once."""
    other = (roots != roots[q]) & (labels != labels[q])
    if group["i"][0] != group["j"][0]:
        tiles = group["tile"]
        return np.flatnonzero(other & (tiles > tiles[q]))
    return np.flatnonzero(other & (group["id"] > group["id"][q]))


def _arrays(group: dict) -> tuple[dict, np.ndarray]:
    """The group with its numbers as arrays, and its signatures as a matrix."""
    numbers = {name: np.array(group[name], np.int64) for name in ("id", "root", "tile", "i", "j")}
    return group | numbers, np.array([np.frombuffer(v, np.uint16) for v in group["signature"]])


def _joining(group: dict, labels: np.ndarray, q: int, found: np.ndarray, links: list[tuple[int, int]]) -> None:
    """Appends the links from row ``q`` to the rows ``found`` that join two labels, and joins them."""
    for at in found.tolist():
        if labels[at] != labels[q]:
            links.append((int(group["id"][q]), int(group["id"][at])))
            labels[labels == labels[at]] = labels[q]


def _compare_tiles(least: list[int]):
    """Tiles of buckets to candidates of different components that the posterior leaves.

    Only those that join two families of the tile are handed on, so fewer than the tile has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for group in _grouped(batches, ["band", "key", "i", "j"]):
            group, values = _arrays(group)
            labels = np.unique(group["id"], return_inverse=True)[1]
            for q in range(len(labels)):
                other = _partners(group, group["root"], labels, q)
                if len(other):
                    _joining(group, labels, q, other[survivors(values[q : q + 1], values[other], least)], links)
            if len(links) > 10_000:
                yield _link_batch(links)
                links = []
        if links:
            yield _link_batch(links)

    return run


def _confirm_tiles(percent: int, least: list[int]):
    """Tiles of families to links whose full sets are similar and that join two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["family", "i", "j"]):
            group, values = _arrays(group)
            sizes = np.array(group["n"], np.int64)
            ends = np.cumsum(sizes)
            known, codes = np.unique(np.frombuffer(b"".join(group.pop("shingles")), np.uint64), return_inverse=True)
            marked = np.zeros(len(known), bool)
            labels, links = np.unique(group["root"], return_inverse=True)[1], []
            for q in range(len(labels)):
                other = _partners(group, group["root"], labels, q)
                if not len(other):
                    continue
                other = other[survivors(values[q : q + 1], values[other], least)]
                other = other[100 * np.minimum(sizes[other], sizes[q]) >= percent * np.maximum(sizes[other], sizes[q])]
                if not len(other):
                    continue
                own = codes[ends[q] - sizes[q] : ends[q]]
                marked[own] = True
                hits = marked[ragged_take(codes, ends - sizes, sizes, other)]
                marked[own] = False
                shared = sums_between(hits, np.concatenate([[0], np.cumsum(sizes[other])]))
                _joining(group, labels, q, other[100 * shared >= percent * (sizes[other] + sizes[q] - shared)], links)
            if links:
                yield _link_batch(links)

    return run


def _confirm_hubs(percent: int):
    """Sets by (hub, part), the hub first, to links (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []
        for batch in batches:
            links = []
            for hub, part, role, doc, s in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (hub, part) != now:
                    now, hubs = (hub, part), []
                s = np.frombuffer(s, np.uint64)
                if role == 0:
                    hubs.append(s)  # more than one only where an id is repeated
                elif any(similar(s, h, percent) for h in hubs):
                    links.append((doc, hub))
            yield _link_batch(links)

    return run


def _confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), one for each a, whose full sets are similar.

    A hub's set goes to the parts that its classes are dealt to: at most two rows a pair.
    """
    parted = pairs.select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.lit(HUB_PARTS)).cast("int").alias("part"), F.lit(1).alias("role"), F.col("a").alias("doc"))
    asked = parted.union(parted.select("hub", "part", F.lit(0), "hub").distinct())
    sets = asked.join(members.select("id", "shingles"), F.col("doc") == F.col("id")).select("hub", "part", "role", "doc", "shingles")
    dealt = sets.repartition(partitions(pairs.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "role")
    return dealt.mapInArrow(_confirm_hubs(percent), "a long, b long").distinct()


def _tiled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``tiles`` repeated for every tile (i, j) that they are part of."""
    own = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    spread = own.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).drop("tiles")
    paired = spread.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("other")
    keys = [*keys, "i", "j"]
    return paired.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _between_components(buckets: DataFrame, members: DataFrame, roots: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """Links (a, b) between classes that share a band but not yet a component."""
    rooted = buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_buckets = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    spread = rooted.join(open_buckets.select("band", "key"), ["band", "key"]).join(members.select("id", "signature"), "id")
    tiles = F.ceil(F.col("many") / TILE).cast("int").alias("tiles")
    tiled = _tiled(spread.select("band", "key", "id", "root", "signature", tiles), ["band", "key"])
    candidates = materialise(tiled.mapInArrow(_compare_tiles(least), "a long, b long").distinct(), "candidates")
    families = components(candidates).withColumnRenamed("root", "family")
    rows = families.join(members, "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = materialise(rows.select("family", "id", "root", "n", "signature", "shingles"), "families")
    sizes = rows.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")
    )
    return _tiled(rows.join(sizes, "family"), ["family"]).mapInArrow(_confirm_tiles(percent, least), "a long, b long").distinct()


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    band_rows: int = BAND_ROWS,
    bands: int = BANDS,
    miss: float = MISS,
) -> DataFrame:
    """(id, n_shingles long, component_id long, kept boolean), one row per document.

    A-Z are lower-cased, words stand between ASCII white space, a set holds the distinct
    ``shingle``-word shingles of the whole text (a shorter text: all its words as one; a text
    that is null or without words: none, linked with nothing).  Documents are linked when
    100 * shared >= percent * all; ``component_id`` is the smallest id reachable over links and
    ``kept`` says that it is the document's own.  Rows of one id are one node with the links of
    all its texts; a row with a null id links with nothing, has component null and is kept.  An
    empty table gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = _texts(documents, id_column, text_column)
    least = least_by_batch(band_rows * bands, percent, miss)
    schema = "id long, n long, set_a long, set_b long, bands array<long>"
    sets = materialise(texts.mapInArrow(_sets(shingle, band_rows, bands), schema), "sets")
    some = sets.where("n > 0 AND id IS NOT NULL")
    # All rows of a class have the same bands.
    classes = materialise(
        some.groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "classes"
    )
    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("many"), F.min("id").alias("least")).where("many > 1")
    buckets = materialise(banded.join(shared, ["band", "key"]).select("band", "key", "id", "least", "many"), "buckets")
    wanted = buckets.select("id").distinct()
    members = materialise(
        texts.join(wanted, "id", "left_semi").mapInArrow(
            _signatures(shingle, band_rows, bands), "id long, n long, signature binary, shingles binary"
        ),
        "members",
    )
    signatures = members.select("id", "signature")

    # First round: every class with one hub, the smallest of its buckets that the posterior leaves.
    stars = buckets.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    met = stars.join(signatures.toDF("id_a", "left"), F.expr("a = id_a")).join(signatures.toDF("id_b", "right"), F.expr("b = id_b"))
    left = met.select("a", "b", "left", "right").mapInArrow(_prune(least), "a long, b long")
    pairs = materialise(left.groupBy("a").agg(F.min("b").alias("b")), "pairs")
    links = materialise(_confirmed(pairs, members, percent), "links")
    roots = materialise(components(links), "roots")

    # Second round: in buckets of several components, classes of different ones.
    more = _between_components(buckets, members, roots, percent, least)
    roots = components(links.union(more))

    named = sets.select("id", "n", "set_a", "set_b").join(classes.select("set_a", "set_b", F.col("id").alias("class")), ["set_a", "set_b"], "left")
    known = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("class"))
    placed = named.withColumn("class", known).join(roots.toDF("node", "root"), F.col("class") == F.col("node"), "left")
    component = F.coalesce("root", "class", "id")
    return placed.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """One document of each group, the first by id and hash of the text; columns as given.

    Texts that share an id are documents of their own; of rows that are equal in id and text one
    stays, the first by its other columns.  Rows with a null id stay.
    """
    mark = fresh(documents, "_near")
    repeated = documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.limit(1).count():
        return _without_copies_of_texts(documents, **settings)
    gone = near_duplicates(documents, **settings).where("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    return documents.join(gone, documents["doc_id"] == F.col(mark), "left_anti")


def _without_copies_of_texts(documents: DataFrame, **settings) -> DataFrame:
    """``without_near_duplicates`` for ids that repeat: a node for each (id, text)."""
    doc, mark, row = (fresh(documents, name) for name in ("_doc", "_mark", "_row"))
    key = [documents["doc_id"].cast("long").alias(doc), F.xxhash64(documents["text"].cast("string")).alias(mark)]
    others = [documents[c] for c in documents.columns if c not in ("doc_id", "text")]
    rank = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = documents.where("doc_id IS NOT NULL").select(*key, F.struct(*documents.columns).alias(row), rank.alias("_rank"))
    single = rows.groupBy(doc, mark).agg(F.min_by(row, "_rank").alias(row))
    # Written at once, so that the numbers stay.
    single = materialise(single.withColumn("_node", F.monotonically_increasing_id()), "near-rows")
    texts = single.select(F.col("_node").alias("doc_id"), F.col(row)["text"].alias("text"))
    groups = near_duplicates(texts, **settings).select(F.col("doc_id").alias("_node"), "component_id")
    placed = materialise(single.select("_node", doc, mark).join(groups, "_node"), "near-groups")
    first = placed.groupBy("component_id").agg(F.min(F.struct(doc, mark, "_node"))["_node"].alias("_node")).select("_node")
    left = single.join(first, "_node", "left_semi").select(*[F.col(row)[c].alias(c) for c in documents.columns])
    return left.unionByName(documents.where("doc_id IS NULL"))
