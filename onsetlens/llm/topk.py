"""Exact top-k by inner product: tiles of queries times shards of rows, merged as a tree.

Queries and rows are packed into blocks of bounded size.  A task multiplies a tile with one
shard after the other and keeps k rows per query; lists of a query meet in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from onsetlens.llm.common import partitions
from onsetlens.session import materialise, parallel_tasks

BLOCK_ROWS = 4096  # vectors in a packed block
GROUP_SHARDS = 16  # about so many shards at most form a group, which a task holds while tiles go by
BRANCHES = 16  # of the merge tree
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _blocks(scale: int, rows: int):
    """Packs (id, v) into (n, dim, top, ids binary, parts binary) with at most ``rows`` vectors each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def hand_on(dim):
            ids, parts = np.concatenate([p[0] for p in held[dim]]), np.concatenate([p[1] for p in held[dim]])
            held[dim] = []
            for i in range(0, len(ids), rows):
                part = np.ascontiguousarray(parts[i : i + rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(part)], pa.int64()),
                        pa.array([dim], pa.int64()),
                        pa.array([float(np.abs(part).max(initial=0.0))]),
                        pa.array([ids[i : i + rows].tobytes()], pa.binary()),
                        pa.array([part.tobytes()], pa.binary()),
                    ],
                    ["n", "dim", "top", "ids", "parts"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = batch.column(1)
            flat = vectors.flatten()
            known = ~flat.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                parts = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            good = known & np.isfinite(parts)
            sizes = np.diff(vectors.offsets.to_numpy().astype(np.int64))
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~good)])
            whole = bad[ends] == bad[ends - sizes]
            for dim in np.unique(sizes[whole]):
                chosen = np.flatnonzero(whole & (sizes == dim))
                at = (ends - sizes)[chosen][:, None] + np.arange(dim)[None, :]
                held.setdefault(int(dim), []).append((ids[chosen], parts[at].reshape(len(chosen), int(dim))))
                if sum(len(p[0]) for p in held[int(dim)]) >= rows:
                    yield from hand_on(int(dim))
        for dim in sorted(held):
            if held[dim]:
                yield from hand_on(dim)

    return pack


def _scores(queries: np.ndarray, parts: np.ndarray, bound: float) -> np.ndarray:
    """Whole inner products: in doubles while every sum is exact, else in whole numbers."""
    if bound < _EXACT:
        return (queries @ parts.T).astype(np.int64)
    if bound < _LONG:
        return queries.astype(np.int64) @ parts.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    wide = whole(queries).reshape(queries.shape) @ whole(parts).reshape(parts.shape).T
    return np.clip(wide, -_LONG - 1, _LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of every row by (score descending, id), by partial selection and a small sort."""
    if scores.shape[1] > 4 * k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        wide = (scores >= kth[:, None]).sum(axis=1).max()
        if wide <= scores.shape[1] // 2:
            # Ties at the border stay in, so that the smaller ids win.
            keep = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
            scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the k best rows of every query.

    Components count as floor(scale * x), the score is the whole inner product, ties go to the
    smaller id; rows with the id of the query are no candidates.  Rows with a null id and vectors
    that are null or hold a null or non-finite component take no part; vectors of another length
    than the query are not compared with it.  Each repeated row counts for itself (a repeated
    query gives one list, over its rows).  A query without candidates gives no row, fewer than k
    candidates give all; empty tables give an empty result.  A score beyond a long is given as
    the nearest long.  Other columns are not read.
    """
    def packed(df, rows):
        chosen = df.select(df[id_column].cast("long").alias("id"), df[vector_column].cast("array<double>").alias("v"))
        return chosen.where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(
            _blocks(scale, rows), "n long, dim long, top double, ids binary, parts binary"
        )

    shards = materialise(packed(vectors, BLOCK_ROWS), "shards")
    # Queries are few in a partition: bring them together by tiles before they are packed.
    asked = queries.select(queries[id_column].cast("long").alias(id_column), queries[vector_column].alias(vector_column))
    total = asked.count()
    tiles = materialise(
        packed(asked.repartition(max(1, -(-total // BLOCK_ROWS)), id_column), BLOCK_ROWS), "tiles"
    ).withColumn("tile", F.xxhash64("ids", "parts"))
    # Enough groups for all cores; more only where a group would be too large for a task, as a tile is repeated for each.
    found = shards.count()
    groups = max(1, min(found, max(parallel_tasks(vectors.sparkSession), -(-found // GROUP_SHARDS))))
    shards = shards.withColumn("group", F.pmod(F.xxhash64("ids", "parts"), F.lit(groups)))
    left = tiles.select(
        "tile", "dim", F.col("top").alias("q_top"), F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("group"),
    )
    # Spark takes the tiles for small, as it does not count the repeats, and would broadcast them by way of the driver.
    tasks = max(groups, partitions(vectors.sparkSession))
    left, right = (side.repartition(tasks, "group", "dim") for side in (left, shards))
    met = left.join(right.hint("merge"), ["group", "dim"]).select("group", "tile", "dim", "q_top", "top", "q_ids", "q_parts", "ids", "parts")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                tile = np.frombuffer(row["q_parts"]).reshape(len(q_ids), dim)
                shard = np.frombuffer(row["parts"]).reshape(len(ids), dim)
                for i in range(0, len(q_ids), 256):
                    scores = _scores(tile[i : i + 256], shard, row["q_top"] * row["top"] * max(dim, 1))
                    # A query may meet its own id: take more, by as many rows as bear it.
                    own = (q_ids[i : i + 256, None] == ids[None, :]).sum(axis=1)
                    many = min(k + int(own.max(initial=0)), len(ids))
                    best, who = _best(scores, np.broadcast_to(ids, scores.shape), many)
                    asked_by = np.repeat(q_ids[i : i + 256], best.shape[1])
                    best, who = best.ravel(), who.ravel()
                    other = asked_by != who
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(other.sum(), row["group"], np.int64)),
                            pa.array(asked_by[other]),
                            pa.array(who[other]),
                            pa.array(best[other]),
                        ],
                        ["group", "query_id", "vec_id", "score"],
                    )

    partial = met.mapInArrow(multiply, "group long, query_id long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]

    def merged(lists, *keys):
        ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where(F.col("rank") <= k)

    branched = merged(partial.withColumn("branch", F.pmod("group", F.lit(BRANCHES))), "query_id", "branch").drop("rank")
    return merged(branched, "query_id").select("query_id", "rank", "vec_id", "score")
