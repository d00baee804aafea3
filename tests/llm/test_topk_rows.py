"""Exact top-k over awkward tables: empty, null ids, repeated rows, ties, clashing columns."""

import numpy as np

from onsetlens.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, id long, score string, rank string, parts string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", "r", "p") for i, v in rows], SCHEMA)


def lists(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def brute(rows, queries, k):
    whole = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    out = []
    for q, x in [(i, x) for i, x in whole if i in queries]:
        best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:k]
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(best, 1)]
    return sorted(out)


def test_empty(spark):
    some, none = made(spark, [(1, [1.0]), (2, [2.0])]), made(spark, [])
    assert lists(top_k(none, none)) == lists(top_k(some, none)) == lists(top_k(none, some)) == []
    assert lists(top_k(some, some.where("vec_id = 1"))) == [(1, 1, 2, 256 * 512)]


def test_ties_repeats_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]  # many equal scores
    rows += [(70, rows[5][1]), (70, rows[6][1]), (70, rows[5][1]), (-4, rows[7][1])]  # an id with three rows
    odd = [(None, [1.0, 1.0, 1.0]), (80, None), (81, [None, 1.0, 1.0]), (82, [float("inf"), 0.0, 0.0]), (83, [1.0])]
    table = made(spark, rows + odd)
    found = lists(top_k(table, table.where("vec_id IS NULL OR vec_id IN (0, 20, -4, 80, 81, 82, 83)"), k=7))
    assert found == brute(rows, {0, 20, -4}, 7)


def test_no_tiles_by_way_of_the_driver(spark, monkeypatch):
    # Several groups: the tiles are repeated for each, which a broadcast would collect in the driver.
    monkeypatch.setattr("onsetlens.llm.topk.BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    found = top_k(made(spark, rows).repartition(3), made(spark, rows).where("vec_id % 10 = 0"), k=3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert lists(found) == brute(rows, set(range(0, 200, 10)), 3)
