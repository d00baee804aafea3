"""The near-dedup stage where an id is repeated with different texts."""

from onsetlens.llm.near_dup import without_near_duplicates


def test_texts_of_one_id_are_decided_one_by_one(spark):
    x, z, p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "xzpq")
    rows = [(5, x, "a"), (7, x, "a"), (7, z, "b"), (8, x + " end", "c"), (8, p, "c"), (9, q, "e"), (9, q, "d"), (9, None, "f"), (None, x, "g")]
    expected = [(5, x, "a"), (7, z, "b"), (8, p, "c"), (9, q, "d"), (9, None, "f"), (None, x, "g")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        found = without_near_duplicates(docs, shingle=5)
        assert found.columns == docs.columns
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_no_text_goes_where_no_row_is_a_copy(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    docs = spark.createDataFrame([(9, p), (9, q)], "doc_id long, text string")
    assert sorted(r["text"] for r in without_near_duplicates(docs, shingle=5).collect()) == [p, q]
