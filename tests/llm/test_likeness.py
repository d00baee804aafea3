"""Likeness of fingerprints against sets of paragraphs, on whole tables and where peeling retries."""

import numpy as np

from onsetlens.llm.fingerprint import fingerprint_documents, likeness
from onsetlens.llm.queries import op3_paragraph_sketch

SF = "/root/testdata/sf0.01"


def paragraphs(text):
    """Cut at line breaks, and at blanks behind a full stop, question or exclamation mark."""
    found = set()
    for line in text.split("\n"):
        now = ""
        for at, letter in enumerate(line):
            if letter in " \t" and (now[-1:] in (".", "!", "?") or (not now and at and line[at - 1] in " \t")):
                found.add(now)
                now = ""
            else:
                now += letter
        found.add(now)
    return {p for p in found if p.strip()}


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted((i, t or "") for i, t in rows)
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        yield i, near(text, text[: len(text) - cut] + following[:cut]), near(text, following)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in op3_paragraph_sketch(spark, SF).collect()}
    wanted = {i: (a, b) for i, a, b in expected(rows)}
    assert found.keys() == wanted.keys()
    assert [i for i in wanted if not np.allclose(found[i], wanted[i], rtol=0, atol=1e-12)] == []


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "A. B? C!\n\n \nD"), (4, "A. B? C!\nE"), (9, "A. B? C!\nE"), (10, "p\n" * 400 + "q"), (11, None)]
    found = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (a, b) for i, a, b in expected(rows)}


def test_retries():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    lefts = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 0, 1, 30, 500, 3000, 3000)]
    rights = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 7, 1, 400, 500, 3000, 10)]
    wanted = [len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if len(a) + len(b) else 1.0 for a, b in zip(lefts, rights)]
    assert np.allclose(likeness(lefts, rights), wanted, rtol=0, atol=1e-12)
