"""The audit against brute force over all orders, on awkward rows."""

import re
from itertools import permutations

from onsetlens.llm.filter_audit import filter_audit, order_steps

DOCS = "doc_id long, text string, lang string, n int, mask string, digest int, labelled int"
LABELS = "doc_id long, quality int, toxic int, lang string, id int"


def failed(rows):
    """The letters each row fails."""
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            {
                letter
                for letter, fails in dict(
                    A=len(words) < 100,
                    B=100 * len(set(words)) < 80 * len(words),
                    C=100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                    D=re.search("[#$%&*|]", text) is not None,
                    E=doc is not None and doc > least[text],
                ).items()
                if fails
            }
        )
    return out


def audit(rows, labels):
    fails = failed(rows)
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    parts = {r[2] or "" for r in rows}
    found, shapley = {}, {}
    for part in parts:
        members = [(f, r[0] in good, r[0] in toxic) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[0]]
                left = [m for m in left if letter not in m[0]]
                total = [m for m in members if letter in m[0]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                alone = sum(m[0] == {letter} for m in members)
                lost = [sum(m[i] for m in gone) for i in (1, 2)]
                found[part, "".join(order), step] = [len(left), len(gone), len(total) - len(gone), alone, *lost]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long, long + " $", "ABC def", "ABC def", "", None, " \t", "a " * 150, long.upper(), long.upper() + " |", "é" * 50 + " É", "x " * 100_000]
    rows = [(i, t, [None, "en", "de", ""][i % 4], 1, "m", 2, 3) for i, t in enumerate(texts * 3)]
    rows += [(None, long, "en", 1, "m", 2, 3), (None, long, None, 1, "m", 2, 3), (0, long, "fr", 1, "m", 2, 3), (0, long, "fr", 1, "m", 2, 3)]
    rows += [(200 + i, long + "\x0bend", "en", 1, "m", 2, 3) for i in range(50)]
    labels = [(i, [0, 1, None][i % 3], [1, 0, None, 0][i % 4], "zz", 9) for i in range(0, 300, 2)] + [(0, 0, 0, "zz", 9), (4, 1, 1, "zz", 9), (None, 1, 1, "zz", 9)]
    found = filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert [f.dataType.simpleString() for f in found.schema.fields[:4]] == ["string", "string", "int", "bigint"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) == 600 * len({r[2] or "" for r in rows})
    assert set(got) == audit(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None, 1, "m", 2, 3)], DOCS)
    assert {tuple(r) for r in filter_audit(one, labels).collect()} == audit([(1, None, None)], [])


def test_steps(spark):
    """325 prefixes for every mask, whatever the data."""
    steps = order_steps(spark)
    assert steps.count() == 325 * 32 and steps.select("prefix").distinct().count() == 325
