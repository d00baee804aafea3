"""Near-duplicate confirmation in tiles: rows grow with the classes, and no link is lost."""

import random
from contextlib import contextmanager

from onsetlens.llm import near_dup
from onsetlens.llm.near_dup import near_duplicates

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}


def roots(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.random()}"
    return " ".join(words)


def near_misses(n, seed=1, edits=4):
    """Edits of one text, most of them 0.7 to 0.8 like each other."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    return [(i, edited(rng, base, edits)) for i in range(n)]


@contextmanager
def counted(monkeypatch):
    """Rows of every table that the operator writes, by name."""
    rows, real = {}, near_dup.materialise

    def write(df, name="table", **settings):
        done = real(df, name, **settings)
        rows[name] = rows.get(name, 0) + done.count()
        return done

    with monkeypatch.context() as patch:
        patch.setattr(near_dup, "materialise", write)
        yield rows


def test_near_misses_are_few_rows(spark, monkeypatch):
    for n in (100, 200):
        texts = near_misses(n, edits=5)
        with counted(monkeypatch) as rows:
            found = near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == roots(texts)
        assert rows["pairs"] < n and rows["families"] <= n
        assert rows["candidates"] < 12 * n  # at most one per class and band, and far fewer


def test_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 16)
    monkeypatch.setattr(near_dup, "TILE_SHINGLES", 2000)
    texts = near_misses(90, seed=2) + [(1000 + i, t) for i, t in near_misses(40, seed=3, edits=3)]
    found = near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == roots(texts)


def test_chain_of_edits(spark):
    rng = random.Random(4)
    words, texts = [f"w{i}" for i in range(150)], []
    for i in range(60):
        texts.append((i, " ".join(words)))
        words[rng.randrange(150)] = f"c{i}"
    rng.shuffle(texts)
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    found = near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == roots(texts)
