"""Fingerprints and groups against brute force; the Golay keys against random pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from onsetlens.llm import simhash
from onsetlens.llm.golay import indices, nearest
from onsetlens.llm.simhash import bucket_keys, fingerprint, fingerprint_links, simhash_groups, word_pieces


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest number reachable over links of four bits or fewer, by comparing all pairs."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 4).tolist():
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_golay_indices():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flips = 1 << np.arange(23)
    assert len(set(nearest(words).tolist())) > 1500 and len(set(nearest(np.arange(1 << 23)).tolist())) == 4096
    values, used = indices(words)
    assert set(used.sum(axis=1).tolist()) == {1, 6}
    for errors in (1, 2):
        other = words.copy()
        for row in range(len(words)):
            other[row] ^= flips[rng.choice(23, errors, replace=False)].sum()
        theirs, theirs_used = indices(other)
        for a, b, c, d in zip(values, used, theirs, theirs_used):
            assert set(a[b].tolist()) & set(c[d].tolist())


def test_every_pair_of_four_bits_shares_a_key():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    other = base.copy()
    for row in range(len(other)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            other[row] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for prints in (base, other):
        row, key = bucket_keys(prints)
        keys.append([set() for _ in prints])
        for r, k in zip(row.tolist(), key.tolist()):
            keys[-1][r].add(k)
    assert all(a & b for a, b in zip(*keys))


def test_words_in_pieces():
    text = ("Ab c\t d\n\n" + "longword" * 9 + " e\x0bf ") * 20
    for limit in (1, 5, 40, 10_000):
        assert [w for piece in word_pieces(text.encode(), limit) for w in piece] == text.encode().split()
        assert fingerprint(text.encode(), limit=limit) == slow_fingerprint(text)


def cloud(rng, centre, many):
    """Distinct fingerprints, each a few bits from an earlier one."""
    found = [centre]
    while len(found) < many:
        new = rng.choice(found[-50:])
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            new ^= 1 << bit
        if new not in found:
            found.append(new)
    return found


@pytest.mark.parametrize("whole, tile", [(1 << 14, 1 << 13), (20, 10)])
def test_links(spark, whole, tile):
    """The tiles of large buckets find what whole buckets find; links stay fewer than members."""
    rng = random.Random(3)
    prints = [p for _ in range(6) for p in cloud(rng, rng.getrandbits(64), 120)]
    few_bits = [sum(1 << b for b in rng.sample(range(12), 6)) << 30 for _ in range(400)]
    prints = list(dict.fromkeys([*prints, *few_bits, 0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(300))]))
    wanted = groups(prints)
    table = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long").cache()
    at = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = fingerprint_links(table, whole=whole, tile=tile).collect()
    for a, b in links:
        assert np.bitwise_count(np.uint64(prints[at[a]]) ^ np.uint64(prints[at[b]])) <= 4
        a, b = top(at[a]), top(at[b])
        root[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(prints))] == wanted
    if whole > len(prints):  # a task hands on a link once, whatever the number of buckets
        assert len(links) <= 8 * len(prints)


def test_groups_of_documents(spark, small):
    rng = random.Random(4)
    base = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(200)] = f"other{rng.randrange(9)}"
        rows.append((i, "  ".join(words).upper() if i % 2 else " ".join(words), "s", 1, "c"))
    texts = ["", None, " \t", "one two", "One  TWO", "a b c d", "a b c d e", "x" * 300_000, "y z " * 200_000, "é É"]
    rows += [(100 + i, t, "s", 1, "c") for i, t in enumerate(texts)]
    rows += [(None, " ".join(base), "s", 1, "c"), (5, "another text of the same id", "s", 1, "c"), (3, rows[3][1], "s", 1, "c")]
    schema = "doc_id long, text string, print string, id int, component_id string"
    found = simhash_groups(spark.createDataFrame(rows, schema)).collect()
    named = [r for r in rows if r[0] is not None]
    prints = [slow_fingerprint(r[1]) for r in named]
    top = groups(prints)
    least = {}
    for r, t in zip(named, top):
        least[t] = min(least.get(t, r[0]), r[0])
    wanted = [(r[0], f"{p:016x}", least[t]) for r, p, t in zip(named, prints, top)]
    wanted.append((None, f"{slow_fingerprint(' '.join(base)):016x}", None))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)
    assert simhash_groups(spark.createDataFrame([], schema)).collect() == []

    table = spark.read.parquet(f"{small}/documents.parquet")
    texts = table.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [slow_fingerprint(t) for _, t in texts]
    top = groups(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(table).collect()}
    assert found == {d: (f"{p:016x}", texts[t][0]) for (d, _), p, t in zip(texts, prints, top)}


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        fingerprint_links(spark.createDataFrame([(1,)], "print long"), bits=simhash.BITS + 1)
