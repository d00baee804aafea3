"""Runs against all periods of every text, and the digest of the contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from onsetlens.llm.periodic import collapse_runs, periodic_runs, run_digest


def all_runs(words):
    """(start, length, period) by comparing the words with themselves at every distance."""
    n, found = len(words), []
    for p in range(1, n // 3 + 1):
        x = 0
        while x + p < n:
            if words[x] != words[x + p]:
                x += 1
                continue
            start = x
            while x + p < n and words[x] == words[x + p]:
                x += 1
            length = x + p - start
            part = words[start : start + length]
            if length >= max(24, 3 * p) and not any(all(part[i] == part[i + q] for i in range(length - q)) for q in range(1, p)):
                found.append((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, l, p in runs for i in range(s + p, s + l)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(rng, many):
    """Random words with loops of all lengths, loops within loops, and near loops."""
    out = []
    for _ in range(many):
        words = [rng.choice("abcdefgh") if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            period = rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 16, 23, 24, 25, 31, 33, 47, 48, 49, 64, 70, 95, 96, 97, 130])
            kind = rng.random()
            if kind < 0.3:
                root = [f"r{rng.randrange(1000)}" for _ in range(period)]
            elif kind < 0.6:  # a period that is itself nearly periodic
                inner = [rng.choice("xyz") for _ in range(rng.choice([1, 2, 3]))]
                root = (inner * period)[: max(period - 1, 1)] + ["end"]
            else:
                root = [rng.choice("pq") for _ in range(period)]
            length = int(len(root) * rng.choice([2.5, 2.9, 3, 3.1, 3.5, 4.2, 6]))
            words += (root * 7)[:length]
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = "break"
        out.append(words)
    return out


def test_runs_against_every_period():
    rng = random.Random(5)
    made = sorted(texts(rng, 400), key=lambda w: -len(w))
    coded, ends, code = [], [], {}
    for i, words in enumerate(made):
        coded += [code.setdefault(w, len(code)) for w in words] + [10**6 + i]
        ends.append(len(coded) - 1)
    found = periodic_runs(np.array(coded, np.int64), np.array(ends))
    found = found[found[:, 1] - found[:, 0] >= 24].tolist()
    wanted, begin = [], 0
    for words, end in zip(made, ends):
        wanted += [[s + begin, s + begin + l, p] for s, l, p in all_runs(words)]
        begin = end + 1
    assert len(wanted) > 300 and sorted(found) == sorted(wanted)


def test_documents(spark, small):
    rng = random.Random(9)
    rows = [(i, " ".join(w), "x", 1, 2) for i, w in enumerate(texts(rng, 60))]
    rows += [(100, None, "x", 1, 2), (101, "", "x", 1, 2), (102, " \t\n ", "x", 1, 2), (None, "a " * 30, "x", 1, 2)]
    rows += [(103, "A\x0bb\x0cA b\r\n" * 20, "x", 1, 2), (103, "A b " * 20, "x", 1, 2), (104, "é ü " * 40, "x", 1, 2)]
    rows += [(105, "l " * 40_000, "x", 1, 2), (106, " ".join(f"w{i % 7001}" for i in range(30_000)), "x", 1, 2)]
    schema = "doc_id long, text string, runs string, id int, n_words int"
    table = spark.createDataFrame(rows, schema)
    found = {(r["doc_id"], r["n_words"], r["text"]): r for r in collapse_runs(table).collect()}
    assert len(found) == len(rows)
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 5000:
            runs = [(0, 40_000, 1)] if doc == 105 else [(0, 30_000, 7001)]
        else:
            runs = all_runs(words)
        row = found[doc, len(words), collapsed(words, runs)]
        assert [tuple(r) for r in row["runs"]] == runs
    empty = spark.createDataFrame([], schema)
    assert collapse_runs(empty).collect() == [] == run_digest(empty).collect()

    documents = spark.read.parquet(f"{small}/documents.parquet")
    short = documents.where("n_chars < 6000")
    digests = {r["doc_id"]: r for r in run_digest(short).collect()}
    some = 0
    for doc, text in short.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        some += len(runs)
        row = digests[doc]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{l},{p}\n" for s, l, p in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 10
