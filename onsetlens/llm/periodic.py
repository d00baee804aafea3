"""Runs of words that repeat with a period, found by string synchronising sets.

The texts of a batch are one sequence of word numbers, with a number of its own after each text,
so that no run crosses texts.  At scales t = 8, 16, 32, ... a position is selected if the least
hash among the t + 1 windows of t words that start in the t words from it is that of the first
or the last one, where windows of a period up to t / 3 do not count.  Selection follows from the
2t words at a position, so a run selects alike one period later: the next position of equal
context (2t or 3t words) proposes the period.  Contexts of 2t words find the periods from 1.5t
to 2t, those of 3t words the ones up to 3t; shorter periods, and with them the windows that do
not count, come from comparing the sequence with itself at distances below 12.  Every proposal
is extended on the words themselves, so a collision of hashes adds and loses nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onsetlens.llm.common import by_bytes, small_batches, texts_of, words_of
from onsetlens.llm.shingles import mixed

REPEATS = 3  # a run has at least so many periods
LEAST_WORDS = 24  # and so many words
FIRST_SCALE = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _primes(n: int) -> list[int]:
    found, r = [], 2
    while r * r <= n:
        if n % r == 0:
            found.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return found + [n] * (n > 1)


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two or more periods from ``start`` has none that divides ``period``."""
    return not any(
        np.array_equal(words[start : start + period], words[start + period // r : start + period // r + period]) for r in _primes(period)
    )


def _equal_around(words: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """The stretch of positions x around ``at`` with words[x] = words[x + distance]."""
    end = len(words) - distance
    if at >= end or words[at] != words[at + distance]:
        return at, at
    lo, step = at, 64
    while lo > 0:
        first = max(lo - step, 0)
        wrong = np.flatnonzero(words[first:lo] != words[first + distance : lo + distance])
        if len(wrong):
            lo = first + int(wrong[-1]) + 1
            break
        lo, step = first, 2 * step
    hi, step = at + 1, 64
    while hi < end:
        last = min(hi + step, end)
        wrong = np.flatnonzero(words[hi:last] != words[hi + distance : last + distance])
        if len(wrong):
            hi += int(wrong[0])
            break
        hi, step = last, 2 * step
    return lo, hi


def _selected(ids: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising positions; ``ids`` are the hashes of the windows that count."""
    least, width = ids, 1
    while 2 * width <= scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])  # scale + 1 windows
    return np.flatnonzero((least != _NONE) & ((least == ids[: len(least)]) | (least == ids[scale : scale + len(least)])))


def _proposals(contexts: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """(distance, position) rows: the next position of equal context is low..high words away."""
    at = at[at < len(contexts)]
    here = contexts[at]
    order = np.argsort(here, kind="stable")
    same = here[order[1:]] == here[order[:-1]]
    position, gap = at[order[:-1]][same], (at[order[1:]] - at[order[:-1]])[same]
    wanted = (gap >= low) & (gap <= high)
    found = np.column_stack([gap[wanted], position[wanted]])
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def periodic_runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, end, period) of the maximal stretches of REPEATS or more of their smallest period.

    ``words`` holds texts by descending length, each followed by a value of its own; text i ends
    before ``ends[i]``, where that value stands.
    """
    found: list[tuple[int, int, int]] = []
    longest = int(np.diff(ends, prepend=-1).max(initial=1)) - 1
    for period in range(1, min(3 * FIRST_SCALE // 2, longest // REPEATS + 1)):
        equal = words[period:] == words[:-period]
        for start, last in zip(*(v.tolist() for v in _stretches(equal, (REPEATS - 1) * period))):
            if _smallest(words, start, period):
                found.append((start, last + period, period))
    lengths = np.diff(ends, prepend=-1) - 1
    hashes, scale = mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while 3 * scale // 2 * REPEATS <= longest:
        if scale >= FIRST_SCALE:  # only the texts that can hold three of the periods of this scale
            texts = int(np.searchsorted(-lengths, -(3 * scale // 2 * REPEATS), side="right"))
            words, hashes = words[: ends[texts - 1] + 1], hashes[: ends[texts - 1] + 1]
        if len(hashes) <= scale:
            break
        double = mixed(hashes[:-scale] * np.uint64(3) + hashes[scale:])
        if scale >= FIRST_SCALE:
            ids = hashes.copy()
            for start, end, period in found:
                if 3 * period <= scale <= end - start:
                    ids[start : end - scale + 1] = _NONE
            at = _selected(ids, scale)
            triple = mixed(double[:-scale] * np.uint64(5) + hashes[2 * scale :])
            for contexts, low, high in ((double, 3 * scale // 2, 2 * scale), (triple, 2 * scale + 1, 3 * scale - 1)):
                last, until = 0, 0
                for gap, position in _proposals(contexts, at, low, high).tolist():
                    if gap == last and position < until:
                        continue
                    start, until = _equal_around(words, position, gap)
                    last = gap
                    if until - start >= (REPEATS - 1) * gap and _smallest(words, start, gap):
                        found.append((start, until + gap, gap))
        hashes, scale = double, 2 * scale
    return np.array(sorted(found, key=lambda run: (run[0], run[2])), np.int64).reshape(-1, 3)


def loop_tail(words: np.ndarray, number: int) -> np.ndarray:
    """The words with a loop planted by ``number``, a fixed rule of the contract, in one of ten texts."""
    if number % 10 or not len(words):
        return words
    rest = number // 10
    begin = rest % len(words)
    period = 1 + (len(words) - begin) // (3 + rest % 8)
    return np.concatenate([words[:begin], words[begin + np.arange(len(words) - begin) % period]])


def _texts_with_runs(texts: pa.Array, ids: list, plant: bool) -> Iterator[tuple[list[tuple[int, int, int]], int, bytes]]:
    """Per text its runs (start, length, period), number of words, and collapsed text."""
    offsets, codes, words = words_of(texts)
    if "" in words:
        keep = codes != words.index("")
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes = before[offsets], codes[keep]
    parts = [codes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    planted = [False] * len(parts)
    if plant:
        for i, doc in enumerate(ids):
            if doc is not None:
                looped = loop_tail(parts[i], zlib.crc32(str(doc).encode()))
                parts[i], planted[i] = looped, looped is not parts[i]
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    sizes = np.array([len(parts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    whole = np.empty(int(ends[-1]) + 1, np.int64)
    for i, end, size in zip(order, ends.tolist(), sizes.tolist()):
        whole[end - size : end] = parts[i]
        whole[end] = len(words) + i
    runs: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    found = periodic_runs(whole, ends)
    found = found[found[:, 1] - found[:, 0] >= LEAST_WORDS]
    for text, (start, end, period) in zip(np.searchsorted(ends, found[:, 0]).tolist(), found.tolist()):
        runs[order[text]].append((start - int(ends[text] - sizes[text]), end - start, period))
    raw = texts.cast(pa.binary())
    for i, part in enumerate(parts):
        if runs[i] or planted[i]:
            kept = np.ones(len(part), bool)
            for start, length, period in runs[i]:
                kept[start + period : start + length] = False
            collapsed = " ".join([words[c] for c in part[kept].tolist()]).encode()
        else:
            collapsed = b" ".join(raw[i].as_py().split())
        yield runs[i], len(part), collapsed


def _each(batches: Iterator[pa.RecordBatch], plant: bool):
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            ids = batch.column(0).to_pylist()
            yield batch.column(0), _texts_with_runs(texts_of(batch.column(1)), ids, plant)


def _read(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    small_batches(documents.sparkSession)
    return documents.select(documents[id_column].cast("long").alias("id"), documents[text_column].cast("string").alias("text"))


def collapse_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words long, runs array of (start, length, period), text), one row per document.

    Words are maximal stretches without ASCII white space, numbered from 0.  A run is a stretch
    with smallest period q, of at least 24 words and 3q, that no neighbouring word extends;
    ``text`` is without the words of a run after its first q, joined by single blanks.  A null
    or empty text, or one of white space, has no word, no run and the text "".  Rows are
    independent of each other, so repeated rows and null ids give a row each; an empty table
    gives none, other columns are not read.  A text is taken whole by one task, in memory of
    about 100 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _each(batches, False):
            runs, sizes, texts = zip(*rows)
            named = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(named, kind), pa.array([t.decode() for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "text"])

    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return _read(documents, id_column, text_column).mapInArrow(run, schema).withColumnsRenamed({"id": id_column, "text": text_column})


def _digest(runs: list[tuple[int, int, int]], collapsed: bytes) -> tuple:
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    marks = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()
    best = None
    for start, length, period in runs:  # by start, then period, so a tie leaves the earlier one
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *marks)


DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def run_digest(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = True) -> DataFrame:
    """``collapse_runs`` as counts, the run of greatest exponent and hashes; rows as there.

    ``plant`` first writes a loop into the texts whose id's crc32 ends in 0, as the contract has
    it; a text without an id gets none.  Without a run four columns are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _each(batches, plant):
            found = list(zip(*(_digest(runs, text) for runs, _, text in rows)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(found, kinds))], ["id", *DIGEST])

    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _read(documents, id_column, text_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)
