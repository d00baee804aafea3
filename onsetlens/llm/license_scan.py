"""Licence scans: ordered signature rules behind a keyword gate, overlaps settled by priority."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from onsetlens.llm.common import by_bytes
from onsetlens.llm.license_rules import BASE_RULES, RULES

BASE_RANK = 50
# Lower-cases A-Z; every ASCII byte that is no digit or letter becomes a space.
_FOLD = bytes(
    ord(" ") if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b
    for b in range(256)
)
_SPAN = "array<struct<label: string, base: boolean, priority: int, rule: int, first: bigint, last: bigint>>"


def _kept(found: list[tuple]) -> list[tuple]:
    """Without spans inside the span of a higher priority, or of the same and longer or earlier.

    Base spans stay; spans are (label, base, priority, rule, first, last).
    """
    order = sorted(found, key=lambda s: (-s[2], s[4] - s[5], s[3], s[4]))
    kept: list[tuple] = []
    # Kept spans that lie in no other, by start; so their ends ascend too.
    starts: list[int] = []
    ends: list[int] = []
    for span in order:
        first, last = span[4], span[5]
        at = bisect_right(starts, first)
        inside = at > 0 and ends[at - 1] >= last
        if span[1] or not inside:
            kept.append(span)
        if not inside:
            begin = bisect_left(starts, first)
            until = bisect_right(ends, last, begin)  # these lie inside the new one
            starts[begin:until], ends[begin:until] = [first], [last]
    return sorted(kept, key=lambda s: (s[4], s[5], s[3]))


def _scanner(rules, base_rules):
    gates = {word for _, _, words, _, _ in rules for word in words} | {gate for _, gate, _ in base_rules}
    by_gate: dict[bytes, list] = {}
    for rule in rules:
        for word in rule[2]:
            by_gate.setdefault(word, []).append(rule)

    def scan(text: bytes) -> tuple[int, list[tuple]]:
        words = text.translate(_FOLD).split(b" ")
        words = [w for w in words if w] if b"" in words else words
        present = gates.intersection(words)
        if not present:
            return len(words), []
        line = b" ".join(words)
        found = []

        def add(label, base, rank, rule, pattern: re.Pattern):
            at, word = 0, 0
            for match in pattern.finditer(line):
                word += line.count(b" ", at, match.start())
                at = match.start()
                found.append((label, base, rank, rule, word, word + match.group().count(b" ")))

        for label, gate, pattern in base_rules:
            if gate in present:
                add(label, True, BASE_RANK, -1, pattern)
        for gate in present:
            for label, rank, any_of, pattern, number in by_gate.get(gate, ()):
                # A text may hold several words of a rule; the first of them tries it.
                if len(any_of) == 1 or gate == next(w for w in any_of if w in present):
                    add(label, False, rank, number, pattern)
        return len(words), _kept(found)

    return scan


def scan_licenses(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules=None) -> DataFrame:
    """(id, n_words long, spans): the licences that each whole text names or quotes.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and characters beyond ASCII.
    ``spans`` are (label, base, priority, rule, first, last) by first word, from 0.  Rules are
    tried only where one of their gate words occurs; of overlapping spans one inside another of higher
    priority (or the same priority, and longer or earlier in the order) is suppressed.  The base
    phrases are counted at every place and never suppressed.  A null text is an empty one: no
    words, no spans.  One row per row, repeated ids too; other columns are not read.
    """
    id_type = documents.schema[id_column].dataType.simpleString()
    scan = _scanner(RULES if rules is None else rules, BASE_RULES)
    names = ("label", "base", "priority", "rule", "first", "last")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                found = [scan(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                spans = [[dict(zip(names, s)) for s in spans] for _, spans in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(spans, kind)], ["id", "n_words", "spans"]
                )

    kept = documents.select(documents[id_column].alias("id"), documents[text_column].cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {id_type}, n_words long, spans {_SPAN}").withColumnRenamed("id", id_column)


def license_digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of ``scan_licenses``.

    ``score`` is the highest priority of a kept span over 100, 0 without spans.
    """
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    firsts = F.transform(base, lambda s: s["first"])
    return scanned.select(
        id_column,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["priority"] / 100.0)), F.lit(0.0)).alias("score"),
    )
