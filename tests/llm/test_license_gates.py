"""Licence rules behind their gates against the same rules on every text, on texts made from their patterns."""

import itertools
from re import _constants as kinds, _parser

import pytest

from onsetlens.llm.license_rules import RULES
from onsetlens.llm.license_scan import _scanner, license_digest, scan_licenses


def matches(parsed):
    """Texts that a parsed pattern matches: each branch and member, repeats at least and once more."""
    parts = []
    for kind, value in parsed:
        if kind is kinds.LITERAL:
            parts.append([chr(value)])
        elif kind is kinds.ANY or kind is kinds.NOT_LITERAL:
            parts.append(["x"])
        elif kind is kinds.IN:
            named = [chr(v) for k, v in value if k is kinds.LITERAL]
            parts.append(["x"] if value[0][0] is kinds.NEGATE else named or ["7"])
        elif kind is kinds.BRANCH:
            parts.append([t for branch in value[1] for t in matches(branch)])
        elif kind is kinds.SUBPATTERN:
            parts.append(matches(value[3]))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, inner = value
            one = matches(inner)
            parts.append([t * low for t in one][: len(one) if low else 1] + [t * (low + 1) for t in one if low < high])
        else:
            assert kind in (kinds.ASSERT, kinds.ASSERT_NOT)
    return ["".join(p) for p in itertools.product(*parts)]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r[4]}-{r[0]}")
def test_every_match_passes_the_gate(rule):
    label, rank, _, pattern, number = rule
    texts = matches(_parser.parse(pattern.pattern.decode()))
    assert texts
    gated, free = _scanner([rule], []), _scanner([(label, rank, tuple(w for t in texts for w in t.encode().split()), pattern, number)], [])
    for text in texts:
        assert pattern.fullmatch(text.encode()), text
        assert gated(text.encode()) == free(text.encode()), text
        assert gated(text.encode())[1], text


def test_lost_labels(spark):
    texts = {"gpl-2.0": "under GPLv2.", "gpl-3.0": "GPLv3", "bsl-1.0": "(BSL-1.0)", "python-2.0": "Python-2.0"}
    found = license_digest(scan_licenses(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string"))).collect()
    assert {i: r["labels"] for i, r in enumerate(sorted(found, key=lambda r: r["doc_id"]))} == dict(enumerate(texts))


def test_ids_of_one_word(spark):
    texts = {"bsd-zero": "License: 0BSD", "wtfpl": "(WTFPL)", "unlicense": "Unlicense"}
    found = license_digest(scan_licenses(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string"))).collect()
    assert {i: r["labels"] for i, r in enumerate(sorted(found, key=lambda r: r["doc_id"]))} == dict(enumerate(texts))
