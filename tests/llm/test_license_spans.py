"""Containment of spans against comparing all of them, and many spans in little time."""

import random
import time

from onsetlens.llm.license_scan import _kept


def slow(found):
    kept = []
    for span in sorted(found, key=lambda s: (-s[2], s[4] - s[5], s[3], s[4])):
        if span[1] or not any(k[4] <= span[4] and span[5] <= k[5] for k in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: (s[4], s[5], s[3]))


def spans(rng, many, width, length):
    out = []
    for _ in range(many):
        first = rng.randrange(width)
        out.append(("l", rng.random() < 0.1, rng.randrange(4), rng.randrange(9), first, first + rng.randrange(length)))
    return out


def test_kept_spans():
    rng = random.Random(6)
    for many, width, length in ((0, 1, 1), (5, 4, 3), (40, 12, 6), (200, 60, 20), (300, 2000, 5)):
        for _ in range(200):
            found = spans(rng, many, width, length)
            assert _kept(found) == slow(found)


def test_many_spans():
    found = spans(random.Random(7), 200_000, 10_000_000, 4)
    begin = time.time()
    assert len(_kept(found)) > 100_000
    assert time.time() - begin < 60
