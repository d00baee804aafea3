"""Selects of a token file against decoding all values."""

import numpy as np

from onsetlens.llm.elias_fano import EliasFano
from onsetlens.llm.token_file import document_ids


def test_select_equals_values_and_gives_the_ids_of_a_document():
    rng = np.random.default_rng(5)
    ends = np.cumsum(rng.integers(0, 9, 2_000) * rng.integers(1, 200, 2_000)).astype(np.int64)
    packed = EliasFano.of(ends)
    stored = EliasFano.from_bytes(packed.to_bytes())
    assert [stored.select(i) for i in range(len(ends))] == stored.values().tolist() == ends.tolist()
    ids = rng.integers(0, 60_000, int(ends[-1])).astype("<u2")
    segment = {"ends": packed.to_bytes(), "ids": ids.tobytes(), "id_bytes": 2}
    for number in (0, 1, 2, 511, 512, 1_024, 1_999):
        begin = ends[number - 1] if number else 0
        assert document_ids(segment, number).tolist() == ids[begin : ends[number]].tolist()
