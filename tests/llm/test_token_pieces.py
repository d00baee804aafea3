"""How texts are cut before their words are encoded."""

import pyarrow as pa

from onsetlens.llm import token_file
from onsetlens.llm.common import segments


def test_a_usual_batch_of_texts_is_encoded_in_one_piece():
    """A word of 6 MB of texts is looked up once, not once in each 4 MB."""
    texts = pa.array(["Some words of a text. " * 150] * 2000)
    found = list(segments(texts, token_file.ENCODE_TEXT))
    assert [len(rows) for rows, _ in found] == [2000] and sum(map(len, texts.to_pylist())) > 6 << 20
