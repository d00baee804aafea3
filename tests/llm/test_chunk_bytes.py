"""What op8 and op10 hold: words of a chunk squeezed, one Python worker a task for op8."""

import random
import re

import numpy as np
import public_tokenizers

from onsetlens.llm.bpe_table import pack_words, squeezed, unpack_words, unsqueezed
from onsetlens.llm.token_file import encode_documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_squeezed_and_come_back():
    rng = random.Random(1)
    words = [" " + "".join(rng.choice(["th", "en", "on", "é", "ing", "语"]) for _ in range(5)) for _ in range(5_000)] + ["", "\x00", "\n"]
    data, more = pack_words(words)
    assert unpack_words(data, more) == words
    assert len(data) + len(more) < 0.5 * sum(len(w.encode()) for w in words)
    assert unpack_words(*pack_words([])) == [] and unsqueezed(squeezed(b"")) == b""


def test_documents_are_encoded_by_one_python_node(spark):
    docs = spark.createDataFrame([(None, "a"), (-5, "b c"), (3, None), (4, "d"), (9, "")], "doc_id long, text string")
    done = encode_documents(docs, WORD_BPE, 2, [3, 9])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|ArrowEvalPython|BatchEvalPython", plan)) == 1
    found = {r["doc_id"]: r for r in done.collect()}
    assert {d: r["bucket"] for d, r in found.items()} == {None: 0, -5: 0, 3: 1, 4: 1, 9: 2}
    assert np.frombuffer(found[3]["ids"], "<u2").tolist() == np.frombuffer(found[9]["ids"], "<u2").tolist() == [2]
