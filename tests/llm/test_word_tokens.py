"""Tokens of words against the library on random strings, and a mix of awkward tables."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from onsetlens.llm.mix import mix, mixed_documents
from onsetlens.llm.queries import WORD_BPE
from onsetlens.llm.word_ids import word_tokens

LETTERS = "abzABZéÉßİıŞşĞçñÑøÅǅŉſɐλЖж日ﬁ0149.,.,.,'-<>/ṡ́"


def test_random_strings():
    rng = random.Random(8)
    words = ["GELDİ.", "AİB.", "İ,", "x.İ", "İ", "<s>", "</s>.", "a.<pad>,"]
    words += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    wanted = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert word_tokens(WORD_BPE, words, True).tolist() == [len(ids) for ids in wanted]
    flat, starts, lengths = word_tokens(WORD_BPE, words, False)
    assert [flat[s : s + n].tolist() for s, n in zip(starts.tolist(), lengths.tolist())] == wanted


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "a b c d " * (i + 1), "s" if i % 3 else "t", 7, 8, 9, 10) for i in range(12)]
    names = "doc_id long, text string, source string, _mix_taken int, _mix_size int, _mix_id int, _mix_copy int"
    docs = spark.createDataFrame(rows, names)
    found = mixed_documents(docs)
    assert found.columns == docs.columns
    words = found.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n"))
    taken = {r["doc_id"]: r["taken"] for r in mix(docs).collect() if r["taken"]}
    assert {r["doc_id"]: r["n"] for r in words.collect()} == taken
    repeated = spark.createDataFrame([(1, "a b c d e f", "s", 1, 1, 1, 1), (1, "a", "s", 1, 1, 1, 1), (2, "q r", "t", 1, 1, 1, 1)], names)
    assert mixed_documents(repeated).count() >= 1
