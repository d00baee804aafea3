"""Every other operator against brute force or its library, with awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from onsetlens.llm.bpe_table import encode_decode, encoded_digest
from onsetlens.llm.fingerprint import fingerprint_documents
from onsetlens.llm.language_id import language_id
from onsetlens.llm.license_scan import license_digest, scan_licenses
from onsetlens.llm.mix import mix
from onsetlens.llm.near_dup import near_duplicates
from onsetlens.llm.queries import BYTE_BPE, WORD_BPE
from onsetlens.llm.token_count import token_counts
from onsetlens.llm.token_file import token_file
from onsetlens.llm.topk import top_k

SCHEMA = "doc_id long, text string, lang string, source string, id int, ids string, size string"


@pytest.fixture(scope="module")
def rows():
    words = [f"word{i} é{i}" for i in range(300)]
    near = " ".join(words)
    texts = [near, near + " tail", near, "", None, "one two", "One  two", "   ", "x" * 5000, "<|endoftext|> a</s>b\r\n\t 12'll", "日本語 текст 🙂"]
    texts += ["released under CC BY and CC-BY-SA; all rights reserved. General Public License", " ".join(words[:150])]
    return [(i, t, "en", ["s", None, "t"][i % 3], 1, "q", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = {i: [float(x) for x in rng.normal(size=8)] for i in range(300)}
    vectors[7] = vectors[50]
    rows = [*vectors.items(), (500, None), (501, [float("nan")] * 8), (550, [None] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(table, table.where("vec_id % 50 = 0"), k=5, scale=256).select("query_id", "rank", "vec_id", "score").collect()
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in vectors.items()}
    expected = []
    for q in range(0, 300, 50):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == expected


def test_near_duplicates(docs, rows, empty):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    found = near_duplicates(docs).collect()
    assert {tuple(r) for r in found} == {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert near_duplicates(empty).collect() == []


def test_fingerprints(docs, rows, empty):
    found = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for i, text in enumerate(texts):
        cut, following = len(text) // 4, texts[(i + 1) % len(texts)]
        edited = text[: len(text) - cut] + following[:cut]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    assert found[0]["fingerprint"] == found[2]["fingerprint"] != found[1]["fingerprint"]
    assert fingerprint_documents(empty).collect() == []


def test_mix(docs, empty):
    found = mix(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in mix(docs).collect()} == {r["doc_id"]: r["taken"] for r in found}
    by = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in found)
    assert abs(sum(g[0]["target"] for g in by.values()) - total) < 1e-6
    for group in by.values():
        assert sum(r["taken"] for r in group) == int(group[0]["target"] + 1e-9)
        assert group[0]["source_size"] == sum(r["size"] for r in group)
    assert mix(empty).collect() == []


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_token_counts_and_file(docs, rows, empty):
    tokenizer = library(WORD_BPE)
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    counted = {r["doc_id"]: r for r in token_counts(docs, WORD_BPE).collect()}
    written = {r["doc_id"]: r for r in token_file(docs, WORD_BPE, end_id=2).collect()}
    start = 0
    for i, text in enumerate(r[1] or "" for r in rows):
        assert (counted[i]["n_bytes"], counted[i]["n_tokens"]) == (len(text.encode()), len(ids[i]))
        assert counted[i]["over_limit"] == (len(ids[i]) > 2048)
        whole = np.array([*ids[i], 2], "<u4")
        assert (written[i]["start"], written[i]["n_tokens"]) == (start, len(whole))
        assert written[i]["ids_crc32"] == zlib.crc32(whole.tobytes())
        start += len(whole)
    assert token_counts(empty, WORD_BPE).collect() == [] and token_file(empty, WORD_BPE, end_id=2).collect() == []


def test_encode_decode(docs, rows, empty):
    tokenizer = library(BYTE_BPE)
    found = {r["doc_id"]: r for r in encoded_digest(encode_decode(docs, BYTE_BPE)).collect()}
    for i, text in enumerate(r[1] or "" for r in rows):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert found[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(empty, BYTE_BPE).collect() == []


def test_licenses(docs, rows, empty):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = {r["doc_id"]: r for r in license_digest(scan_licenses(docs)).collect()}
    for i, text in enumerate(r[1] or "" for r in rows):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hits = [(at, label) for p, label in phrases.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        assert (found[i]["n_words"], found[i]["n_base"]) == (len(words), len(hits))
        assert found[i]["base_labels"] == ",".join(sorted({label for _, label in hits}))
        assert found[i]["first_word"] == min((a for a, _ in hits), default=None)
        assert set(found[i]["base_labels"].split(",")) <= set(found[i]["labels"].split(",")) or not hits
    assert license_digest(scan_licenses(empty)).collect() == []


def test_language_id(spark, small, docs, empty):
    found = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert [found[i]["lang_pred"] for i in (3, 4, 7)] == ["und"] * 3
    assert language_id(empty).collect() == []
    table = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    judged = language_id(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.9
