"""Byte-level BPE through a table of distinct words.

Texts are split into words in chunks of documents; a chunk keeps its distinct words and, by
position, the number of each word.  Words of all chunks meet by hash, each distinct word is
encoded once, and its ids go back to the chunks that hold it, where they are joined by position.
Ids become text again through a table of one piece of bytes per id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from onsetlens.llm.common import by_bytes, partitions, ragged_take, texts_of, worker_state, small_batches
from onsetlens.llm.word_ids import encode_batches, load_tokenizer
from onsetlens.session import materialise

CHUNK_BYTES = 24 << 20  # text of a chunk, but for a single longer text
OUT_BYTES = 4 << 20  # text that a chunk hands on at once
SQUEEZE = 9  # level of compression
KNOWN_WORDS = 400_000  # words whose ids a task keeps while it encodes a bucket

# White space of Unicode, and the letters of which the quick pattern is sure.
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"

# Words of a text of ASCII and Latin letters: what the tokenizer itself splits into.
_QUICK = re.compile(
    rf" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_NOT_QUICK = re.compile(rf"[^\x00-\x7f{_LETTER}]")
# Words of any text: runs without white space and the space before, which hold whole splits.
_PLAIN = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def splitter(specials: list[str]):
    """A function from a text to words whose tokens, one after the other, are the tokens of the text.

    A special string is a word of its own; no word reaches across one.
    """
    apart = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

    def split(text: str) -> list[str]:
        words = (_PLAIN if _NOT_QUICK.search(text) else _QUICK).findall
        if apart is None or not any(s in text for s in specials):
            return words(text)
        return [w for i, part in enumerate(apart.split(text)) for w in ([part] if i % 2 else words(part))]

    return split


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in 7 bits a byte, low bits first; the high bit says that more follow."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        over = values >= np.uint64(1 << bits)
        if not over.any():
            break
        sizes += over
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - sizes
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        more = (sizes[has] > i + 1).astype(np.uint8) << 7
        out[begins[has] + i] = ((values[has] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    out = np.zeros(len(ends), np.int64)
    for i in range(int(sizes.max())):
        has = sizes > i
        out[has] |= (raw[begins[has] + i] & 127).astype(np.int64) << (7 * i)
    return out


def squeezed(data: bytes) -> bytes:
    """``data`` compressed for tables and shuffles, after its length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", SQUEEZE).compress(data, asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """The characters of words, one after the other, and their lengths in bytes, both squeezed."""
    held = [w.encode() for w in words]
    return squeezed(b"".join(held)), squeezed(pack_numbers(np.fromiter(map(len, held), np.int64, len(held))))


def unpack_words(data: bytes, more: bytes) -> list[str]:
    ends = np.cumsum(unpack_numbers(unsqueezed(more)))
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(unsqueezed(data))]
    return pa.LargeStringArray.from_buffers(len(ends), buffers[1], buffers[2]).to_pylist()


_CHUNK = "chunk string, bucket int, n_words long, docs array<long>, data binary, more binary"


def _chunks(tokenizer: str, buckets: int, chunk_bytes: int):
    """(id, text) to chunk rows: bucket -1 has the documents, the others the distinct words by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter([t.content for t in load_tokenizer(tokenizer).get_added_tokens_decoder().values()])
        docs: list = []
        counts: list[int] = []
        number: dict[str, int] = {}
        codes: list[np.ndarray] = []
        size = 0

        def rows():
            words = list(number)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            often = np.bincount(flat, minlength=len(words))
            order = np.argsort(-often, kind="stable")  # short numbers for frequent words
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words = [words[i] for i in order]
            home = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
            data = pack_numbers(rank[flat])
            mark = xxhash.xxh3_128(data)
            for d in docs:
                mark.update(f"{d},")
            for w in words:
                mark.update(w)
            chunk = mark.hexdigest()
            yield chunk, -1, len(words), docs, squeezed(data), squeezed(pack_numbers(np.concatenate([np.array(counts, np.int64), home])))
            by_home = np.argsort(home, kind="stable")
            for part in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1):
                if len(part):
                    yield chunk, int(home[part[0]]), len(part), None, *pack_words([words[i] for i in part])

        def batch_of(found):
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            return pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in _CHUNK.split(", ")])

        for whole in batches:
            for batch in by_bytes(whole, "text"):
                ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
                if docs and size + texts.nbytes > chunk_bytes:
                    yield batch_of(rows())
                    docs, counts, number, codes, size = [], [], {}, [], 0
                for doc_id, text in zip(ids, texts.to_pylist()):
                    words = split(text)
                    codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                    docs.append(doc_id)
                    counts.append(len(words))
                size += texts.nbytes
        if docs:
            yield batch_of(rows())

    return run


def _encode_words(tokenizer: str):
    """Word rows, a bucket after the other, to (chunk, bucket, ids of the words and their numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load_tokenizer(tokenizer)
        # first: how many ids each word has; second: the ids
        known: dict[str, bytes] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                words = unpack_words(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                missing = [w for w in words if w not in known]
                if len(known) + len(missing) > KNOWN_WORDS:
                    known, missing = {}, words
                known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(missing, encode_batches(library, missing)))
                runs = [known[w] for w in words]
                lengths = np.array([len(r) // 4 for r in runs], np.int64)
                ids = np.frombuffer(b"".join(runs), "<u4")
                wide = ids.max(initial=0) >= 1 << 16
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1),
                        batch.column(1).slice(i, 1),
                        pa.array([squeezed(pack_numbers(lengths))], pa.binary()),
                        pa.array([squeezed(ids.astype("<u4" if wide else "<u2").tobytes())], pa.binary()),
                        pa.array([4 if wide else 2], pa.int32()),
                    ],
                    ["chunk", "bucket", "first", "second", "width"],
                )

    return run


def pieces(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of ids: (bytes, first byte of each id, number of bytes of each id).

    A byte-level vocabulary writes each byte as one printable character: itself, or for the
    others the next character from U+0100 on.  Special tokens stand for their own text.
    """
    held = worker_state("pieces")
    if tokenizer not in held:
        library = load_tokenizer(tokenizer)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
        table = [b""] * (max(library.get_vocab(True).values()) + 1)
        for token, i in library.get_vocab(True).items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        sizes = np.array([len(t) for t in table], np.int64)
        held[tokenizer] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes
    return held[tokenizer]


def decode_ids(tokenizer: str, ids: np.ndarray) -> str:
    """Text of ids: their pieces side by side; bytes that are no UTF-8 become U+FFFD."""
    return ragged_take(*pieces(tokenizer), ids).tobytes().decode("utf-8", "replace")


_RESULT = "doc_id long, ids binary, decoded string"


def _join_back(tokenizer: str):
    """Rows by chunk, the ids of its words before its documents, to (id, ids, decoded text)."""

    def documents_of(chunk: dict, encoded: dict[int, dict]) -> Iterator[pa.RecordBatch]:
        flat, more = unpack_numbers(unsqueezed(chunk["first"])), unpack_numbers(unsqueezed(chunk["second"]))
        counts, home = more[: len(chunk["docs"])], more[len(chunk["docs"]) :]
        lengths, starts, parts, done = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64), [], 0
        for bucket, row in encoded.items():
            at = np.flatnonzero(home == bucket)
            lengths[at] = unpack_numbers(unsqueezed(row["first"]))
            starts[at] = done + np.cumsum(lengths[at]) - lengths[at]
            parts.append(np.frombuffer(unsqueezed(row["second"]), f"<u{row['width']}").astype(np.uint32))
            done += len(parts[-1])
        word_ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        table = pieces(tokenizer)
        doc_ids, ids, texts, size, first = [], [], [], 0, 0
        for number, (doc_id, end) in enumerate(zip(chunk["docs"], np.cumsum(counts).tolist())):
            found = ragged_take(word_ids, starts, lengths, flat[first:end])
            first = end
            doc_ids.append(doc_id)
            ids.append(found.astype("<u4").tobytes())
            texts.append(ragged_take(*table, found).tobytes().decode("utf-8", "replace"))
            size += len(ids[-1]) + len(texts[-1])
            if size > OUT_BYTES or number == len(counts) - 1:
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])
                doc_ids, ids, texts, size = [], [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, encoded = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["chunk"] != chunk:
                    chunk, encoded = row["chunk"], {}
                if row["bucket"] >= 0:
                    encoded[row["bucket"]] = row
                else:  # equal chunks, of repeated rows, have one name and equal words
                    yield from documents_of(row, encoded)

    return run


def encode_decode(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids binary, decoded string): ids of every whole text, 32 bits each, and their text.

    ``tokenizer`` is the path of a byte-level BPE of the tokenizers library, used without added
    special tokens, truncation and padding; its special strings inside a text are its special
    tokens, and are kept when decoding.  A null text is an empty one.  One row per row, repeated
    and null ids too; an empty table gives none; other columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    buckets = 2 * partitions(spark)
    kept = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    # Written once: a chunk has to be the same for its documents and for its words.
    table = materialise(kept.mapInArrow(_chunks(tokenizer, buckets, chunk_bytes), _CHUNK), "chunks", compression="zstd")
    words = table.where("bucket >= 0").select("chunk", "bucket", "data", "more").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(_encode_words(tokenizer), "chunk string, bucket int, first binary, second binary, width int")
    chunks = table.where("bucket < 0").select(
        "chunk", "bucket", F.col("data").alias("first"), F.col("more").alias("second"), F.lit(0).alias("width"), "docs"
    )
    met = encoded.withColumn("docs", F.lit(None).cast("array<bigint>")).unionByName(chunks)
    dealt = met.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", F.desc("bucket"))
    return dealt.mapInArrow(_join_back(tokenizer), _RESULT)


def encoded_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``."""
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

