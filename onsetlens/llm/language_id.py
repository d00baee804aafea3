"""Language ID: a small convolutional network over bytes, trained in numpy, applied to windows.

Filters of several widths run over the bytes of a window; their maxima go through one softmax
layer.  A text is the mean of the log probabilities of its windows, which cover all its bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from onsetlens.llm.common import by_bytes, byte_offsets, fresh, texts_of, worker_state

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1  # so that every run of the widest filter lies in a window
FILTERS = 16  # of each width
SAMPLE_ROWS = 4096  # labelled documents that training may read
SAMPLE_WINDOWS = 2  # windows of each
EPOCHS, BATCH, RATE = 6, 64, 0.01
LEAST_STEPS = 140  # a small sample is gone through more often
UNKNOWN = "und"
MIN_SCORE = 0.4  # a stage that filters by language rejects less certain documents
_AT_ONCE = 256  # windows


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray  # (widths x FILTERS, languages)
    offset: np.ndarray
    version: str = ""


def _maxima(windows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each window, and where it is."""
    width = len(table)
    last = windows.shape[1] - width + 1
    response = table[0][windows[:, :last]]
    for j in range(1, width):
        response += table[j][windows[:, j : j + last]]
    at = response.argmax(axis=1)
    return np.take_along_axis(response, at[:, None, :], 1)[:, 0, :], at


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Model:
    """Adam on the cross entropy; ``windows`` uint8 (n, WINDOW), ``labels`` numbers of languages."""
    rng = np.random.default_rng(seed)
    n_classes = len(languages)
    weights = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights += [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_classes)).astype(np.float32), np.zeros(n_classes, np.float32)]
    k = len(WIDTHS)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(windows) // BATCH)))):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            x, y = windows[part], labels[part]
            found = [_maxima(x, weights[j]) for j in range(k)]
            raw = [m + weights[k + j] for j, (m, _) in enumerate(found)]
            pooled = np.concatenate([np.maximum(r, 0) for r in raw], axis=1)
            logits = pooled @ weights[-2] + weights[-1]
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(y)), y] -= 1
            share /= len(y)
            slopes = [np.zeros_like(w) for w in weights]
            slopes[-2], slopes[-1] = pooled.T @ share, share.sum(axis=0)
            back = (share @ weights[-2].T).reshape(len(y), k, FILTERS)
            for j, (_, at) in enumerate(found):
                g = np.where(raw[j] > 0, back[:, j], 0)
                slopes[k + j] = g.sum(axis=0)
                column = np.broadcast_to(np.arange(FILTERS), at.shape)
                for d in range(WIDTHS[j]):
                    np.add.at(slopes[j][d], (np.take_along_axis(x, at + d, 1), column), g)
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    version = f"{float(sum(np.abs(w).sum() for w in weights)):.9g}-{languages}"
    return Model(languages, weights[:k], weights[k : 2 * k], weights[-2], weights[-1], version)


def as_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of windows, owners): windows of all bytes between neighbouring offsets."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[owner] + number * STRIDE, owner


class Predictor:
    """Windows to log probabilities, by tables of byte pairs."""

    def __init__(self, model: Model):
        self.model = model

        def pair(table, j):
            return (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1)

        # A filter of width w is a sum over its byte pairs and, for odd w, its last byte.
        self.pairs = [[pair(t, j) for j in range(0, len(t) - 1, 2)] for t in model.tables]

    def log_shares(self, windows: np.ndarray) -> np.ndarray:
        model, pooled = self.model, []
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        for table, pairs, bias in zip(model.tables, self.pairs, model.biases):
            last = windows.shape[1] - len(table) + 1
            response = np.take(pairs[0], pair[:, :last], axis=0)
            for i in range(1, len(pairs)):
                response += np.take(pairs[i], pair[:, 2 * i : 2 * i + last], axis=0)
            if len(table) % 2:
                response += np.take(table[-1], windows[:, len(table) - 1 :], axis=0)
            pooled.append(np.maximum(response.max(axis=1) + bias, 0))
        logits = np.concatenate(pooled, axis=1) @ model.dense + model.offset
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the best language, its share) of each text."""
        offsets = byte_offsets(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins, owner = as_windows(data, offsets)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        total = np.zeros((len(texts), len(self.model.languages)))
        for i in range(0, len(begins), _AT_ONCE):
            begin, who = begins[i : i + _AT_ONCE], owner[i : i + _AT_ONCE]
            at = begin[:, None] + np.arange(WINDOW)
            windows = np.where(at < offsets[who + 1][:, None], padded[at], np.uint8(0))
            np.add.at(total, who, self.log_shares(windows))
        total /= np.bincount(owner, minlength=len(texts))[:, None]
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best]


def _has_letter(texts: pa.Array) -> np.ndarray:
    offsets = byte_offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    running = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = running[offsets[1:]] > running[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(unicodedata.category(c)[0] == "L" for c in texts[i].as_py())
    return found


def held_out(id_column) -> F.Column:
    """crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``sample_rows`` labelled documents that are not held out, or None.

    The sample is by a hash of the id, the same in every run; each document gives SAMPLE_WINDOWS
    windows at hashed places.  Rows with null id, text or lang are not used; of a repeated id one
    row is.  None if nothing labelled is left.
    """
    known = documents.select(
        documents[id_column].alias("id"), documents[lang_column].cast("string").alias("lang"), documents[text_column].cast("string").alias("text")
    ).where(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull())
    total = known.select("id").count()
    if not total:
        return None
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    few = known.where(F.col("text").isNotNull() & (place < min(1.0, 1.5 * sample_rows / total)))
    letters = F.length("text")
    cuts = [
        F.substring("text", (F.pmod(F.xxhash64("id", F.lit(i)), F.greatest(F.lit(1), letters - WINDOW)) + 1).cast("int"), F.lit(WINDOW))
        for i in range(SAMPLE_WINDOWS)
    ]
    rows = few.groupBy("id").agg(F.min(F.struct("lang", *[c.alias(f"w{i}") for i, c in enumerate(cuts)])).alias("r"))
    rows = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample_rows).select("r.*").collect()  # bounded
    languages = sorted({r["lang"] for r in rows})
    windows, labels = [], []
    for r in rows:
        for i in range(SAMPLE_WINDOWS):
            data = r[f"w{i}"].encode()[:WINDOW]
            windows.append(np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8))
            labels.append(languages.index(r["lang"]))
    return train(np.array(windows), np.array(labels), languages) if windows else None


def predict(documents: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``documents`` with (lang_pred string, score double) of every whole text.

    ``und`` with score 0 if the text is null or has no letter, or if there is no model.  All
    columns are kept; a column named lang_pred or score is replaced.
    """
    languages = np.array([*(model.languages if model else []), UNKNOWN], object)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def classify(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
        if model:
            held = worker_state("language models")
            if model.version not in held:
                held.clear()
                held[model.version] = Predictor(model)
            at = 0
            for part in by_bytes(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
                number, share = held[model.version].texts(part.column(0))
                some = _has_letter(part.column(0))
                best[at : at + len(some)] = np.where(some, number, len(languages) - 1)
                score[at : at + len(some)] = np.where(some, share, 0.0)
                at += len(some)
        return pa.StructArray.from_arrays([pa.array(languages[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    found = fresh(documents, "_lang")
    rest = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    return documents.withColumn(found, classify(documents[text_column].cast("string"))).select(*rest, f"{found}.lang_pred", f"{found}.score")


def language_id(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text; fitted on rows that are not held out.

    lang, source and id are no inputs of a prediction.  Repeated rows give repeated results, an
    empty table gives none; other columns are not read.
    """
    model = fit(documents, id_column, text_column, lang_column)
    kept = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    found = predict(kept, model).select("id", held_out("id").alias("held_out"), "lang_pred", "score")
    return found.withColumnRenamed("id", id_column)


def with_known_language(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose predicted language is known with at least ``min_score``; same columns.

    Where no row can train a model nothing is predicted, and all texts that hold a letter stay.
    """
    model = fit(documents)
    if model is None:
        return documents.where(documents["text"].cast("string").rlike(r"\p{L}"))
    copy = fresh(documents, "_text")
    found = predict(documents.select(F.struct(*documents.columns).alias("row"), documents["text"].alias(copy)), model, copy)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
