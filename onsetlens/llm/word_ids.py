"""Tokens of whole texts by a tokenizer whose tokens never span ASCII white space.

Words between white space are encoded by the library, each distinct word of a batch at most
once, in batches balanced by bytes.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from onsetlens.llm.common import worker_state

CACHED_WORDS = 600_000  # words a worker keeps, in two generations; the older one is forgotten in turn
ENCODE_BYTES = 1 << 16  # text per call of the library


def load_tokenizer(path: str):
    """The library's tokenizer without truncation and padding, loaded once per worker."""
    held = worker_state("tokenizers")
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held[path] = Tokenizer.from_file(path)
        held[path].no_truncation()
        held[path].no_padding()
    return held[path]


def encode_batches(tokenizer, texts: list[str]):
    """Encodings of ``texts``, given to the library in batches of about ENCODE_BYTES."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, (int(ends[first - 1]) if first else 0) + ENCODE_BYTES)) + 1
        yield from tokenizer.encode_batch_fast(texts[first:last], add_special_tokens=False)
        first = last


def _parts(words: list[str]) -> tuple[list[str], dict[int, str]]:
    """The words as strings with the same tokens that are seen more often, and what is cut off some.

    The tokenizer lower-cases, so an ASCII word may be lower-cased before; a token ends where
    letters meet a full stop or comma.  A word that may hold a special string stays as it is,
    and so does one whose last letter lower-cases to a letter and a mark, which joins the stop.
    """
    cores = [w.lower() if w.isascii() and "<" not in w else w for w in words]
    stops = {}
    for i in [i for i, w in enumerate(cores) if w[-1:] in (".", ",")]:
        word = cores[i]
        core = word.rstrip(".,")
        if core and "<" not in word and core[-1].isalpha() and core[-1] < "ɐ" and len(core[-1].lower()) == 1:
            cores[i], stops[i] = core, word[len(core) :]
    return cores, stops


def word_tokens(path: str, words: list[str], lengths_only: bool):
    """Numbers of tokens of the words (int64), or their ids as (flat, starts, lengths)."""
    generations = worker_state(f"words {path} {lengths_only}")
    kept = generations.setdefault("now", {})
    cores, stops = _parts(words)
    wanted = {*cores, *stops.values()}
    older = generations.get("older", {})
    missing = wanted - kept.keys()
    known = missing & older.keys()
    kept.update((word, older[word]) for word in known)
    if len(kept) > CACHED_WORDS // 2:  # words not seen since the last turn are forgotten
        generations["older"] = kept
        kept = generations["now"] = {word: kept[word] for word in wanted if word in kept}
    missing = list(missing - known)
    found = encode_batches(load_tokenizer(path), missing)
    if lengths_only:
        kept.update(zip(missing, map(len, found)))
        sizes = np.fromiter(map(kept.__getitem__, cores), np.int64, len(cores))
        sizes[list(stops)] += np.array([kept[stop] for stop in stops.values()], np.int64)
        return sizes
    kept.update((word, array("I", e.ids).tobytes()) for word, e in zip(missing, found))
    runs = list(map(kept.__getitem__, cores))
    for i, stop in stops.items():
        runs[i] += kept[stop]
    lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
    return np.frombuffer(b"".join(runs), np.uint32), np.cumsum(lengths) - lengths, lengths
