"""Mixing sources to target weights by exponential keys (Efraimidis-Spirakis).

Every document gets a key -ln(u) / weight, u a hash of its id.  A source whose target is above
its size is taken in whole epochs first; the rest of its target goes along ascending keys until
the words are spent, the document at the border in part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from onsetlens.llm.common import by_bytes, byte_offsets, fresh, small_batches, texts_of
from onsetlens.session import materialise

CAP = 3  # a target is at most so many times the size of its source
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
SLICES = 4096  # ranges of u; a source is prefix-summed range by range, never in one group

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTER_BYTE[0xC3:] = True  # first bytes of characters beyond ASCII, from U+00C0 on
# Types as objects: the module is imported before there is a session.
_SIZES = StructType().add("size", LongType()).add("letters", LongType()).add("chars", LongType())


def _sizes_of(texts: pa.Array) -> pa.Array:
    offsets = byte_offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _WORD_BYTE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = inside[first]

    def count(marks):
        running = np.concatenate([np.zeros(1, np.int64), np.cumsum(marks, dtype=np.int64)])
        return pa.array(running[offsets[1:]] - running[offsets[:-1]])

    return pa.StructArray.from_arrays(
        [count(starts), count(_LETTER_BYTE[data]), count((data & 0xC0) != 0x80)], ["size", "letters", "chars"]
    )


@F.arrow_udf(_SIZES)
def text_size(texts: pa.Array) -> pa.Array:
    """Words between ASCII white space, letters and code points of each text (null: 0)."""
    texts = texts_of(texts)
    parts = [_sizes_of(b.column(0)) for b in by_bytes(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
    return pa.concat_arrays(parts) if parts else _sizes_of(texts)


def quality(letters, chars):
    """Weight of a text: its share of letters, at least 0.05; 1 for an empty text."""
    return F.when(chars > 0, F.greatest(F.lit(0.05), letters / chars)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, excess reshared.

    ``sizes`` is a written table with one row per source.  Sources stand in code point order,
    null last.  Each round fixes the sources whose share exceeds ``cap`` sizes at the cap and
    shares what is left among the others; one row of sums returns to the driver per round.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    # One row per source, without any document: the only window without a key in this module.
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    listed = materialise(listed.select("source", "source_size", F.col("weight").cast("long").alias("weight")), "sources")
    total = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, fixed = 0.0, -1
    while True:
        free = F.col("weight") * F.lit(level) <= F.col("source_size") * cap
        row = listed.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"),
            F.sum(F.when(~free, F.col("source_size") * cap)).alias("spent"),
            F.count(F.when(~free, 1)).alias("fixed"),
        ).first()
        if row["fixed"] == fixed or not row["w"]:
            break
        fixed, level = row["fixed"], (total - (row["spent"] or 0)) / row["w"]
    capped = F.col("weight") * F.lit(level) > F.col("source_size") * cap
    share = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return listed.select("source", "source_size", share.alias("target"))


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = 1,
    weight=None,
) -> DataFrame:
    """(id, source, size, source_size long, target double, taken long), one row per document.

    ``size`` is the number of words between ASCII white space (null text: 0).  A source takes
    floor(target / source_size) whole epochs of all its documents, and the remaining words along
    ascending keys -ln(u) / weight; the last document is taken in part, so a source takes exactly
    floor(target) words and no document more than ``cap`` times its size.  ``weight`` is a Column
    over ``letters`` and ``chars`` of the text, ``quality`` by default.  u is a hash of the id, so
    reruns agree; rows of equal ids and keys stand in order of their size, and equal rows share
    what they take in an order that does not show.  A null source is a source of its own, the
    last.  Sources without words have target 0.  An empty table gives an empty result.  Other
    columns are neither read nor returned.
    """
    small_batches(documents.sparkSession)
    kept = documents.select(
        documents[id_column].alias("id"), documents[source_column].alias("source"), text_size(documents[text_column].cast("string")).alias("t")
    )
    weight = quality(F.col("letters"), F.col("chars")) if weight is None else weight
    u = (F.expr(f"conv(substring(md5(concat('{int(seed)}:', coalesce(cast(id AS string), 'null'))), 1, 12), 16, 10)").cast("double") + 0.5) / float(1 << 48)
    keyed = kept.select("id", "source", "t.size", "t.letters", "t.chars").select(
        "id", "source", "size", (-F.log(u) / weight).alias("key")
    )
    rows = materialise(keyed, "mix")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = source_targets(sizes, weights, cap)
    # 1 - exp(-key) ascends with the key and is spread over (0, 1) whatever the source.
    sliced = rows.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col("key"))) * SLICES)).cast("int"))
    counted = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = counted.select(
        F.col("source").alias("s"),
        F.col("slice").alias("r"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")).alias("before"),
    ).join(targets.withColumnRenamed("source", "s2"), F.expr("s <=> s2")).drop("s2")
    running = F.sum("size").over(
        Window.partitionBy("source", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = sliced.withColumn("within", running - F.col("size"))
    met = placed.join(before, F.expr("source <=> s AND slice = r"), "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    left = rest - F.col("before") - F.col("within")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return met.select(
        F.col("id").alias(id_column), "source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def mixed_documents(documents: DataFrame, sf_dir: str | None = None, text_column: str = "text", **settings) -> DataFrame:
    """``documents`` as the mix holds them: a row per copy, the last copy cut to the words taken.

    Every column is kept, whatever its name; ``text`` of a copy in part ends after the last word
    taken.  Rows of a repeated id are each given what the one of them takes that takes most.
    """
    doc, size, taken, copy = (fresh(documents, name) for name in ("_mix_id", "_mix_size", "_mix_taken", "_mix_copy"))
    share = mix(documents, text_column=text_column, **settings).select(
        F.col("doc_id").alias(doc), F.col("size").alias(size), F.col("taken").alias(taken)
    )
    # Size and words taken of one row, not the greatest of each.
    share = share.groupBy(doc).agg(F.max(F.struct(taken, size)).alias(size)).select(doc, F.col(size)[taken].alias(taken), F.col(size)[size].alias(size))
    share = share.where(F.col(taken) > 0)
    copies = F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size))
    cut = F.when(words >= F.col(size), F.col(text_column)).otherwise(first_words(F.col(text_column), words))
    met = documents.join(share, documents["doc_id"].eqNullSafe(F.col(doc))).withColumn(copy, F.explode(copies))
    return met.withColumn(text_column, cut).select(*documents.columns)


@F.arrow_udf(StringType())
def first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """The head of each text up to the end of its word number ``counts``."""
    out = []
    for text, n in zip(texts.cast(pa.binary()).to_pylist(), counts.to_pylist()):
        data = np.frombuffer(text or b"", np.uint8)
        inside = _WORD_BYTE[data]
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False))
        out.append(None if text is None else text if n is None or n >= len(ends) else text[: ends[n - 1] + 1 if n > 0 else 0])
    return pc.cast(pa.array(out, pa.binary()), pa.string())
