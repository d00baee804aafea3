"""What each filter of a chain removes, in every order of the chain.

Every document becomes a mask, one bit per filter it fails; counts by (part, mask) are all that
later steps read.  A recursive common table expression extends filter prefixes by unused letters
and carries the applied bits beside every mask; each level emits that step's metrics.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The filters by letter, each with the condition under which a text fails it.
# The last, of equal texts, is decided over the whole table.
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
SPACE, SYMBOLS = r"[ \t\n\x0B\f\r]+", "[#$%&*|]"

def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, bit 0 for A."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    failed = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > UPPER_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for bit, fails in enumerate(failed):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return mask

def failure_cells(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and failed filters, and those labelled.

    Copies of a text are counted where they are read, so a text that a third of all rows have is
    a few rows of the shuffle.  Of equal texts the rows of the smallest id pass filter E.  A row
    with a null id never fails E and has no label; an id with several label rows is good (toxic)
    if one of them says so.
    """
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    rows = documents.select(
        documents[id_column].cast("long").alias("id"),
        F.coalesce(documents[part_column].cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    marked = labels.groupBy(labels[id_column].cast("long").alias("labelled")).agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("is_toxic"),
    )
    key = ["digest", "part", "mask", "is_good", "is_toxic"]
    known = rows.join(marked, F.col("id") == F.col("labelled"), "left").select(
        "id",
        "part",
        "mask",
        "digest",
        F.coalesce("is_good", F.lit(False)).alias("is_good"),
        F.coalesce("is_toxic", F.lit(False)).alias("is_toxic"),
    )
    by_id = known.groupBy("id", *key).agg(F.count(F.lit(1)).alias("n"))  # a repeated id is one row
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    alike = by_id.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first")
    )
    # Now a row per part and labels of a text, however many copies it has.
    members = F.collect_list(F.struct("part", "mask", "is_good", "is_toxic", "n", "unnamed", "first"))
    texts = alike.groupBy("digest").agg(F.min("first.id").alias("least"), members.alias("members"))
    each = texts.select("least", F.inline("members"))
    passing = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask"), passing.alias("docs")),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passing).alias("docs")),
    )
    return (
        each.select("part", "is_good", "is_toxic", F.inline(split))
        .where("docs > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum(F.when(F.col("is_good"), F.col("docs")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("is_toxic"), F.col("docs")).otherwise(0)).alias("toxic"),
        )
    )

def order_steps(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(prefix, step, letter, mask, kept, removed, redundant, alone): 0 or 1 per prefix and mask.

    A table of the letters alone: 325 prefixes and 32 masks for five of them, whatever the data.
    """
    n = len(letters)
    return spark.sql(
        f"""
        WITH RECURSIVE walk(prefix, step, mask, before, bit) AS (
          SELECT '', 0, CAST(id AS INT), 0, 0 FROM range({1 << n})
          UNION ALL
          SELECT concat(prefix, substr('{letters}', place + 1, 1)), step + 1, mask, before | bit, shiftleft(1, place)
          FROM walk LATERAL VIEW
            explode(filter(sequence(0, {n - 1}), place -> (before | bit) & shiftleft(1, place) = 0)) unused AS place
        )
        SELECT prefix, step, right(prefix, 1) AS letter, mask,
               CAST(mask & (before | bit) = 0 AS INT) AS kept,
               CAST(mask & bit <> 0 AND mask & before = 0 AS INT) AS removed,
               CAST(mask & bit <> 0 AND mask & before <> 0 AS INT) AS redundant,
               CAST(mask = bit AS INT) AS alone
        FROM walk WHERE step > 0"""
    )

def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of every order and step from counts by (part, mask)."""
    steps = order_steps(cells.sparkSession, letters)

    def counted(flag: str, of: str = "docs") -> Column:
        return F.sum(F.col(flag) * F.col(of))

    by_prefix = (
        cells.join(steps, "mask")
        .groupBy("part", "prefix", "step", "letter")
        .agg(
            counted("kept").alias("kept"),
            counted("removed").alias("removed"),
            counted("redundant").alias("redundant"),
            counted("alone").alias("unique_fails"),
            counted("removed", "good").alias("good_lost"),
            counted("removed", "toxic").alias("toxic_lost"),
        )
    )
    # A prefix of k letters begins (n - k)! orders.
    begun = F.element_at(F.array(*[F.lit(factorial(len(letters) - k - 1)) for k in range(len(letters))]), F.col("step"))
    shares = by_prefix.groupBy("part", "letter").agg(F.sum(F.col("removed") * begun).alias("shapley"))
    orders = (
        steps.where(f"step = {len(letters)} AND mask = 0")
        .select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
        .select("filter_order", F.expr("left(filter_order, at)").alias("prefix"))
    )
    return (
        by_prefix.join(orders, "prefix")
        .join(shares, ["part", "letter"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        )
    )

def filter_audit(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """One row per part, order of the five filters and step: what the step keeps, removes and loses.

    (part string, filter_order string, step int, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley long).  A null text is empty and fails A only (and E); a null
    part and an empty one are the same part "".  An empty table has no part and gives no row;
    rows that repeat in id and text count each, and pass E together; labels of other ids and
    other columns are not read.
    """
    return audit_orders(failure_cells(documents, labels, id_column, text_column, part_column))
