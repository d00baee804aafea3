"""Persons reduced to what the likelihood needs, and packed into blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from onsetlens.operators.cohorts import COHORTS, Cohort, cohort_names, with_membership
from onsetlens.session import parallel_tasks

BLOCK_ROWS = 256
SET_BLOCK_ROWS = 1024  # of which a cohort takes its part
BLOCKS_A_TASK = 256
TASK_ROWS = 64_000_000  # persons times parameter rows a task takes at most, on average


def person_sets(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """(cohorts, num_id, bound, entries): counts of a person's tests by day and result.

    A row stands for all cohorts, a bit each in ``cohorts``, in which the person has these tests:
    one row per person, unless some cohort takes part of the tests only; then one per cohort.
    An array holds at most two entries per day and membership however many tests one person has.
    Tests without a day or a result are no entries; a person who has no others keeps its row.
    """
    counted = (
        with_membership(tests, cohorts)
        .groupBy("num_id", "cohorts", "symp_onset_day", "day_of_test", "pcr_result")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("day", F.col("day_of_test") - F.col("symp_onset_day"))
    )
    held = counted.groupBy("num_id").agg(
        F.bit_or("cohorts").alias("any"),
        F.bit_and("cohorts").alias("all"),
        F.collect_list(F.struct("day", F.col("pcr_result").cast("tinyint").alias("pos"), "n", "cohorts")).alias("tests"),
    )
    one = F.col("any") == F.col("all")
    bits = [F.lit(1 << bit).cast("long") for bit in range(len(cohorts))]
    member = F.array_compact(F.array(*[F.when(F.col("any").bitwiseAND(bit) != 0, bit) for bit in bits]))
    sets = held.withColumn("cohorts", F.explode(F.when(one, F.array("any")).otherwise(member)))
    kept = F.filter(
        "tests", lambda t: t["day"].isNotNull() & t["pos"].isNotNull() & (t["cohorts"].bitwiseAND(F.col("cohorts")) != 0)
    )
    entries = F.sort_array(F.transform(kept, lambda t: F.struct(t["day"].alias("day"), t["pos"].alias("pos"), t["n"].alias("n"))))
    early = F.transform("entries", lambda e: F.when((e["pos"] == 1) & (e["day"] < 0), -e["day"]))
    return sets.select("cohorts", "num_id", entries.alias("entries")).select(
        "cohorts", "num_id", F.coalesce(F.array_max(early), F.lit(0)).alias("bound"), "entries"
    )


def of_cohorts(sets: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """A row per cohort instead of one per set of cohorts."""
    return sets.select(cohort_names(cohorts), *[c for c in sets.columns if c != "cohorts"])


def person_entries(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """(cohort, num_id, bound, entries) of ``person_sets``."""
    return of_cohorts(person_sets(tests, cohorts), cohorts)


def patterns(persons: DataFrame) -> DataFrame:
    """Persons with equal entries are equal to the likelihood: keep one and their number."""
    of = "cohorts" if "cohorts" in persons.columns else "cohort"
    return persons.groupBy(of, "bound", "entries").agg(F.count(F.lit(1)).alias("weight"))


def cohort_patterns(sets: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """``patterns`` per cohort of ``person_sets``, counted before they are fanned out."""
    return (
        of_cohorts(patterns(sets), cohorts).groupBy("cohort", "bound", "entries").agg(F.sum("weight").alias("weight"))
    )


def block_tasks(persons: DataFrame, param_rows: int = 256) -> int:
    """Tasks for the blocks of a materialised table that meet ``param_rows`` parameter rows (or
    draws) of their cohort: all cores, and more as the product grows."""
    return max(parallel_tasks(persons.sparkSession), -(-persons.count() * param_rows // TASK_ROWS))


def set_blocks(
    sets: DataFrame, member: str, cap: int, size: int = SET_BLOCK_ROWS, tasks: int | None = None
) -> DataFrame:
    """(block, rows): about ``size`` rows of ``person_sets`` or their patterns per block.

    Each row is shuffled once, whatever the number of its cohorts; ``cohort_blocks`` fans out.
    ``sets`` is a materialised table, as it is counted first.
    """
    tasks = tasks or max(parallel_tasks(sets.sparkSession), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placeable = sets.where(F.col("bound") < cap)
    n_blocks = max(1, -(-placeable.count() // size))
    block = F.pmod(F.xxhash64("cohorts", "entries", member), F.lit(n_blocks)).alias("block")
    return (
        placeable.select(block, F.struct(F.col(member).alias("member"), "bound", "entries", "cohorts").alias("row"))
        .repartition(max(tasks, n_blocks // BLOCKS_A_TASK), "block")
        .groupBy("block")
        .agg(F.collect_list("row").alias("rows"))
    )


def cohort_blocks(packed: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """Blocks of single cohorts, as ``blocks`` gives them, from blocks of sets of cohorts."""
    bits = [F.struct(F.lit(c.name).alias("cohort"), F.lit(1 << bit).cast("long").alias("bit")) for bit, c in enumerate(cohorts)]
    chosen = F.filter("rows", lambda r: r["cohorts"].bitwiseAND(F.col("bit")) != 0).alias("rows")
    fanned = packed.select("block", "rows", F.inline(F.array(*bits))).select("cohort", "block", chosen)
    return _flat(fanned.where(F.size("rows") > 0))


def blocks(
    rows: DataFrame, member: str, cap: int, size: int = BLOCK_ROWS, tasks: int | None = None
) -> DataFrame:
    """About ``size`` rows (patterns or persons) per block, as flat arrays.

    ``member`` is the column kept per row: the weight of a pattern or the id of a person.
    Rows are distinct, so hashing them spreads every cohort evenly over its blocks; the number
    of blocks follows the size of the cohort.  The tasks are numbered explicitly: the stage
    that reads the blocks is bound by computing and would be coalesced by their few bytes.
    """
    spark = rows.sparkSession
    tasks = tasks or max(parallel_tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placeable = rows.where(F.col("bound") < cap)
    sizes = placeable.groupBy("cohort").agg(F.ceil(F.count(F.lit(1)) / size).alias("n_blocks"))
    hashed = F.pmod(F.xxhash64("entries", member), F.col("n_blocks")).alias("block")
    packed = (
        placeable.join(F.broadcast(sizes), "cohort")  # one row per cohort
        .select("cohort", hashed, F.struct(F.col(member).alias("member"), "bound", "entries").alias("row"))
        .repartition(tasks, "cohort", "block")
        .groupBy("cohort", "block")
        .agg(F.collect_list("row").alias("rows"))
    )
    return _flat(packed)


def _flat(packed: DataFrame) -> DataFrame:
    entries = F.flatten("rows.entries")
    return packed.select(
        "cohort",
        "block",
        F.col("rows.member").alias("member"),
        F.col("rows.bound").alias("bound"),
        F.transform("rows", lambda r: F.size(r["entries"])).alias("size"),
        entries["day"].alias("day"),
        entries["pos"].alias("pos"),
        entries["n"].alias("n"),
    )
