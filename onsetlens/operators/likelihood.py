"""Likelihood of the curve with every person's infection day integrated out.

Given the four curve parameters persons are independent, and each has one latent number, the
incubation period.  The work is (parameter rows x patterns x cells); blocks of parameter rows
meet blocks of patterns of the same cohort, and only sums per parameter row leave a task.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from onsetlens.functions.density import bernoulli_logit, curve_logit
from onsetlens.operators.grid import BASE, CAP, STEP, Scenario, cell_count, incubation_grid
from onsetlens.operators.model import BROADCAST_ROWS, PARAM_BLOCK, PARAMETERS, join_params, param_blocks
from onsetlens.session import materialise, parallel_tasks
from onsetlens.sources.schema import ONSET_DAY

THETAS_AT_ONCE = 8  # parameter rows per matrix product, so that it stays in cache
# Patterns of a block evaluated together, for the same reason.  In single precision products below
# its least normal number take so long that more rows at once are better.
ROWS_AT_ONCE = {np.float32: 128, np.float64: 64}
# Log of the least factor kept in a product, and the sum of products above which those left out do not count.
LEAST = {np.float32: (-46.0, 1e-12), np.float64: (-230.0, 1e-80)}
MOST_TURNS = 32  # tests of a row that are multiplied one by one
WIDE_DAYS = 4096  # a block whose days spread wider is evaluated test by test
HELD_SUMS = 512  # partial sums a task holds before it hands them on
DRAWS_AT_ONCE = 256  # draws of a block of persons sampled together
SPLIT_BLOCKS = 256  # blocks of persons whose infection days a task counts for the same draws
SUMMED_CELLS = 16_000_000  # cells of patterns times parameter rows that a task sums, 8 bytes each
HELD_COUNTS = 4_000_000  # counts by draw and day a task holds before it hands them on

# "person": the prior is renormalised above each person's bound, tests count whatever their day.
# "joint":  one normalisation for all; a test before infection is negative for sure.
TRUNCATIONS = ("person", "joint")


class Cells:
    """Grid of incubation periods with the log weights of every whole-day bound."""

    def __init__(self, scenarios: Sequence[Scenario], step: float, cap: int, truncation: str):
        if truncation not in TRUNCATIONS:
            raise ValueError(f"truncation is one of {TRUNCATIONS}")
        self.joint = truncation == "joint"
        self.step = step
        self.inc = (np.arange(cell_count(step, cap)) + 0.5) * step
        above = self.inc[None, :] > np.arange(cap)[:, None]
        self.log_w, self.w = {}, {}
        for s in scenarios:
            z = (np.log(self.inc) - s.mu) / s.sd
            kernel = np.exp(-np.log(self.inc) - 0.5 * z * z)
            mass = np.full(cap, kernel.sum()) if self.joint else above @ kernel
            with np.errstate(divide="ignore"):
                self.log_w[s.name] = np.log(np.where(above, kernel, 0.0) / mass[:, None])
            self.w[s.name] = np.exp(self.log_w[s.name])

    def tests(self, thetas: np.ndarray, days: np.ndarray, positive: np.ndarray) -> np.ndarray:
        """Log-likelihood of each distinct (day, result) under each parameter row in each cell.

        Days are whole and the step divides 1, so day + inc takes few values: the curve is
        evaluated once for each of them.
        """
        value, at = self._curve(thetas, days)
        return self._of_tests(value, at, positive)

    def _curve(self, thetas: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Log mass by result, and where each day's cells begin; no places if days are far apart, then it is by day and cell."""
        first, span = int(days.min()), int(days.max() - days.min())
        if span > WIDE_DAYS:
            return self._by_result(thetas, days[:, None] + self.inc), None
        per_day = round(1 / self.step)
        t = first + (np.arange(span * per_day + len(self.inc)) + 0.5) * self.step
        return self._by_result(thetas, t), (days - first) * per_day

    def _of_tests(self, value: np.ndarray, at: np.ndarray | None, positive: np.ndarray, of=slice(None)) -> np.ndarray:
        """(test, parameter row, cell) of some tests from what ``_curve`` gives."""
        if at is None:
            return np.where(positive[:, None], value[:, 1], value[:, 0]).transpose(1, 0, 2)[of]
        windows = np.lib.stride_tricks.sliding_window_view(value, len(self.inc), axis=2)
        return windows[:, positive.astype(np.int64)[of], at[of]].transpose(1, 0, 2)

    def _by_result(self, thetas: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Log mass of a negative and of a positive result at times t under each parameter row."""
        beta1, beta2, beta3, cutpoint = thetas.T.reshape(4, -1, *[1] * t.ndim)
        gap = t - cutpoint
        eta = beta1 + np.where(gap < 0, beta2, beta3) * gap * gap
        tail = np.log1p(np.exp(-np.abs(eta)))
        value = np.stack([np.minimum(-eta, 0.0) - tail, np.minimum(eta, 0.0) - tail], axis=1)
        if self.joint:
            value[:, :, t < 0] = 0.0
        return value

    def chances(self, thetas: np.ndarray, tests: "_Tests", kind=np.float64):
        """Logs of each distinct (day, result), laid out once asked for, and probabilities of each code of ``tests``, by parameter row and cell."""
        value, at = self._curve(thetas, tests.days)
        least = LEAST[kind][0]
        # Exponentials of the curve's few values, before they are laid out by test and cell.
        chance = np.exp(np.where(value < least, -np.inf, value).astype(kind))
        chance = np.ascontiguousarray(self._of_tests(chance, at, tests.positive, tests.of))
        more = np.flatnonzero(tests.n > 1)
        if len(more):
            logs = self._of_tests(value, at, tests.positive, tests.of[more]) * tests.n[more, None, None]
            chance[more] = np.exp(np.where(logs < least, -np.inf, logs))
        return functools.cache(lambda: np.ascontiguousarray(self._of_tests(value, at, tests.positive))), chance

    def persons(self, row, chances, tests: "_Tests", a: int, b: int, kind=np.float64):
        """Weights (row, parameter row, cell) of the rows a to b of ``tests``, and the logs of their scales.

        Few tests a row: their probabilities are multiplied.  Rows with many tests, or whose
        product is so small that a factor left out may count, are summed in logs.
        """
        logs, chance = chances
        weight = np.repeat(self.w[row.scenario].astype(kind, copy=False)[tests.bound[a:b]][:, None, :], chance.shape[1], axis=1)
        met = np.empty_like(weight)
        with np.errstate(under="ignore"):
            for turn in tests.turns:
                code = turn[a:b]
                if not len(code):
                    break
                np.take(chance, code, axis=0, out=met[: len(code)], mode="clip")
                weight[: len(code)] *= met[: len(code)]
            total = (weight @ np.ones(weight.shape[2], kind)).astype(float)
        scale = np.zeros(total.shape)
        bad = ~(total > LEAST[kind][1]).all(axis=1) | (tests.size[a:b] > MOST_TURNS)
        if bad.any():
            counts, table = tests.counts(a + np.flatnonzero(bad)), logs()
            value = (counts @ table.reshape(len(table), -1)).reshape(len(counts), *table.shape[1:])
            value += self.log_w[row.scenario][tests.bound[a:b][bad]][:, None, :]
            scale[bad] = value.max(axis=2)
            weight[bad] = np.exp((value - scale[bad][:, :, None]).astype(kind, copy=False))
            total[bad] = weight[bad] @ np.ones(weight.shape[2])
        return weight, total, scale


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole numbers in order and the place of each; near each other they are marked, not sorted."""
    low = int(code.min(initial=0))
    if int(code.max(initial=0)) - low > WIDE_DAYS:
        return np.unique(code, return_inverse=True)
    seen = np.bincount(code - low) > 0
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[code - low]


class _Tests:
    """Tests of the rows of a block as codes of distinct (day, result, number), most tests first."""

    def __init__(self, row):
        self.size = row.size_.astype(np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        first = (np.cumsum(self.size) - self.size)[self.order]
        code, self.column = _distinct(row.day.astype(np.int64) * 2 + row.pos)
        code = code if len(code) else np.zeros(1, np.int64)
        self.days, self.positive = code >> 1, (code & 1).astype(bool)
        self.number = row.n.astype(np.int64)
        base = int(self.number.max(initial=0)) + 1
        key, entry = _distinct(self.column * base + self.number)
        self.of, self.n = key // base, (key % base).astype(float)
        self.size, self.first = self.size[self.order], first
        self.bound = row.bound[self.order]
        most = min(int(self.size.max(initial=0)), MOST_TURNS)
        # The k-th test of each row that has one; the rows stand in falling order of their tests.
        self.turns = [entry[first[: int((self.size > k).sum())] + k] for k in range(most)]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Some rows x distinct (day, result): number of tests."""
        size = self.size[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.first[rows] - (ends - size), size) + np.arange(ends[-1])
        counts = np.zeros((len(rows), len(self.days)))
        np.add.at(counts, (np.repeat(np.arange(len(rows)), size), self.column[at]), self.number[at])
        return counts


def _block_rows(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        batch = batch.rename(columns={"size": "size_"})
        for row in batch.itertuples(index=False):
            yield row


def _thetas(row) -> np.ndarray:
    return np.column_stack([getattr(row, name) for name in PARAMETERS])


def marginal_loglik(
    params: DataFrame,
    pattern_blocks: DataFrame,
    scenarios: Sequence[Scenario] = (BASE,),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
    fast: bool = False,
    param_rows: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(scenario, cohort, param_id, loglik): sum over persons of the log of the sum over cells.

    ``fast`` takes probabilities and exponentials in single precision, enough to move a proposal: the error
    is about 1e-7 per person and has no common sign.  ``param_rows`` is the number of parameter
    rows where the caller knows it; ``carry`` names columns of doubles that come along.
    """
    cells = Cells(scenarios, step, cap, truncation)
    kind = np.float32 if fast else np.float64

    def block_sums(row) -> np.ndarray:
        tests, thetas = _Tests(row), _thetas(row)
        member = row.member.astype(float)[tests.order]
        sums = np.zeros(len(thetas))
        for i in range(0, len(thetas), THETAS_AT_ONCE):
            part = thetas[i : i + THETAS_AT_ONCE]
            chances = cells.chances(part, tests, kind)
            for a in range(0, len(member), ROWS_AT_ONCE[kind]):
                b = min(a + ROWS_AT_ONCE[kind], len(member))
                _, total, scale = cells.persons(row, chances, tests, a, b, kind)
                sums[i : i + len(part)] += member[a:b] @ (scale + np.log(total))
        return sums

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def hand_on():
            return pd.concat(
                [
                    pd.DataFrame({"scenario": key[0], "cohort": key[1], **columns, "loglik": sums})
                    for key, (columns, sums) in held.items()
                ]
            )

        for row in _block_rows(batches):
            key = (row.scenario, row.cohort, row.param_block)
            sums = block_sums(row)
            if key in held:
                held[key][1][:] += sums
            else:
                held[key] = ({name: getattr(row, name) for name in ("param_id", *carry)}, sums)
            if len(held) >= HELD_SUMS:
                yield hand_on()
                held.clear()
        if held:
            yield hand_on()

    more = [name for name in carry if name not in PARAMETERS]
    met = join_params(pattern_blocks, param_blocks(params, more), "block", PARAM_BLOCK, param_rows)
    carried = "".join(f"{name} double, " for name in carry)
    return (
        met.mapInPandas(partial_sums, f"scenario string, cohort string, param_id long, {carried}loglik double")
        .groupBy("scenario", "cohort", "param_id")
        .agg(*[F.first(name).alias(name) for name in carry], F.sum("loglik").alias("loglik"))
    )


def marginal_loglik_relational(
    params: DataFrame,
    patterns: DataFrame,
    scenarios: Sequence[Scenario] = (BASE,),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> DataFrame:
    """``marginal_loglik`` from ``patterns`` by joins and aggregates inside the JVM.

    The likelihood of a test is found once per (cohort, day, result, parameter row), a column a
    cell.  A pattern meets these terms test by test; sums by pattern and parameter row never leave
    the task that has the pattern, unless the terms are too many to broadcast.  The incubation
    grid above the bound is added and the cells are folded to the log of their sum.  Patterns whose
    bound leaves no cell do not count.  It multiplies patterns by parameter rows; the kernel of
    ``marginal_loglik`` is for many parameter rows.
    """
    spark = patterns.sparkSession
    given = "scenario" in params.columns
    thetas = params if given else params.withColumn("scenario", F.lit(BASE.name))
    # Written at once, so that the numbers stay; it is read for the tests seen and for the sums.
    placeable = patterns.where((F.col("bound") < cap) & (F.size("entries") > 0))
    kept = placeable.select(F.monotonically_increasing_id().alias("id"), "cohort", "bound", "weight", "entries")
    placeable = materialise(kept, "numbered-patterns")
    seen = placeable.select("cohort", F.inline("entries")).select("cohort", "day", "pos").distinct()
    size = cell_count(step, cap)
    cells = [f"cell{c}" for c in range(size)]
    every = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("cell")
    t = F.col("day") + (F.col("cell") + 0.5) * step
    value = bernoulli_logit(F.col("pos") == 1, curve_logit(t, *[F.col(name) for name in PARAMETERS]))
    terms = join_params(seen, thetas.select("scenario", "cohort", "param_id", *PARAMETERS, every), "day", size)
    terms = (
        terms.withColumn("value", F.when(t < 0, 0.0).otherwise(value) if truncation == "joint" else value)
        .groupBy("scenario", "cohort", "param_id", "day", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("cell", "value")))["value"].alias("values"))
        .select("scenario", "cohort", "param_id", "day", "pos", *[F.col("values")[c].alias(name) for c, name in enumerate(cells)])
    )
    terms = materialise(terms, "terms")  # a row per day, result and parameter row, counted before it is sent
    every_bound = spark.range(cap).select(F.col("id").cast("int").alias("inc_lower_bound"))
    cell = F.rint(F.col("inc") / step - 0.5).cast("int").alias("cell")
    above = F.map_from_entries(F.collect_list(F.struct(cell, "log_w")))
    grid = (
        incubation_grid(every_bound, scenarios, step, cap, truncation)
        .groupBy("scenario", F.col("inc_lower_bound").alias("bound"))
        .agg(above.alias("above"))
        .select("scenario", "bound", *[F.col("above")[c].alias(f"w{c}") for c in range(size)])
    )
    rows = terms.count()
    most = thetas.groupBy("cohort").count().agg(F.max("count")).first()[0] or 1
    tasks = max(parallel_tasks(spark), -(-placeable.count() * most * size // SUMMED_CELLS))
    # A task has all tests of its patterns, so that their sums need no second shuffle.
    dealt = placeable.repartition(tasks, "id").select("id", "cohort", "bound", "weight", F.inline("entries"))
    summed = (
        join_params(dealt, terms, "id", known=rows * size // len(PARAMETERS), on=["cohort", "day", "pos"])
        .groupBy("id", "scenario", "cohort", "param_id", "bound", "weight")
        .agg(*[F.sum(F.col("n") * F.col(name)).alias(name) for name in cells])
    )
    met = summed.join(F.broadcast(grid), ["scenario", "bound"])  # scenarios x cap rows
    of_cells = [F.col(name) + F.col(f"w{c}") for c, name in enumerate(cells)]  # null: not above the bound
    top = F.greatest(*of_cells) if size > 1 else of_cells[0]
    total = functools.reduce(operator.add, [F.coalesce(F.exp(v - top), F.lit(0.0)) for v in of_cells])
    folded = met.select("scenario", "cohort", "param_id", (F.col("weight") * (top + F.log(total))).alias("person"))
    return folded.groupBy("scenario", "cohort", "param_id").agg(F.sum("person").alias("loglik"))


# Fixed values of the 64-bit mixer below: odd step and two multipliers (splitmix64).
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_WORD = (1 << 64) - 1


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(_FIRST)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(_SECOND)
    return v ^ (v >> np.uint64(31))


def stream_key(seed: int, scenario: str, cohort: str) -> int:
    """64 bits that name a stream of uniforms: the same person draws anew in every cohort and scenario."""
    name = hashlib.md5(f"{scenario}/{cohort}".encode()).digest()
    return (int.from_bytes(name[8:], "little") + seed * _STEP) & _WORD


def person_uniform(key: int, num_id: np.ndarray, draw) -> np.ndarray:
    """Uniform in (0, 1) of a (stream, person, draw): a counter-based generator.

    It takes all 64 bits of the id and of the draw's number through an invertible mixer, so it
    does not depend on which task computes it, in which order or how often.  ``draw`` is a
    number or an array that broadcasts against ``num_id``.
    """
    with np.errstate(over="ignore"):
        person = _mixed(np.asarray(num_id, np.int64).view(np.uint64) + np.uint64(_STEP)) ^ np.uint64(key & _WORD)
        counter = (np.asarray(draw, np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
        v = _mixed(_mixed(person) + counter)
    return ((v >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class _Sampler:
    """Infection days of the persons of a block, from their conditional cell weights.

    A parameter row gives ``copies`` draws numbered from ``first``; its weights are found once.
    """

    def __init__(self, cells: Cells, row, seed: int):
        self.cells, self.row = cells, row
        self.key = stream_key(seed, row.scenario, row.cohort)
        self.tests = _Tests(row)
        self.num_id = row.member.astype(np.int64)[self.tests.order]
        self.copies = row.copies.astype(np.int64)
        ends = np.cumsum(self.copies)
        self.draws = np.repeat(row.first.astype(np.int64) - (ends - self.copies), self.copies) + np.arange(ends[-1])

    def _weights(self, thetas: np.ndarray) -> np.ndarray:
        """(person, parameter row, cell) weights, some persons at a time."""
        chances, rows = self.cells.chances(thetas, self.tests), len(self.num_id)
        parts = range(0, rows, ROWS_AT_ONCE[np.float64])
        return np.concatenate([self.cells.persons(self.row, chances, self.tests, a, min(a + parts.step, rows))[0] for a in parts])

    def infection_days(self):
        """(place of the first draw, days[person, draw]) for some draws of the block at a time.

        A cell by its conditional weight, then uniform within the cell: one uniform does both.
        """
        thetas, size = _thetas(self.row), len(self.cells.inc)
        half = 1 << max(size - 1, 1).bit_length() - 1
        persons, at = np.arange(len(self.num_id))[:, None], 0
        for i in range(0, len(thetas), THETAS_AT_ONCE):
            part = thetas[i : i + THETAS_AT_ONCE]
            weight = self._weights(part)
            # Padded to a power of two, so that a search by halves stays inside.
            running = np.full((*weight.shape[:2], half * 2), np.inf)
            np.cumsum(weight, axis=2, out=running[:, :, :size])
            running, weight = running.ravel(), weight.ravel()
            of = np.repeat(np.arange(len(part)), self.copies[i : i + THETAS_AT_ONCE])
            for j in range(0, len(of), DRAWS_AT_ONCE):
                row = persons * len(part) + of[None, j : j + DRAWS_AT_ONCE]
                want = person_uniform(self.key, self.num_id[:, None], self.draws[None, at : at + row.shape[1]])
                first = row * (2 * half)  # place of the first cell of a (person, parameter row)
                want *= running[first + (size - 1)]
                place, step = first - 1, half  # the last cell whose running weight is not above
                while step:
                    place += step * (running[place + step] <= want)
                    step >>= 1
                cell = np.minimum(place + 1 - first, size - 1)
                width = weight[row * size + cell]
                into = (want - (running[first + cell] - width)) / width
                yield at, ONSET_DAY - (cell + np.clip(into, 0.0, 1.0)) * self.cells.step
                at += row.shape[1]

    def whole_days(self):
        """``infection_days`` rounded to whole days.

        Where days begin and end with cells, as with the usual step, the place in the cell does not
        matter: a day is found among the running weights at the ends of days, half as many as cells.
        """
        if round(1 / self.cells.step) % 2:
            for at, days in self.infection_days():
                yield at, np.rint(days).astype(np.int64)
            return
        thetas = _thetas(self.row)
        day = np.rint(self.cells.inc).astype(np.int64)  # of the middle of each cell, before the onset
        last = np.flatnonzero(np.diff(day, append=day[-1] + 1))
        half = 1 << max(len(last) - 1, 1).bit_length() - 1
        persons, at = np.arange(len(self.num_id))[:, None], 0
        for i in range(0, len(thetas), THETAS_AT_ONCE):
            part = thetas[i : i + THETAS_AT_ONCE]
            weight = self._weights(part)
            running = np.full((*weight.shape[:2], half * 2), np.inf)  # padded, so that a search by halves stays inside
            running[:, :, : len(last)] = np.cumsum(weight, axis=2, out=weight)[:, :, last]
            total, running = running[:, :, len(last) - 1].ravel(), running.ravel()
            of = np.repeat(np.arange(len(part)), self.copies[i : i + THETAS_AT_ONCE])
            for j in range(0, len(of), DRAWS_AT_ONCE):
                row = persons * len(part) + of[None, j : j + DRAWS_AT_ONCE]
                want = person_uniform(self.key, self.num_id[:, None], self.draws[None, at : at + row.shape[1]])
                want *= total[row]
                first = row * (2 * half)
                place, step = first - 1, half
                probe, found, met = np.empty_like(place), np.empty_like(want), np.empty(want.shape, bool)
                while step:
                    np.add(place, step, out=probe)
                    np.less_equal(np.take(running, probe, out=found, mode="clip"), want, out=met)
                    place += np.multiply(met, step, out=probe)
                    step >>= 1
                place -= first - 1
                yield at, ONSET_DAY - np.minimum(place, len(last) - 1)
                at += row.shape[1]


def _numbered(draws: DataFrame) -> DataFrame:
    """Rows with ``first`` and ``copies`` as resampling leaves them; otherwise ``param_id`` numbers single draws."""
    if "copies" in draws.columns:
        return draws
    return draws.withColumn("first", F.col("param_id")).withColumn("copies", F.lit(1).cast("long"))


def _met_with_draws(draws: DataFrame, person_blocks: DataFrame) -> DataFrame:
    return join_params(person_blocks, param_blocks(_numbered(draws), ("first", "copies")), "block", PARAM_BLOCK)


_PACKED = "scenario string, cohort string, num_id long, first long, inf_days array<double>"
_PACKED_NAMES = [part.split()[0] for part in _PACKED.split(", ")]


def packed_infection_draws(
    draws: DataFrame,
    person_blocks: DataFrame,
    seed: int = 1,
    scenarios: Sequence[Scenario] = (BASE,),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> DataFrame:
    """(scenario, cohort, num_id, first, inf_days): days of draws first, first + 1, ... of a person."""
    cells = Cells(scenarios, step, cap, truncation)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batch.to_pandas() for batch in batches):
            sampler = _Sampler(cells, row, seed)
            persons = len(sampler.num_id)
            same = [pa.repeat(pa.scalar(name, pa.string()), persons) for name in (row.scenario, row.cohort)]
            num_id = pa.array(sampler.num_id, pa.int64())
            for at, days in sampler.infection_days():
                numbers = sampler.draws[at : at + days.shape[1]]
                # Draws of a block follow each other unless the caller numbered them with gaps.
                cuts = [0, *(np.flatnonzero(np.diff(numbers) != 1) + 1).tolist(), len(numbers)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    first = pa.repeat(pa.scalar(int(numbers[a]), pa.int64()), persons)
                    # The days as they lie in memory, with no object per person.
                    ends = pa.array(np.arange(persons + 1, dtype=np.int32) * np.int32(b - a))
                    held = pa.ListArray.from_arrays(ends, pa.array(days[:, a:b].ravel()))
                    yield pa.RecordBatch.from_arrays([*same, num_id, first, held], _PACKED_NAMES)

    return _met_with_draws(draws, person_blocks).mapInArrow(sample, _PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """(scenario, cohort, draw, num_id, inf_day) from rows that hold the days of several draws."""
    day = F.posexplode("inf_days").alias("place", "inf_day")
    return packed.select("scenario", "cohort", "num_id", "first", day).select(
        "scenario", "cohort", (F.col("first") + F.col("place")).alias("draw"), "num_id", "inf_day"
    )


def infection_draws(
    draws: DataFrame,
    person_blocks: DataFrame,
    seed: int = 1,
    scenarios: Sequence[Scenario] = (BASE,),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> DataFrame:
    """(scenario, cohort, draw, num_id, inf_day): one infection day per draw and person.

    ``draws`` has ``param_id`` and the four parameters; ``param_id`` numbers the draws, unless
    ``first`` and ``copies`` give several draws to a row.
    """
    return unpacked(packed_infection_draws(draws, person_blocks, seed, scenarios, step, cap, truncation))


_BOTH = float(1 << 26)


class _DayCounts:
    """Tests and positive ones by draw of a parameter block and day, over the blocks of a task."""

    def __init__(self, key: tuple, draws: np.ndarray):
        self.key, self.draws, self.first = key, draws, 0
        self.total = np.zeros((len(draws), 0))
        self.pos = np.zeros((len(draws), 0))

    def _hold(self, low: int, high: int) -> None:
        if not self.total.shape[1]:
            self.first = low
        before, after = max(self.first - low, 0), max(high - self.first - self.total.shape[1], 0)
        if before or after:
            pad = ((0, 0), (before, after))
            self.total, self.pos = np.pad(self.total, pad), np.pad(self.pos, pad)
            self.first -= before

    def add(self, at: int, x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> None:
        """``x`` holds the day of each test (rows) in the draws from ``at`` on (columns)."""
        low, width = int(x.min()), int(x.max() - x.min()) + 1
        self._hold(low, low + width)
        draws = x.shape[1]
        place = (np.arange(draws) * width + (x - low)).ravel()
        into = (slice(at, at + draws), slice(low - self.first, low - self.first + width))
        if n.sum() < _BOTH:  # one count of both numbers, exact in a double
            both = np.bincount(place, np.repeat(n + _BOTH * pos, draws), draws * width).reshape(draws, width)
            positive = np.floor(both / _BOTH)
            self.total[into] += both - _BOTH * positive
            self.pos[into] += positive
        else:
            self.total[into] += np.bincount(place, np.repeat(n, draws), draws * width).reshape(draws, width)
            self.pos[into] += np.bincount(place, np.repeat(pos, draws), draws * width).reshape(draws, width)

    def rows(self) -> pd.DataFrame:
        draw, day = np.nonzero(self.total)
        return pd.DataFrame(
            {
                "scenario": self.key[0],
                "cohort": self.key[1],
                "draw": self.draws[draw],
                "x": (day + self.first).astype(np.int32),
                "pos": self.pos[draw, day].astype(np.int64),
                "n": self.total[draw, day].astype(np.int64),
            }
        )


def infection_day_counts(
    draws: DataFrame,
    person_blocks: DataFrame,
    seed: int = 1,
    scenarios: Sequence[Scenario] = (BASE,),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> DataFrame:
    """(scenario, cohort, draw, x, pos, n): tests counted by draw and whole day since infection.

    Equal to joining ``infection_draws`` to the tests and counting, but the (draws x persons)
    rows stay in the task that draws them: a block already carries the tests of its persons.
    A task takes whole parameter blocks of a cohort with up to SPLIT_BLOCKS blocks of persons, so
    that the counts of many persons leave it as one row per draw and day.
    """
    cells = Cells(scenarios, step, cap, truncation)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for row in _block_rows(batches):
            person = np.repeat(np.arange(len(row.size_)), row.size_)
            if not len(person):
                continue
            sampler = _Sampler(cells, row, seed)
            person = np.argsort(sampler.tests.order)[person]  # as the sampler orders them
            key = (row.scenario, row.cohort, row.param_block)
            if held is not None and (held.key != key or held.total.size > HELD_COUNTS):
                yield held.rows()
                held = None
            held = held or _DayCounts(key, sampler.draws)
            tested, n = ONSET_DAY + row.day.astype(np.int64), row.n.astype(float)
            for at, days in sampler.whole_days():
                x = tested[:, None] - days[person]
                if x.max() - x.min() > WIDE_DAYS:  # days far apart: no dense counts over them
                    for i in range(len(x)):
                        lone = _DayCounts(key, sampler.draws[at : at + x.shape[1]])
                        lone.add(0, x[i : i + 1], n[i : i + 1], n[i : i + 1] * row.pos[i])
                        yield lone.rows()
                else:
                    if held.total.shape[1] and max(held.first + held.total.shape[1], x.max()) - min(held.first, x.min()) > WIDE_DAYS:
                        yield held.rows()
                        held = _DayCounts(key, sampler.draws)
                    held.add(at, x, n, n * row.pos)
        if held is not None:
            yield held.rows()

    spark = draws.sparkSession
    tasks = max(parallel_tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = (
        _met_with_draws(draws, person_blocks)
        .withColumn("split", F.floor(F.col("block") / SPLIT_BLOCKS))
        .repartition(tasks, "scenario", "cohort", "param_block", "split")
        .sortWithinPartitions("scenario", "cohort", "param_block", "split")
    )
    return (
        met.mapInPandas(count, "scenario string, cohort string, draw long, x int, pos long, n long")
        .groupBy("scenario", "cohort", "draw", "x")
        .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    )
