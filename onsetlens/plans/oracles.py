"""The SQL each query is compared with, in DuckDB's dialect, over the same whole tables."""

from __future__ import annotations

import textwrap

from onsetlens.operators.cohorts import COHORTS
from onsetlens.operators.grid import BASE, SCENARIOS
from onsetlens.sources.schema import DOCUMENTED, TESTS

_PRIME = 2147483647

_TESTS = """
tests AS (
  SELECT l_orderkey AS num_id,
         CAST((date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 51) - 10 AS INT) AS days_since_onset,
         l_returnflag = 'R' AS pcr_result,
         CASE o_orderstatus WHEN 'F' THEN 'First' WHEN 'O' THEN 'Second' ELSE 'Third' END AS time_period,
         CASE WHEN o_orderstatus = 'F' THEN 'Exclude' ELSE 'Include' END AS included_main_analysis,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes'
              WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'No' ELSE 'Unknown' END AS immunised,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Yes'
              WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'No' ELSE 'Unknown' END AS overseas,
         CASE o_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Unknown' END AS gender,
         CASE WHEN c_acctbal < 4500 THEN 'under40' ELSE 'over40' END AS age_group,
         CAST(c_nationkey % 2 AS INT) AS comorbidities,
         CASE n_regionkey WHEN 0 THEN 'Maori' WHEN 1 THEN 'Pacific' WHEN 4 THEN 'Unknown' ELSE 'Other' END AS ethnicity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey
                JOIN nation ON c_nationkey = n_nationkey
),
aligned AS (
  SELECT *, 30 AS symp_onset_day, 30 + days_since_onset AS day_of_test FROM tests
)"""


def _literal(value) -> str:
    return str(value) if isinstance(value, int) else f"'{value}'"


def _member(cohort) -> str:
    where = " AND ".join(f"{column} = {_literal(value)}" for column, value in cohort.where.items())
    return f"SELECT '{cohort.name}' AS cohort, * FROM aligned WHERE {where}"


_CT = "ct AS MATERIALIZED (\n" + "\nUNION ALL\n".join(_member(c) for c in COHORTS) + "\n)"

_BOUNDS = """
bounds AS (
  SELECT cohort, num_id,
         coalesce(min(CASE WHEN pcr_result AND day_of_test < symp_onset_day THEN day_of_test END),
                  min(symp_onset_day)) AS te_upper_bound,
         min(symp_onset_day)
           - coalesce(min(CASE WHEN pcr_result AND day_of_test < symp_onset_day THEN day_of_test END),
                      min(symp_onset_day)) AS inc_lower_bound
  FROM ct GROUP BY cohort, num_id
)"""

_COUNTS = """
counts AS (
  SELECT cohort, days_since_onset, count(*) FILTER (WHERE pcr_result) AS x, count(pcr_result) AS n
  FROM ct GROUP BY cohort, days_since_onset
)"""

_KNOWN_COUNTS = """
known_counts AS (
  SELECT cohort, days_since_onset, count(*) FILTER (WHERE pcr_result) AS x, count(pcr_result) AS n
  FROM ct WHERE num_id % 97 <> 0 GROUP BY cohort, days_since_onset
)"""

_DAY_PARAMS = f"""
day_params AS (
  SELECT cohort, CAST(days_since_onset + 11 AS BIGINT) AS param_id, x, n,
         ln((x + 0.5) / (n - x + 0.5)) AS beta1,
         -0.005::DOUBLE - 0.1::DOUBLE * ((((n * 48271 + x * 69621 + days_since_onset * 16807) % {_PRIME}) + {_PRIME}) % {_PRIME} / {_PRIME}.0::DOUBLE) AS beta2,
         -0.001::DOUBLE - 0.01::DOUBLE * ((((n * 69621 + x * 16807 + days_since_onset * 48271) % {_PRIME}) + {_PRIME}) % {_PRIME} / {_PRIME}.0::DOUBLE) AS beta3,
         1 + 8 * ((((n * 16807 + x * 48271 + days_since_onset * 69621) % {_PRIME}) + {_PRIME}) % {_PRIME} / {_PRIME}.0::DOUBLE) AS cutpoint
  FROM counts
)"""

_LATTICE = """
lattice AS (
  SELECT cohort, param_id,
         ln((x + 0.5) / (n - x + 0.5)) + 0.25 * param_id AS beta1,
         -0.01::DOUBLE * (1 + param_id) AS beta2,
         -0.002::DOUBLE * (1 + param_id) AS beta3,
         3.0::DOUBLE + param_id AS cutpoint
  FROM (SELECT cohort, CAST(sum(x) AS BIGINT) AS x, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY cohort),
       (SELECT range AS param_id FROM range(4))
)"""

_CURVE = """
curve AS (
  SELECT cohort, param_id, k,
         1 / (1 + exp(-(beta1 + (CASE WHEN k / 10.0::DOUBLE < cutpoint THEN beta2 ELSE beta3 END)
                               * (k / 10.0::DOUBLE - cutpoint) * (k / 10.0::DOUBLE - cutpoint)))) AS p
  FROM day_params, (SELECT CAST(range AS INT) AS k FROM range(501))
)"""


def _values(scenarios) -> str:
    return ", ".join(f"('{s.name}', {s.mu}::DOUBLE, {s.sd}::DOUBLE)" for s in scenarios)


def _grid(scenarios, joint: bool = False) -> str:
    mass = "true" if joint else "inc > inc_lower_bound"
    return f"""
scenarios(scenario, mu, sd) AS (VALUES {_values(scenarios)}),
cells AS (
  SELECT range AS cell, (range + 0.5::DOUBLE) * 0.5 AS inc FROM range(60)
),
kernels AS (
  SELECT scenario, inc_lower_bound, cell, inc,
         -ln(inc) - 0.5 * ((ln(inc) - mu) / sd) * ((ln(inc) - mu) / sd) AS log_k
  FROM (SELECT DISTINCT inc_lower_bound FROM bounds), cells, scenarios
),
grid AS (
  SELECT g.scenario, g.inc_lower_bound, cell, inc, log_k - ln(total) AS log_w
  FROM kernels g
  JOIN (SELECT scenario, inc_lower_bound, sum(exp(log_k)) AS total
        FROM kernels WHERE {mass} GROUP BY scenario, inc_lower_bound) t
    ON g.scenario = t.scenario AND g.inc_lower_bound = t.inc_lower_bound
  WHERE inc > g.inc_lower_bound
)"""


_LOGLIK = "-(greatest(-{s}, 0.0::DOUBLE) + ln(1 + exp(-abs({s}))))"


def _person_cells(joint: bool = False) -> str:
    """Log-likelihood of each person in each cell of the incubation grid, per parameter row."""
    before = "CASE WHEN day + inc < 0 THEN 0.0::DOUBLE ELSE " if joint else ""
    end = " END" if joint else ""
    return f"""
entries AS (
  SELECT cohort, num_id, days_since_onset AS day, pcr_result AS pos, count(*) AS n
  FROM ct GROUP BY cohort, num_id, days_since_onset, pcr_result
),
signed AS (
  SELECT cohort, param_id, day, pos, cell, inc,
         (CASE WHEN pos THEN 1 ELSE -1 END)
           * (beta1 + (CASE WHEN day + inc < cutpoint THEN beta2 ELSE beta3 END)
                      * (day + inc - cutpoint) * (day + inc - cutpoint)) AS s
  FROM (SELECT DISTINCT cohort, day, pos FROM entries) JOIN lattice USING (cohort), cells
),
test_cells AS MATERIALIZED (
  SELECT cohort, param_id, day, pos, cell, {before}{_LOGLIK.format(s='s')}{end} AS ll FROM signed
),
person_cells AS (
  SELECT cohort, num_id, param_id, cell, sum(n * ll) AS ll
  FROM entries JOIN test_cells USING (cohort, day, pos)
  GROUP BY cohort, num_id, param_id, cell
)"""


# No person of the bindings has so many tests that a likelihood underflows, so the plain sum serves.
_PERSON_LOGLIK = """
person_loglik AS (
  SELECT scenario, cohort, num_id, param_id, ln(sum(exp(ll + log_w))) AS ll
  FROM person_cells JOIN bounds USING (cohort, num_id) JOIN grid USING (inc_lower_bound, cell)
  GROUP BY scenario, cohort, num_id, param_id
)"""


def _prior() -> str:
    half_log_2pi = 0.9189385332046727
    log_2 = 0.6931471805599453
    return f"""(
  -0.5 * (beta1 / 5) * (beta1 / 5) - {half_log_2pi} - ln(5.0::DOUBLE)
  - 0.5 * beta2 * beta2 - {half_log_2pi} + {log_2}
  - 0.5 * beta3 * beta3 - {half_log_2pi} + {log_2}
  - 0.5 * ((cutpoint - 5) / 5) * ((cutpoint - 5) / 5) - {half_log_2pi} - ln(5.0::DOUBLE)
  - ln(0.8413447460685429::DOUBLE))"""


_SCORED = f"""
scored AS (
  SELECT cohort, param_id, beta1, beta2, beta3, cutpoint,
         x * ln(share) + (n - x) * ln(1 - share) + {_prior()} - 0.01 * param_id AS log_weight
  FROM day_params
  JOIN (SELECT cohort, sum(x) / sum(n) AS share FROM day_params GROUP BY cohort) USING (cohort)
),
weights AS (
  SELECT *, raw / total AS weight, total * total / squares AS ess
  FROM (SELECT *, sum(raw) OVER (PARTITION BY cohort) AS total, sum(raw * raw) OVER (PARTITION BY cohort) AS squares
        FROM (SELECT *, exp(log_weight - max(log_weight) OVER (PARTITION BY cohort)) AS raw FROM scored))
)"""

_COPIES = """
running AS (
  SELECT *, sum(weight) OVER (PARTITION BY cohort ORDER BY param_id ROWS UNBOUNDED PRECEDING) AS upto FROM weights
),
copies AS (
  SELECT *, last - first AS copies
  FROM (SELECT *, coalesce(lag(last) OVER (PARTITION BY cohort ORDER BY param_id), 0) AS first
        FROM (SELECT *, CAST(least(greatest(ceil(upto * 1000 - 0.31830988::DOUBLE), 0), 1000) AS BIGINT) AS last FROM running))
),
resampled AS (
  SELECT cohort, unnest(range(first, last)) AS draw, param_id, beta1, beta2, beta3, cutpoint FROM copies
)"""

_GIVEN = f"""
given AS (
  SELECT cohort, draw, num_id,
         te_upper_bound - 14 * ((num_id * 48271 + draw * 16807) % {_PRIME} / {_PRIME}.0::DOUBLE) AS inf_day
  FROM bounds, (SELECT range AS draw FROM range(1, 21))
),
shares AS (
  SELECT cohort, draw, x, count(*) FILTER (WHERE pcr_result) / count(*) AS share
  FROM (SELECT cohort, draw, CAST(day_of_test - round_even(inf_day, 0) AS INT) AS x, pcr_result
        FROM ct JOIN given USING (cohort, num_id))
  GROUP BY cohort, draw, x
),
empirical AS (
  SELECT cohort, x, quantile_cont(share, 0.975) AS top, avg(share) AS mean, quantile_cont(share, 0.025) AS bottom
  FROM shares WHERE x >= 0 GROUP BY cohort, x
)"""

_CURVE_SUMMARY = """
curve_summary AS (
  SELECT cohort, k / 10.0::DOUBLE AS days_since_infection, quantile_cont(p, 0.5) AS median,
         quantile_cont(p, 0.025) AS lower_95, quantile_cont(p, 0.975) AS upper_95
  FROM curve GROUP BY cohort, k
)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(textwrap.dedent(p).strip() for p in parts) + "\n" + textwrap.dedent(select).strip()


_WORD = "18446744073709551616::UHUGEINT"


def _wrapped(product: str) -> str:
    """A sum or product of 128-bit words as a 64-bit word."""
    return f"CAST(({product}) % {_WORD} AS UBIGINT)"


def _mixed(source: str, keep: str) -> str:
    """The 64-bit mixer on column v of ``source``, a step per nested query."""
    for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931")):
        product = _wrapped(f"xor(v, v >> {shift})::UHUGEINT * {factor}::UHUGEINT")
        source = f"(SELECT {keep}, {product} AS v FROM {source})"
    return f"(SELECT {keep}, xor(v, v >> 31) AS v FROM {source})"


def _uniforms(draws: str, persons: str = "bounds", seed: int = 7) -> str:
    """One uniform per person and draw; ``draws`` has (cohort, draw)."""
    step = "11400714819323198485::UHUGEINT"
    started = f"(SELECT cohort, num_id, {_wrapped(f'num_id::UHUGEINT + {step}')} AS v FROM {persons})"
    name = _wrapped(f"md5_number_lower('base/' || cohort)::UHUGEINT + {seed} * {step}")
    keyed = f"(SELECT cohort, num_id, xor(v, {name}) AS v FROM {_mixed(started, 'cohort, num_id')})"
    counter = _wrapped(f"v::UHUGEINT + {_wrapped(f'(draw + 1)::UHUGEINT * {step}')}::UHUGEINT")
    met = f"(SELECT cohort, num_id, draw, {counter} AS v FROM {_mixed(keyed, 'cohort, num_id')} JOIN {draws} USING (cohort))"
    mixed = _mixed(met, "cohort, num_id, draw")
    return f"uniforms AS (SELECT cohort, num_id, draw, ((v >> 12)::DOUBLE + 0.5::DOUBLE) / 4503599627370496 AS u FROM {mixed})"


_SAMPLED = f"""
{_uniforms('(SELECT cohort, param_id AS draw FROM lattice)')},
weighed AS (
  SELECT cohort, num_id, param_id, cell, exp(ll + log_w) AS w
  FROM person_cells JOIN bounds USING (cohort, num_id) JOIN grid USING (inc_lower_bound, cell)
),
summed AS (
  SELECT *, sum(w) OVER (PARTITION BY cohort, num_id, param_id ORDER BY cell ROWS UNBOUNDED PRECEDING) AS upto
  FROM weighed
),
picked AS (
  SELECT cohort, num_id, param_id, u * max(upto) AS want,
         list(cell ORDER BY cell) AS cells, list(w ORDER BY cell) AS w, list(upto ORDER BY cell) AS upto
  FROM summed JOIN (SELECT cohort, num_id, draw AS param_id, u FROM uniforms) USING (cohort, num_id, param_id)
  GROUP BY cohort, num_id, param_id, u
),
placed AS (
  SELECT *, least(len(list_filter(upto, lambda s: s <= want)) + 1, len(upto)) AS place FROM picked
),
sampled AS (
  SELECT cohort, param_id AS draw, num_id,
         30 - (cells[place] + (want - (upto[place] - w[place])) / w[place]) * 0.5::DOUBLE AS inf_day
  FROM placed
)"""


_POSTERIOR_LATTICE = """
lattice AS (
  SELECT cohort, param_id,
         ln((x + 0.5) / (n - x + 0.5)) + 1.5::DOUBLE * (param_id // 4) / sqrt(n) AS beta1,
         -0.0002::DOUBLE * (1 + param_id % 4 // 2) AS beta2,
         -0.0001::DOUBLE * (1 + param_id % 4 // 2) AS beta3,
         4.0::DOUBLE + 3 * (param_id % 2) AS cutpoint
  FROM (SELECT cohort, CAST(sum(x) AS BIGINT) AS x, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY cohort),
       (SELECT range AS param_id FROM range(12))
)"""

_LATTICE_WEIGHTS = f"""
totals AS MATERIALIZED (SELECT scenario, cohort, param_id, sum(ll) AS loglik FROM person_loglik GROUP BY ALL),
weighted AS (
  SELECT *, raw / sum(raw) OVER (PARTITION BY scenario, cohort) AS weight,
         sum(raw) OVER (PARTITION BY scenario, cohort) * sum(raw) OVER (PARTITION BY scenario, cohort)
           / sum(raw * raw) OVER (PARTITION BY scenario, cohort) AS ess
  FROM (SELECT *, exp(log_weight - max(log_weight) OVER (PARTITION BY scenario, cohort)) AS raw
        FROM (SELECT *, loglik + {_prior()} AS log_weight FROM totals JOIN lattice USING (cohort, param_id)))
)"""


def _drawn(n: int) -> str:
    """n equal draws per cohort from the lattice weights."""
    return f"""
drawn AS MATERIALIZED (
  SELECT cohort, unnest(range(first, last)) AS draw, param_id, beta1, beta2, beta3, cutpoint
  FROM (SELECT *, coalesce(lag(last) OVER (PARTITION BY cohort ORDER BY param_id), 0) AS first
        FROM (SELECT *, CAST(least(greatest(ceil(upto * {n} - 0.31830988::DOUBLE), 0), {n}) AS BIGINT) AS last
              FROM (SELECT *, sum(weight) OVER (PARTITION BY cohort ORDER BY param_id ROWS UNBOUNDED PRECEDING) AS upto FROM weighted)))
)"""


def _days_drawn(persons: str) -> str:
    """An infection day for every draw of ``persons`` (cohort, num_id)."""
    return f"""
chosen AS ({persons}),
{_uniforms('(SELECT cohort, draw FROM drawn)', 'chosen')},
weighed AS (
  SELECT cohort, num_id, param_id, cell, exp(ll + log_w) AS w
  FROM person_cells JOIN chosen USING (cohort, num_id) JOIN bounds USING (cohort, num_id) JOIN grid USING (inc_lower_bound, cell)
),
summed AS (
  SELECT *, sum(w) OVER (PARTITION BY cohort, num_id, param_id ORDER BY cell ROWS UNBOUNDED PRECEDING) AS upto
  FROM weighed
),
lists AS MATERIALIZED (
  SELECT cohort, num_id, param_id, max(upto) AS total,
         list(cell ORDER BY cell) AS cells, list(w ORDER BY cell) AS w, list(upto ORDER BY cell) AS upto
  FROM summed GROUP BY cohort, num_id, param_id
),
wanted AS (
  SELECT cohort, num_id, draw, cells, w, upto, u * total AS want
  FROM lists JOIN drawn USING (cohort, param_id) JOIN uniforms USING (cohort, num_id, draw)
),
placed AS (
  SELECT *, least(len(list_filter(upto, lambda s: s <= want)) + 1, len(upto)) AS place FROM wanted
),
days AS (
  SELECT cohort, draw, num_id,
         30 - (cells[place] + (want - (upto[place] - w[place])) / w[place]) * 0.5::DOUBLE AS inf_day
  FROM placed
)"""


_DRAWN_SHARES = """
shares AS (
  SELECT cohort, draw, x, count(*) FILTER (WHERE pcr_result) / count(*) AS share
  FROM (SELECT cohort, draw, CAST(day_of_test - round_even(inf_day, 0) AS INT) AS x, pcr_result
        FROM ct JOIN days USING (cohort, num_id))
  GROUP BY cohort, draw, x
),
empirical AS (
  SELECT cohort, x, quantile_cont(share, 0.975) AS top, avg(share) AS mean, quantile_cont(share, 0.025) AS bottom
  FROM shares WHERE x >= 0 GROUP BY cohort, x
)"""


def _lattice_parts(scenarios) -> list[str]:
    return [
        _TESTS, _CT, _BOUNDS, _COUNTS, _POSTERIOR_LATTICE, _grid(scenarios), _person_cells(), _PERSON_LOGLIK,
        _LATTICE_WEIGHTS,
    ]


def _points(source: str) -> str:
    """Positivity at 0.0 to 50.0 days of the parameter rows of ``source``."""
    t = "(k / 10.0::DOUBLE - cutpoint)"
    return f"""(SELECT *, 1 / (1 + exp(-(beta1 + (CASE WHEN k / 10.0::DOUBLE < cutpoint THEN beta2 ELSE beta3 END) * {t} * {t}))) AS p
    FROM {source}, (SELECT CAST(range AS INT) AS k FROM range(501)))"""


_TAIL = """
ranked AS (
  SELECT cohort, weight, row_number() OVER (PARTITION BY cohort ORDER BY weight DESC, param_id) AS place FROM weights
),
sizes AS (
  SELECT cohort, count(*) AS rows, count(*) FILTER (WHERE weight > 0) AS possible_rows, any_value(ess) AS ess,
         CAST(least(floor(0.2::DOUBLE * count(*)), ceil(3 * sqrt(count(*)))) AS BIGINT) AS m
  FROM weights GROUP BY cohort
),
marks AS (
  SELECT cohort, m, max(weight) FILTER (WHERE place = m + 1) AS cutoff, max(weight) AS most,
         max(weight) FILTER (WHERE place = m + 1 - floor(m / 4 + 0.5)) AS quarter
  FROM ranked JOIN sizes USING (cohort) GROUP BY cohort, m
),
excess AS (
  SELECT cohort, m, most - cutoff AS most, quarter - cutoff AS quarter, weight - cutoff AS x
  FROM ranked JOIN marks USING (cohort) WHERE place <= m AND m >= 5 AND quarter > cutoff
),
profile AS (
  SELECT cohort, theta, k, m * (ln(-theta / k) - k - 1) AS loglik
  FROM (SELECT cohort, m, theta, sum(ln(1 - theta * x)) / m AS k
        FROM (SELECT *, 1 / most + (1 - sqrt((30 + floor(sqrt(m))) / (point - 0.5))) / (3 * quarter) AS theta
              FROM (SELECT *, unnest(range(1, 31 + CAST(floor(sqrt(m)) AS BIGINT))) AS point FROM excess))
        GROUP BY cohort, m, point, theta)
),
chosen AS (
  SELECT cohort, sum(w * theta) / sum(w) AS theta
  FROM (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY cohort)) AS w FROM profile) GROUP BY cohort
),
tails AS (
  SELECT cohort, (avg(ln(1 - theta * x)) * m + 5) / (m + 10) AS tail_shape
  FROM excess JOIN chosen USING (cohort) GROUP BY cohort, m
)"""


def _interval(counts: str) -> str:
    """Exact limits by bisection on the binomial tail."""
    mass = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))"
    return f"""
halved AS (
  SELECT cohort, tSinceOnset, x, n, 0 AS round, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.5::DOUBLE AS p
  FROM (SELECT *, days_since_onset AS tSinceOnset FROM {counts}), (VALUES ('lower'), ('upper')) s(side)
  UNION ALL
  SELECT cohort, tSinceOnset, x, n, round + 1, side,
         CASE WHEN low THEN p ELSE lo END, CASE WHEN low THEN hi ELSE p END,
         CASE WHEN low THEN (p + hi) / 2 ELSE (lo + p) / 2 END
  FROM (SELECT *, CASE side
                    WHEN 'lower' THEN list_sum([{mass} FOR i IN range(x, n + 1)]) < 0.025
                    ELSE list_sum([{mass} FOR i IN range(0, x + 1)]) > 0.025 END AS low
        FROM halved WHERE round < 40)
),
limits AS (
  SELECT cohort, tSinceOnset, x, n,
         max(CASE WHEN side = 'lower' THEN CASE WHEN x = 0 THEN 0 ELSE p END END) AS lower,
         max(CASE WHEN side = 'upper' THEN CASE WHEN x = n THEN 1 ELSE p END END) AS upper
  FROM halved WHERE round = 40 GROUP BY cohort, tSinceOnset, x, n
)"""


_POSITIVITY = """
SELECT cohort, 'exact' AS method, x, n, round(x / n, 7) AS mean, round(lower, 7) AS lower,
       round(upper, 7) AS upper, tSinceOnset
FROM limits"""

_EVENTS = """
event_tests AS (
  SELECT user_id AS num_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) - 10 AS INT) AS days_since_onset,
         event_type = 'purchase' AS pcr_result
  FROM events
)"""

_EVENT_COUNTS = """
counts AS (
  SELECT 'Everyone' AS cohort, days_since_onset, count(*) FILTER (WHERE pcr_result) AS x, count(pcr_result) AS n
  FROM event_tests GROUP BY days_since_onset
)"""

_PATTERNS = """
both_tests AS (
  SELECT cohort, num_id, days_since_onset, pcr_result FROM ct
  UNION ALL SELECT 'Everyone', num_id, days_since_onset, pcr_result FROM event_tests
),
both_entries AS (
  SELECT cohort, num_id, days_since_onset AS day, pcr_result AS pos, count(*) AS n
  FROM both_tests GROUP BY ALL
),
both_persons AS (
  SELECT cohort, num_id, coalesce(max(CASE WHEN pos AND day < 0 THEN -day END), 0) AS bound, count(*) AS entries,
         string_agg(day || '/' || pos || '/' || n, ',' ORDER BY day, pos) AS pattern
  FROM both_entries GROUP BY cohort, num_id
)"""


def _checks() -> str:
    parts = []
    for field in TESTS.fieldNames():
        outside = "0"
        if field in DOCUMENTED:
            values = ", ".join(f"'{v}'" for v in DOCUMENTED[field])
            outside = f"count(*) FILTER (WHERE CAST({field} AS VARCHAR) NOT IN ({values}))"
        parts.append(
            f"SELECT count(*) AS rows_read, '{field}' AS field, count(*) - count({field}) AS nulls, "
            f"CAST({outside} AS BIGINT) AS outside FROM tests"
        )
    return "\nUNION ALL\n".join(parts)


def _panel(name: str) -> str:
    members = [c for c in COHORTS if c.panel == name]
    legend = ", ".join(f"('{c.name}', '{c.panel}', '{c.label}', {c.order})" for c in members)
    return _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _DAY_PARAMS, _CURVE, _CURVE_SUMMARY, _GIVEN,
        f'legend(cohort, panel, "group", group_ord) AS (VALUES {legend})',
        select="""
        SELECT panel, "group", group_ord, series, x, round(y, 9) AS y, round(top, 9) AS top, round(bottom, 9) AS bottom
        FROM legend JOIN (
          SELECT cohort, 'curve' AS series, days_since_infection AS x, median AS y, upper_95 AS top, lower_95 AS bottom
          FROM curve_summary
          UNION ALL
          SELECT cohort, 'empirical', CAST(x AS DOUBLE), mean, top, bottom FROM empirical) USING (cohort)""",
    )


def _loglik(joint: bool) -> str:
    return _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _LATTICE, _grid([BASE], joint), _person_cells(joint), _PERSON_LOGLIK,
        select="SELECT cohort, param_id, round(sum(ll), 6) AS loglik FROM person_loglik GROUP BY cohort, param_id",
    )


_LONG = """
SELECT days_since_onset, c.cohort, x
FROM (SELECT DISTINCT days_since_onset FROM counts)
CROSS JOIN (SELECT DISTINCT cohort FROM counts) c
LEFT JOIN counts USING (days_since_onset, cohort)"""

_PARAMETER_ROWS = """
SELECT cohort, Parameter, round(quantile_cont(value, 0.5), 9) AS median, round(avg(value), 9) AS mean,
       round(quantile_cont(value, 0.025), 9) AS CI95Low, round(quantile_cont(value, 0.975), 9) AS CI95Up
FROM (SELECT cohort, cutpoint AS Cutpoint, beta1 AS Beta1, beta2 AS Beta2, beta3 AS Beta3 FROM {source})
UNPIVOT (value FOR Parameter IN (Cutpoint, Beta1, Beta2, Beta3))
GROUP BY cohort, Parameter"""

_POSITIVITY_SQL = _with(_TESTS, _CT, _COUNTS, _interval("counts"), select=_POSITIVITY, recursive=True)

_DAYS = ", ".join(f"max(CASE WHEN days_since_onset = {i - 10} THEN x END) AS d{i}" for i in range(51))

_FIELDS = ", ".join(TESTS.fieldNames())

ORACLES: dict[str, str] = {
    "load_tests": _with(_TESTS, select=f"SELECT {_FIELDS} FROM tests"),
    "load_tests_csv": _with(_TESTS, select=f"SELECT {_FIELDS} FROM tests"),
    "check_values": _with(_TESTS, select=_checks()),
    "align_days": _with(_TESTS, select="SELECT * FROM aligned"),
    "assign_cohorts": _with(
        _TESTS, _CT,
        select="SELECT cohort, num_id, days_since_onset, pcr_result, symp_onset_day, day_of_test FROM ct",
    ),
    "cohort_counts": _with(
        _TESTS, _CT,
        select="SELECT cohort, count(*) AS n_tests, count(DISTINCT num_id) AS n_persons FROM ct GROUP BY cohort",
    ),
    "dense_ids": _with(
        _TESTS, _CT,
        select="""
        SELECT DISTINCT cohort, num_id, dense_rank() OVER (PARTITION BY cohort ORDER BY num_id) AS new_id FROM ct""",
    ),
    "renumber": _with(
        _TESTS, _CT,
        select="""
        SELECT cohort, dense_rank() OVER (PARTITION BY cohort ORDER BY num_id) AS new_id, days_since_onset, pcr_result
        FROM ct""",
    ),
    "subject_onsets": _with(_TESTS, _CT, select="SELECT DISTINCT cohort, num_id, symp_onset_day FROM ct"),
    "infection_bounds": _with(
        _TESTS, _CT, _BOUNDS, select="SELECT cohort, num_id, te_upper_bound, inc_lower_bound FROM bounds"
    ),
    "unplaceable_persons": _with(
        _TESTS, _CT, _BOUNDS,
        select="""
        SELECT cohort, count(*) AS n_persons, count(*) FILTER (WHERE inc_lower_bound >= 30) AS n_unplaceable
        FROM bounds GROUP BY cohort""",
    ),
    "positivity_by_day": _POSITIVITY_SQL,
    "positivity_missing_days": _with(
        _TESTS, _CT, _KNOWN_COUNTS, _interval("known_counts"), select=_POSITIVITY, recursive=True
    ),
    "positivity_many_tests": _with(
        _EVENTS, _EVENT_COUNTS, _interval("counts"), select=_POSITIVITY, recursive=True
    ),
    "person_patterns": _with(
        _TESTS, _CT, _EVENTS, _PATTERNS,
        select="""
        SELECT cohort, bound, entries, count(DISTINCT pattern) AS patterns, count(*) AS persons
        FROM both_persons GROUP BY cohort, bound, entries""",
    ),
    "incubation_grid": _with(
        _TESTS, _CT, _BOUNDS, _grid(SCENARIOS),
        select="SELECT scenario, inc_lower_bound, inc, round(log_w, 9) AS log_w FROM grid",
    ),
    "curve": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, _CURVE, select="SELECT cohort, param_id, k, round(p, 9) AS p FROM curve"
    ),
    "param_logprior": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS,
        select=f"SELECT cohort, param_id, round({_prior()}, 7) AS logprior FROM day_params",
    ),
    "test_loglik": _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _LATTICE,
        f"""
        dated AS (
          SELECT cohort, pcr_result,
                 day_of_test - (te_upper_bound - 0.5::DOUBLE * (1 + num_id % 28)) AS diff
          FROM ct JOIN bounds USING (cohort, num_id)
        ),
        signed AS (
          SELECT cohort, param_id,
                 (CASE WHEN pcr_result THEN 1 ELSE -1 END)
                   * (beta1 + (CASE WHEN diff < cutpoint THEN beta2 ELSE beta3 END)
                              * (diff - cutpoint) * (diff - cutpoint)) AS s
          FROM dated JOIN lattice USING (cohort)
        )""",
        select=f"""
        SELECT cohort, param_id, round(sum({_LOGLIK.format(s='s')}), 6) AS loglik
        FROM signed GROUP BY cohort, param_id""",
    ),
    "marginal_loglik": _loglik(False),
    "marginal_loglik_joint": _loglik(True),
    "posterior_weights": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, _SCORED,
        select="SELECT cohort, param_id, round(weight, 9) AS weight, round(ess, 9) AS ess FROM weights",
    ),
    "resample_draws": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, _SCORED, _COPIES, select="SELECT cohort, draw, param_id FROM resampled"
    ),
    "infection_draws": _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _LATTICE, _grid([BASE]), _person_cells(), _SAMPLED,
        select="SELECT cohort, draw, num_id, round(inf_day, 6) AS inf_day FROM sampled",
    ),
    "infection_day_counts": _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _LATTICE, _grid([BASE]), _person_cells(), _SAMPLED,
        select="""
        SELECT cohort, draw, CAST(day_of_test - round_even(inf_day, 0) AS INT) AS x,
               count(*) FILTER (WHERE pcr_result) AS pos, count(*) AS n
        FROM ct JOIN sampled USING (cohort, num_id) GROUP BY ALL""",
    ),
    "parameter_summary": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, select=_PARAMETER_ROWS.format(source="day_params")
    ),
    "parameter_summary_resampled": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, _SCORED, _COPIES, select=_PARAMETER_ROWS.format(source="resampled")
    ),
    "curve_summary": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, _CURVE, _CURVE_SUMMARY,
        select="""
        SELECT cohort, days_since_infection, round(median, 9) AS median, round(lower_95, 9) AS lower_95,
               round(upper_95, 9) AS upper_95 FROM curve_summary""",
    ),
    "empirical_curve": _with(
        _TESTS, _CT, _BOUNDS, _GIVEN,
        select="""
        SELECT cohort, x, round(top, 9) AS top, round(mean, 9) AS mean, round(bottom, 9) AS bottom FROM empirical""",
    ),
    **{f"panel_{name.lower()}": _panel(name) for name in ("main", "A", "B", "C", "D", "E", "F", "S")},
    "to_long": _with(_TESTS, _CT, _COUNTS, select=_LONG),
    "transpose": _with(_TESTS, _CT, _COUNTS, select=f"SELECT cohort, {_DAYS} FROM counts GROUP BY cohort"),
    "write_summary": _POSITIVITY_SQL,
    "write_draws": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS,
        select="""
        SELECT cohort, param_id, x, n, round(beta1, 9) AS beta1, round(beta2, 9) AS beta2, round(beta3, 9) AS beta3,
               round(cutpoint, 9) AS cutpoint FROM day_params""",
    ),
    "prior_sensitivity": _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _LATTICE, _grid(SCENARIOS), _person_cells(), _PERSON_LOGLIK,
        f"""
        totals AS (SELECT scenario, cohort, param_id, sum(ll) AS loglik FROM person_loglik GROUP BY ALL),
        scored AS (SELECT scenario, cohort, param_id, loglik, loglik + {_prior()} AS log_weight
                   FROM totals JOIN lattice USING (cohort, param_id)),
        raised AS (SELECT *, exp(log_weight - max(log_weight) OVER (PARTITION BY scenario, cohort)) AS raw FROM scored)""",
        select="""
        SELECT scenario, cohort, param_id, round(loglik, 6) AS loglik,
               round(raw / sum(raw) OVER (PARTITION BY scenario, cohort), 6) AS weight FROM raised""",
    ),
    "marginal_loglik_relational": _loglik(False),
    "write_infection_draws": _with(
        _TESTS, _CT, _BOUNDS, _COUNTS, _LATTICE, _grid([BASE]), _person_cells(), _SAMPLED,
        select="SELECT cohort, draw, num_id, round(inf_day, 6) AS inf_day FROM sampled",
    ),
    "tail_shape": _with(
        _TESTS, _CT, _COUNTS, _DAY_PARAMS, _SCORED, _TAIL,
        select="""
        SELECT cohort, rows, possible_rows, round(ess, 6) AS ess, m AS tail_rows, round(tail_shape, 6) AS tail_shape
        FROM sizes LEFT JOIN tails USING (cohort)""",
    ),
    "fit_report": _with(
        *_lattice_parts([BASE]),
        f"""
        person_sizes AS (
          SELECT cohort, num_id, count(*) AS tests, count(pcr_result) AS known FROM ct GROUP BY cohort, num_id
        ),
        losses AS (
          SELECT cohort, sum(tests) AS n_tests, sum(tests - known) AS n_tests_unknown,
                 sum(CASE WHEN inc_lower_bound >= 30 THEN known ELSE 0 END) AS n_tests_unplaceable, count(*) AS n_persons,
                 count(*) FILTER (WHERE inc_lower_bound >= 30) AS n_unplaceable,
                 count(*) FILTER (WHERE known = 0 AND inc_lower_bound < 30) AS n_without_known_test
          FROM person_sizes JOIN bounds USING (cohort, num_id) GROUP BY cohort
        ),
        fitted AS (
          SELECT cohort, count(*) AS rows, count(*) FILTER (WHERE weight > 0) AS possible_rows, max(ess) AS ess
          FROM weighted GROUP BY cohort
        ),
        declared(cohort) AS (VALUES {", ".join(f"('{c.name}')" for c in COHORTS)})""",
        select="""
        SELECT 'base' AS scenario, cohort,
               CAST(coalesce(n_tests, 0) AS BIGINT) AS n_tests, CAST(coalesce(n_tests_unknown, 0) AS BIGINT) AS n_tests_unknown,
               CAST(coalesce(n_tests_unplaceable, 0) AS BIGINT) AS n_tests_unplaceable, coalesce(n_persons, 0) AS n_persons,
               coalesce(n_unplaceable, 0) AS n_unplaceable, coalesce(n_without_known_test, 0) AS n_without_known_test,
               coalesce(rows, 0) AS rows, coalesce(possible_rows, 0) AS possible_rows,
               CASE WHEN rows IS NULL THEN 0 ELSE 2 END::BIGINT AS tail_rows, CASE WHEN rows IS NULL THEN 0 ELSE 1 END::BIGINT AS rounds,
               round(ess, 6) AS ess, round(ess / rows, 6) AS ess_share, CAST(NULL AS DOUBLE) AS tail_shape,
               CASE WHEN rows IS NOT NULL THEN 1.0::DOUBLE END AS power,
               CASE WHEN n_persons IS NULL THEN 'no person' WHEN n_unplaceable = n_persons THEN 'no placeable person'
                    WHEN rows IS NULL THEN 'not fitted' WHEN possible_rows = 0 THEN 'no possible row'
                    WHEN ess / rows < 0.1 THEN 'few effective rows' ELSE 'ok' END AS verdict
        FROM declared LEFT JOIN losses USING (cohort) LEFT JOIN fitted USING (cohort)""",
    ),
    "lattice_parameters": _with(
        *_lattice_parts([BASE]), _drawn(1000), _days_drawn("SELECT cohort, min(num_id) AS num_id FROM bounds GROUP BY cohort"),
        select="""
        SELECT cohort, Parameter, round(quantile_cont(value, 0.5), 7) AS median, round(avg(value), 7) AS mean,
               round(quantile_cont(value, 0.025), 7) AS CI95Low, round(quantile_cont(value, 0.975), 7) AS CI95Up
        FROM (SELECT cohort, cutpoint AS Cutpoint, beta1 AS Beta1, beta2 AS Beta2, beta3 AS Beta3, 30 - inf_day AS Inc1
              FROM drawn JOIN days USING (cohort, draw))
        UNPIVOT (value FOR Parameter IN (Cutpoint, Beta1, Beta2, Beta3, Inc1))
        GROUP BY cohort, Parameter""",
    ),
    "lattice_empirical": _with(
        *_lattice_parts([BASE]), _drawn(100), _days_drawn("SELECT cohort, num_id FROM bounds"), _DRAWN_SHARES,
        select="""
        SELECT cohort, x, round(top, 9) AS top, round(mean, 9) AS mean, round(bottom, 9) AS bottom FROM empirical""",
    ),
    "lattice_panels": _with(
        *_lattice_parts([BASE]), _drawn(100), _days_drawn("SELECT cohort, num_id FROM bounds"), _DRAWN_SHARES,
        _drawn(1000).replace("drawn AS", "many_drawn AS"),
        f"""
        legend(cohort, panel, "group", group_ord) AS (VALUES
          {", ".join(f"('{c.name}', '{c.panel}', '{c.label}', {c.order})" for c in COHORTS)}),
        curve_summary AS (
          SELECT cohort, k / 10.0::DOUBLE AS x, quantile_cont(p, 0.5) AS y, quantile_cont(p, 0.975) AS top,
                 quantile_cont(p, 0.025) AS bottom
          FROM {_points("many_drawn")} GROUP BY cohort, k
        )""",
        select="""
        SELECT panel, "group", group_ord, series, x, round(y, 9) AS y, round(top, 9) AS top, round(bottom, 9) AS bottom
        FROM legend JOIN (
          SELECT cohort, 'curve' AS series, x, y, top, bottom FROM curve_summary
          UNION ALL
          SELECT cohort, 'empirical', CAST(x AS DOUBLE), mean, top, bottom FROM empirical) USING (cohort)""",
    ),
    "scenario_curves": _with(
        *_lattice_parts(SCENARIOS),
        f"""
        running AS (
          SELECT scenario, cohort, k, p,
                 sum(weight) OVER (PARTITION BY scenario, cohort, k ORDER BY p, param_id ROWS UNBOUNDED PRECEDING) AS upto
          FROM {_points("(SELECT * FROM weighted WHERE weight > 0)")}
        )""",
        select="""
        SELECT scenario, cohort, k / 10.0::DOUBLE AS days_since_infection, round(min(p) FILTER (WHERE upto >= 0.5), 9) AS median,
               round(min(p) FILTER (WHERE upto >= 0.025), 9) AS lower_95, round(min(p) FILTER (WHERE upto >= 0.975), 9) AS upper_95
        FROM running GROUP BY scenario, cohort, k""",
    ),
    "check_dictionary": _with(
        _TESTS,
        """
        rules(field, value) AS (VALUES ('pcr_result', 'true'), ('pcr_result', 'false'), ('time_period', 'first'),
          ('time_period', 'second'), ('immunised', 'yes'), ('immunised', 'no'), ('immunised', 'unknown'),
          ('gender', 'male'), ('gender', 'female'), ('age_group', 'under40'), ('age_group', 'over40'),
          ('comorbidities', '1'), ('comorbidities', '0')),
        long AS (
          SELECT field, lower(value) AS value
          FROM (SELECT pcr_result::VARCHAR AS pcr_result, time_period, immunised, gender, age_group,
                       comorbidities::VARCHAR AS comorbidities, ethnicity FROM tests WHERE num_id % 97 <> 0)
          UNPIVOT INCLUDE NULLS (value FOR field IN (pcr_result, time_period, immunised, gender, age_group, comorbidities, ethnicity))
        )""",
        select="""
        SELECT long.field, count(*) AS rows_read, count(*) - count(long.value) AS nulls,
               CASE WHEN long.field <> 'ethnicity' THEN count(long.value) - count(rules.value) ELSE 0 END AS outside,
               (SELECT count(*) FROM rules r WHERE r.field = long.field) AS documented
        FROM long LEFT JOIN rules ON long.field = rules.field AND long.value = rules.value GROUP BY long.field""",
    ),
    "rejected_lines": _with(
        _TESTS,
        select="""
        SELECT 'no number in num_id' AS reason, count(*) AS lines FROM tests WHERE num_id % 97 = 0 HAVING count(*) > 0
        UNION ALL
        SELECT 'unreadable days_since_onset', count(*) FROM tests WHERE num_id % 97 <> 0 AND num_id % 89 = 0 HAVING count(*) > 0""",
    ),
}
