"""Bootstrap queries (I1-I4) with oracles that repeat the same draws in SQL, one row per draw."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.operators import resample as R
from textjudge.operators.resample import INCREMENT, MASK, MULTIPLIER, SECOND
from textjudge.plans.queries_scores import latest_faith, latest_fluency, with_size
from textjudge.plans.queries_votes import scored_votes
from textjudge.plans.registry import helper, query
from textjudge.plans.views import Tables

# the study default of 10,000 resamples is a parameter
SAMPLES = 200
SEED = fixed.BOOTSTRAP_SEED
_M = [f"{k}_{x.lower()}" for x in fixed.LABELS for k in ("num", "den")]


def _mixed(x: str) -> str:
    """The mixing steps of one 32-bit number, over a column name."""
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {MULTIPLIER}) & {MASK})"
    return f"xor({x}, {x} >> 16)"


def _draws(name: str, source: str, group: list[str], measures: list[str], cell: str = "''") -> None:
    """Register the oracle relations of one bootstrap: <name>_n and <name>_reps.

    One row per draw, for groups that fit one bucket; tests cover the tree above buckets.
    """
    g, item = ", ".join(group), "dataset, variant, eid"
    helper(f"{name}_cells", f"SELECT {g}, {item}, {cell} AS cell, {', '.join(f'sum({m}) AS {m}' for m in measures)} FROM {source} GROUP BY ALL")
    helper(f"{name}_k", f"""SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY @DRAW(concat_ws('|', '{SEED}', {item})), {item}) - 1 AS place
      FROM (SELECT DISTINCT {g}, {item} FROM {name}_cells) k""")
    helper(f"{name}_n", f"SELECT {g}, count(*) AS n FROM {name}_k GROUP BY ALL")
    helper(f"{name}_s", f"""SELECT {g}, n, rep, {_mixed('a')} AS s, {_mixed('b')} AS t FROM (
      SELECT *, ((key & {MASK}) + (rep + 1) * {INCREMENT}) & {MASK} AS a, ((key >> 28) + (rep + 1) * {SECOND}) & {MASK} AS b
      FROM (SELECT *, @DRAW(concat_ws('|', '{SEED}', {g}, '0')) AS key FROM {name}_n) k, range(0, {SAMPLES}) r(rep)) x""")
    helper(f"{name}_w", f"""SELECT {g}, rep, (z * n) >> 32 AS place, count(*) AS w FROM (SELECT *, {_mixed('y')} AS z FROM (
      SELECT *, ({_mixed('x')} + t) & {MASK} AS y FROM (
        SELECT *, (s + (j + 1) * {INCREMENT}) & {MASK} AS x FROM (SELECT *, unnest(range(0, n)) AS j FROM {name}_s) a) b) c) d GROUP BY ALL""")
    helper(f"{name}_reps", f"""SELECT {g}, rep, cell, {", ".join(f"sum({m} * w) AS {m}" for m in measures)}
      FROM {name}_w JOIN {name}_k USING ({g}, place) JOIN {name}_cells USING ({g}, {item}) GROUP BY {g}, rep, cell""")


def _q(values: str, q: str) -> str:
    at = f"((len({values}) - 1) * {q}::DOUBLE)"
    a, b = f"{values}[floor({at})::INT + 1]", f"{values}[ceil({at})::INT + 1]"
    return f"({a} + ({b} - {a}) * ({at} - floor({at})))"


helper("o_boot_rows", """SELECT 'faithfulness' AS metric, model, dataset, variant, eid, score AS num, 1 AS den FROM v_latest_faith
  UNION ALL SELECT 'fluency', model, dataset, variant, eid, score, 1 FROM v_latest_fluency""")
_draws("o_boot", "o_boot_rows", ["metric", "model"], ["num", "den"])


@query("bootstrap_model_ci", f"""SELECT metric, model, source_item_clusters, judged_rows, mean_score, ci_95_low, ci_95_high,
  greatest(mean_score - ci_95_low, ci_95_high - mean_score) AS ci_95_half_width FROM (
  SELECT metric, model, {_q('vs', '0.025')} AS ci_95_low, {_q('vs', '0.975')} AS ci_95_high FROM (
    SELECT metric, model, list(v ORDER BY v) AS vs FROM (SELECT metric, model, num::DOUBLE / den AS v FROM o_boot_reps) a GROUP BY ALL) b) c
  JOIN (SELECT metric, model, count(DISTINCT (dataset, variant, eid)) AS source_item_clusters, count(*) AS judged_rows,
    avg(num) AS mean_score FROM o_boot_rows GROUP BY ALL) d USING (metric, model)""")
def bootstrap_model_ci(t: Tables):
    cols = ["model", "dataset", "variant", "eid", "score"]
    both = (
        latest_faith(t).select(F.lit("faithfulness").alias("metric"), *cols)
        .unionByName(latest_fluency(t).select(F.lit("fluency").alias("metric"), *cols))
    )
    return R.model_intervals(both, ["metric", "model"], samples=SAMPLES)


_UNITS = ", ".join(f"score * u_{x.lower()} AS num_{x.lower()}, u_{x.lower()} AS den_{x.lower()}" for x in fixed.LABELS)
helper("o_size_rows", f"SELECT size_group, model, dataset, variant, eid, {_UNITS} FROM o_soft JOIN o_size USING (model)")
_draws("o_size_boot", "o_size_rows", ["size_group"], _M)
helper("o_size_obs", f"""SELECT size_group, count(DISTINCT (dataset, variant, eid)) AS source_item_clusters,
  {", ".join(f"sum({m})::BIGINT AS {m}" for m in _M)} FROM o_size_rows GROUP BY size_group""")


def perceived(t: Tables):
    return R.PerceivedBootstrap(with_size(scored_votes(t)), samples=SAMPLES)


@query("bootstrap_perceived_ci", " UNION ALL ".join(f"""SELECT size_group, source_item_clusters, '{x}' AS predicted_label,
  num_{x.lower()}::DOUBLE / den_{x.lower()} AS mean_score, {_q('vs', '0.025')} AS ci_95_low, {_q('vs', '0.975')} AS ci_95_high,
  den_{x.lower()}::DOUBLE / 60 AS effective_count FROM o_size_obs JOIN (
    SELECT size_group, list(v ORDER BY v) AS vs FROM (SELECT size_group, num_{x.lower()}::DOUBLE / den_{x.lower()} AS v FROM o_size_boot_reps) a
    GROUP BY size_group) b USING (size_group)""" for x in fixed.LABELS))
def bootstrap_perceived_ci(t: Tables):
    return perceived(t).means()


_TAIL = repr(fixed.FAMILY_ALPHA / (2 * fixed.PLANNED_COMPARISONS))
_HEAD = repr(1 - fixed.FAMILY_ALPHA / (2 * fixed.PLANNED_COMPARISONS))


def _ratio(x: str) -> str:
    return f"num_{x}::DOUBLE / den_{x}"


@query("bootstrap_contrasts", "SELECT *, familywise_low > 0 OR familywise_high < 0 AS significant_familywise FROM (" + " UNION ALL ".join(
    f"""SELECT size_group, source_item_clusters, '{x.upper()} - CFA' AS comparison, {_ratio(x)} - {_ratio('cfa')} AS mean_difference,
    {_q('vs', '0.025')} AS ci_95_low, {_q('vs', '0.975')} AS ci_95_high, {_q('vs', _TAIL)} AS familywise_low, {_q('vs', _HEAD)} AS familywise_high
    FROM o_size_obs JOIN (SELECT size_group, list(v ORDER BY v) AS vs FROM (
      SELECT size_group, {_ratio(x)} - {_ratio('cfa')} AS v FROM o_size_boot_reps) a GROUP BY size_group) b USING (size_group)"""
    for x in ("fa", "fi")) + ") u")
def bootstrap_contrasts(t: Tables):
    return perceived(t).contrasts()


helper("o_true_rows", f"SELECT expected AS true_label, model, dataset, variant, eid, {_UNITS} FROM o_soft")
_draws("o_true_boot", "o_true_rows", ["true_label"], _M, cell="model")


@query("bootstrap_true_perceived", " UNION ALL ".join(f"""SELECT true_label, '{x}' AS predicted_label, source_item_clusters,
  {_q('vs', '0.025')} AS ci_95_low, {_q('vs', '0.975')} AS ci_95_high FROM (
    SELECT true_label, list(v ORDER BY v) AS vs FROM (
      SELECT true_label, rep, list_reduce(list_prepend(0.0::DOUBLE, list(r ORDER BY cell)), lambda a, b: a + b) / count(*) AS v
      FROM (SELECT true_label, rep, cell, num_{x.lower()}::DOUBLE / nullif(den_{x.lower()}, 0) AS r FROM o_true_boot_reps) q
      WHERE r IS NOT NULL GROUP BY true_label, rep) a GROUP BY true_label) b
  JOIN (SELECT true_label, n AS source_item_clusters FROM o_true_boot_n) c USING (true_label)""" for x in fixed.LABELS))
def bootstrap_true_perceived(t: Tables):
    return R.macro_intervals(scored_votes(t), samples=SAMPLES)
