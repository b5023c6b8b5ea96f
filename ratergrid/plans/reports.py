"""Report tables: rounded as printed, every value also derived in SQL from the raw scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid.operators import reports as R
from ratergrid.operators.agreement import contingency, pair_metrics, spearman_rho
from ratergrid.operators.alignment import common_core, pattern_counts, study_pairs, study_subsets
from ratergrid.plans.alignment import STUDY
from ratergrid.plans.fixtures import (ALL_CONDITIONS, BASELINE, CONDITIONS, DOC_RATERS, HUMANS,
                                      MODELS, condition_patterns, doc_patterns, line_grid)
from ratergrid.plans.registry import (alpha_ctes, p_ctes, pair_ctes, printed, query, r6, scaled,
                                      with_ctes)
from ratergrid.schemas import SCORE_COLS
from ratergrid.session import stored

FIRST, SECOND = "neutral", "extreme_rep"
BY = ["rater_a", "rater_b", "variable"]
PEOPLE, MACHINES = ALL_CONDITIONS[:2], ALL_CONDITIONS[2:]
PAIRS = study_pairs(PEOPLE, MACHINES)
GROUPS = {"all": ALL_CONDITIONS, "models": MACHINES, "humans": PEOPLE}

_STATS = {**pair_ctes("fx_condition_pairs", BY), **p_ctes("st", BY)}
_PAIR_ALPHA = {
    "pair_rows": "SELECT rater_a, rater_b, variable, unit_id, a AS score FROM fx_condition_pairs UNION ALL "
                 "SELECT rater_a, rater_b, variable, unit_id, b FROM fx_condition_pairs",
    **alpha_ctes("pair_rows", BY)}
_ALL = {**_STATS, **_PAIR_ALPHA,
        "every": "SELECT st.*, pv.p, al.alpha FROM st JOIN pv ON pv.rater_a = st.rater_a AND pv.rater_b = st.rater_b "
                 "AND pv.variable = st.variable JOIN al ON al.rater_a = st.rater_a AND al.rater_b = st.rater_b "
                 "AND al.variable = st.variable"}
_ONE = f"WHERE rater_a = '{FIRST}' AND rater_b = '{SECOND}'"


@query("intra_rater_table", with_ctes(_ALL, f"""SELECT variable, {scaled('alpha')} AS krippendorff_alpha,
  {scaled('rho')} AS spearman_rho, {scaled('p', 4)} AS spearman_p, {printed('mad')} AS mad, {printed('msd')} AS mean_drift,
  {printed('pct_exact')} AS pct_exact_agree FROM every {_ONE}"""))
def _(spark, sf):
    return R.intra_rater_table(condition_patterns(spark, sf), FIRST, SECOND)


_PAIR_ROWS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIRS, 1))


@query("inter_rater_table", with_ctes(_STATS, f"""SELECT CAST(o.ord AS INT) AS pair_ord, st.rater_a, st.rater_b,
  CONCAT(st.rater_a, ' vs ', st.rater_b) AS pairing, st.variable, {scaled('rho')} AS spearman_rho,
  {scaled('p', 4)} AS spearman_p, {printed('mad')} AS mad FROM st JOIN pv ON pv.rater_a = st.rater_a
  AND pv.rater_b = st.rater_b AND pv.variable = st.variable JOIN (VALUES {_PAIR_ROWS}) AS o(ord, rater_a, rater_b)
  ON o.rater_a = st.rater_a AND o.rater_b = st.rater_b"""))
def _(spark, sf):
    return R.inter_rater_table(condition_patterns(spark, sf), PAIRS)


_CORE = {
    "core_keys": "SELECT unit_id, variable FROM fx_ratings WHERE rater IN ('L1', 'L2', 'L3', 'L4', 'L5') "
                 "GROUP BY unit_id, variable HAVING COUNT(DISTINCT rater) = 5",
    "core_pairs": "SELECT p.rater_a, p.rater_b, p.variable, p.unit_id, p.a, p.b FROM fx_pairs p JOIN core_keys c "
                  "ON c.unit_id = p.unit_id AND c.variable = p.variable WHERE p.rater_b <= 'L5'",
    **pair_ctes("core_pairs", BY), **p_ctes("st", BY)}
_LINE_PAIRS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(study_pairs(HUMANS, MODELS), 1))


@query("inter_rater_core", with_ctes(_CORE, f"""SELECT CAST(o.ord AS INT) AS pair_ord, st.rater_a, st.rater_b,
  CONCAT(st.rater_a, ' vs ', st.rater_b) AS pairing, st.variable, {scaled('rho')} AS spearman_rho,
  {scaled('p', 4)} AS spearman_p, {printed('mad')} AS mad FROM st JOIN pv ON pv.rater_a = st.rater_a
  AND pv.rater_b = st.rater_b AND pv.variable = st.variable JOIN (VALUES {_LINE_PAIRS}) AS o(ord, rater_a, rater_b)
  ON o.rater_a = st.rater_a AND o.rater_b = st.rater_b"""))
def _(spark, sf):
    """Two humans and three models on the units all five rated, after validity and dedupe."""
    patterns = pattern_counts(common_core(line_grid(spark, sf, STUDY), STUDY), STUDY)
    return R.inter_rater_table(patterns, study_pairs(HUMANS, MODELS))


_SUBSETS = study_subsets(PEOPLE, MACHINES)
_SUBSET_SQL = {
    "subset_rows": "SELECT s.subset, r.variable, r.unit_id, r.score FROM fx_conditions r JOIN (VALUES " + ", ".join(
        f"('{s}', '{r}')" for s, rs in _SUBSETS.items() for r in rs) + ") AS s(subset, rater) ON s.rater = r.condition",
    **alpha_ctes("subset_rows", ["subset", "variable"])}


@query("alpha_subset_table", with_ctes(_SUBSET_SQL, "SELECT subset, " + ", ".join(
    f"{scaled(f'MAX(CASE WHEN variable = {chr(39)}{v}{chr(39)} THEN alpha END)')} AS {v}" for v in SCORE_COLS) +
    " FROM al GROUP BY subset"))
def _(spark, sf):
    return R.alpha_subset_table(condition_patterns(spark, sf), _SUBSETS)


def _pivot_sql(value: str, wrap=r6) -> str:
    return ", ".join(wrap(f"MAX(CASE WHEN variable = '{v}' THEN {value} END)") + f" AS {v}" for v in SCORE_COLS)


@query("pivot_metric", with_ctes(_STATS, f"""SELECT CONCAT(rater_a, ' vs ', rater_b) AS pairing, {_pivot_sql('rho')}
  FROM st GROUP BY rater_a, rater_b"""))
def _(spark, sf):
    rho = spearman_rho(contingency(condition_patterns(spark, sf), PAIRS))
    pairing = F.concat_ws(" vs ", "rater_a", "rater_b").alias("pairing")
    return R.pivot_metric(rho.select(pairing, "variable", "rho"), "pairing", "rho")


@query("stability_table", with_ctes(_ALL, f"""SELECT variable, {scaled('rho')} AS spearman_rho, {scaled('p', 4)} AS p_value,
  {scaled('alpha')} AS krippendorff_alpha, {printed('mad')} AS mad, {printed('pct_exact')} AS pct_exact_agree,
  CASE WHEN rho > 0.80 THEN 'Stable' WHEN rho > 0.60 THEN 'Acceptable' ELSE 'Unstable' END AS verdict,
  CASE WHEN alpha IS NULL THEN 'n/a' WHEN alpha >= 0.80 THEN 'reliable' WHEN alpha >= 0.67 THEN 'tentative'
  ELSE 'below' END AS alpha_zone FROM every {_ONE}"""))
def _(spark, sf):
    return R.stability_table(condition_patterns(spark, sf), FIRST, SECOND)


_FRAMING = {**pair_ctes("fx_condition_pairs", BY), **_PAIR_ALPHA,
            "framing": "SELECT st.rater_b AS condition, st.variable, -st.msd AS drift, st.rho, al.alpha FROM st JOIN al "
                       "ON al.rater_a = st.rater_a AND al.rater_b = st.rater_b AND al.variable = st.variable "
                       "WHERE st.rater_a = 'neutral'"}


def _metrics(spark, sf):
    return R.framing_metrics(condition_patterns(spark, sf), BASELINE, CONDITIONS)


def _summary_sql(value: str, mean: str, wrap) -> str:
    rounded = {**_FRAMING, "shown": f"SELECT condition, variable, {wrap(value)} AS x FROM framing"}
    return with_ctes(rounded, f"""SELECT condition, {_pivot_sql('x', lambda e: e)},
  {scaled('CASE WHEN COUNT(x) = 8 THEN AVG(x) END' if value != 'alpha' else 'AVG(x)')} AS {mean} FROM shown GROUP BY condition""")


@query("framing_drift_summary", _summary_sql("drift", "mean_drift", printed))
def _(spark, sf):
    return R.framing_drift_summary(_metrics(spark, sf))


@query("framing_rho_summary", _summary_sql("rho", "mean_rho", scaled))
def _(spark, sf):
    return R.framing_rho_summary(_metrics(spark, sf))


@query("framing_alpha_summary", _summary_sql("alpha", "mean_alpha", scaled))
def _(spark, sf):
    return R.framing_alpha_summary(_metrics(spark, sf))


@query("abs_drift_vs_rho", with_ctes(_FRAMING, f"""SELECT condition, variable, {r6('rho')} AS rho, {r6('ABS(drift)')} AS abs_drift
  FROM framing"""))
def _(spark, sf):
    return R.abs_drift_vs_rho(_metrics(spark, sf))


@query("rho_vs_exact", with_ctes({**pair_ctes("fx_condition_pairs", BY),
    "low": "SELECT variable, AVG(CASE WHEN score = 1 THEN 1 ELSE 0 END) > 0.9 AS low_variance FROM fx_conditions "
           f"WHERE condition = '{FIRST}' GROUP BY variable"},
    f"""SELECT st.variable, {r6('rho')} AS rho, {r6('pct_exact')} AS pct_exact, low_variance FROM st JOIN low
  ON low.variable = st.variable {_ONE}"""))
def _(spark, sf):
    return R.rho_vs_exact(stored(condition_patterns(spark, sf), "patterns"), FIRST, SECOND)


_GROUP_SQL = {
    "group_rows": "SELECT s.subset, r.variable, r.unit_id, r.score FROM fx_conditions r JOIN (VALUES " + ", ".join(
        f"('{s}', '{r}')" for s, rs in GROUPS.items() for r in rs) + ") AS s(subset, rater) ON s.rater = r.condition",
    **alpha_ctes("group_rows", ["subset", "variable"]), **pair_ctes("fx_condition_pairs", BY),
    "low": f"SELECT variable, AVG(CASE WHEN score = 1 THEN 1 ELSE 0 END) > 0.9 AS floor_effect FROM fx_conditions "
           f"WHERE condition = '{PEOPLE[0]}' GROUP BY variable"}


@query("reliability_summary", with_ctes(_GROUP_SQL, f"""SELECT st.variable, {scaled('st.rho')} AS rho, {printed('st.mad')} AS mad,
  {printed('st.msd')} AS msd, {scaled('x.alpha')} AS alpha_all, {scaled('y.alpha')} AS alpha_models,
  {scaled('z.alpha')} AS alpha_humans, low.floor_effect FROM st JOIN low ON low.variable = st.variable
  LEFT JOIN al x ON x.variable = st.variable AND x.subset = 'all'
  LEFT JOIN al y ON y.variable = st.variable AND y.subset = 'models'
  LEFT JOIN al z ON z.variable = st.variable AND z.subset = 'humans'
  WHERE st.rater_a = '{PEOPLE[0]}' AND st.rater_b = '{PEOPLE[1]}'"""))
def _(spark, sf):
    return R.reliability_summary(stored(condition_patterns(spark, sf), "patterns"), *PEOPLE, GROUPS)


_DOC_PAIRS = {"doc_pairs": "SELECT x.rater AS rater_a, y.rater AS rater_b, x.variable, x.unit_id, x.score AS a, "
                           "y.score AS b FROM fx_docs x JOIN fx_docs y ON x.unit_id = y.unit_id AND x.ord < y.ord",
              **pair_ctes("doc_pairs", BY),
              "both_ways": "SELECT rater_a AS r, rater_b AS c, rho FROM st UNION ALL SELECT rater_b, rater_a, rho FROM st "
                           "UNION ALL SELECT DISTINCT rater, rater, 1.0 FROM fx_docs",
              "ords": "SELECT DISTINCT rater, ord FROM fx_docs"}


def _matrix_sql(lower: bool) -> str:
    keep = "AND o.ord >= q.ord" if lower else ""
    cells = ", ".join(r6(f"MAX(CASE WHEN c = '{r}' {keep} THEN rho END)") + f" AS {r}" for r in DOC_RATERS)
    return with_ctes(_DOC_PAIRS, f"""SELECT 'V1' AS variable, r AS "row", {cells} FROM both_ways b
  JOIN ords o ON o.rater = b.r JOIN ords q ON q.rater = b.c GROUP BY r""")


@query("agreement_matrix", _matrix_sql(False))
def _(spark, sf):
    m = pair_metrics(contingency(doc_patterns(spark, sf), study_pairs(DOC_RATERS, [])))
    return R.agreement_matrix(m, DOC_RATERS)


@query("agreement_matrix_lower", _matrix_sql(True))
def _(spark, sf):
    m = pair_metrics(contingency(doc_patterns(spark, sf), study_pairs(DOC_RATERS, [])))
    return R.agreement_matrix(m, DOC_RATERS, lower_only=True)


@query("metric_lookup", with_ctes(pair_ctes("fx_condition_pairs", BY), f"""SELECT w.rater_a, w.rater_b, w.variable, {r6('rho')} AS rho
  FROM (VALUES ('neutral', 'extreme_rep', 'V1'), ('neutral', 'extreme_dem', 'V8'), ('neutral', 'absent', 'V1'))
  AS w(rater_a, rater_b, variable) LEFT JOIN st ON st.rater_a = w.rater_a AND st.rater_b = w.rater_b
  AND st.variable = w.variable"""))
def _(spark, sf):
    wanted = [("neutral", "extreme_rep", "V1"), ("neutral", "extreme_dem", "V8"), ("neutral", "absent", "V1")]
    return R.metric_lookup(spearman_rho(contingency(condition_patterns(spark, sf), PAIRS)), wanted, "rho")
