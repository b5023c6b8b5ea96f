"""Agreement statistics over ratings with repeated keys and missing raters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid.functions.text import format_metric
from ratergrid.functions.verdicts import agreement_zone, drift_direction, stability_verdict
from ratergrid.operators import agreement as A, alignment as L
from ratergrid.operators.hygiene import latest_scores, melt_scores, validity_filter
from ratergrid.operators.reports import minmax_scale
from ratergrid.plans.alignment import STUDY, SUBSETS
from ratergrid.plans.fixtures import (ALL_CONDITIONS, DOC_RATERS, LATEST, LINE_VARS, RATERS,
                                      condition_patterns, doc_patterns, doc_ratings, line_grid, line_patterns,
                                      line_ratings, table)
from ratergrid.plans.registry import alpha_ctes, p_ctes, pair_ctes, query, r6, with_ctes

PAIRS = L.rater_pairs(RATERS)
BY = ["rater_a", "rater_b", "variable"]
_PAIR_STATS = pair_ctes("fx_pairs", BY)
_CONDITION_STATS = pair_ctes("fx_condition_pairs", BY)
_DOC_PAIRS = {"doc_pairs": "SELECT x.rater AS rater_a, y.rater AS rater_b, x.variable, x.unit_id, x.score AS a, "
                           "y.score AS b FROM fx_docs x JOIN fx_docs y ON x.unit_id = y.unit_id AND x.ord < y.ord",
              **pair_ctes("doc_pairs", BY)}


def _table(spark, sf):
    return A.contingency(line_patterns(spark, sf), PAIRS)


@query("contingency", with_ctes({}, """SELECT rater_a, rater_b, variable, a, b, COUNT(*) AS n FROM fx_pairs
  GROUP BY rater_a, rater_b, variable, a, b"""))
def _(spark, sf):
    return _table(spark, sf)


@query("contingency_of", """SELECT quality AS a, toxic AS b, COUNT(*) AS n, 'label' AS variable FROM labels
  GROUP BY quality, toxic""")
def _(spark, sf):
    pairs = table(spark, sf, "labels").select(F.lit("label").alias("variable"), F.col("quality").alias("a"),
                                              F.col("toxic").alias("b"))
    return A.contingency_of(pairs, ["variable"])


@query("mad", with_ctes({}, f"""SELECT rater_a, rater_b, variable, {r6('AVG(ABS(a - b))')} AS mad FROM fx_pairs
  GROUP BY rater_a, rater_b, variable"""))
def _(spark, sf):
    return A.mad(_table(spark, sf))


@query("msd", with_ctes({}, f"""SELECT rater_a, rater_b, variable, {r6('AVG(a - b)')} AS msd FROM fx_pairs
  GROUP BY rater_a, rater_b, variable"""))
def _(spark, sf):
    return A.msd(_table(spark, sf))


@query("pct_exact", with_ctes({}, f"""SELECT rater_a, rater_b, variable,
  {r6('AVG(CASE WHEN a = b THEN 1 ELSE 0 END)')} AS pct_exact FROM fx_pairs GROUP BY rater_a, rater_b, variable"""))
def _(spark, sf):
    return A.pct_exact(_table(spark, sf))


@query("agreement_breakdown", with_ctes({}, "SELECT rater_a, rater_b, variable, COUNT(*) AS n, " + ", ".join(
    f"COUNT(CASE WHEN ABS(a - b) = {k} THEN 1 END) AS n_diff{k}, "
    f"{r6(f'AVG(CASE WHEN ABS(a - b) = {k} THEN 1 ELSE 0 END)')} AS p_diff{k}" for k in range(3)) +
    " FROM fx_pairs GROUP BY rater_a, rater_b, variable"))
def _(spark, sf):
    return A.agreement_breakdown(_table(spark, sf))


@query("spearman_rho", with_ctes(_PAIR_STATS, f"SELECT rater_a, rater_b, variable, n, {r6('rho')} AS rho FROM st"))
def _(spark, sf):
    return A.spearman_rho(_table(spark, sf))


@query("spearman_rho_constant", with_ctes(_DOC_PAIRS, f"SELECT rater_a, rater_b, variable, n, {r6('rho')} AS rho FROM st"))
def _(spark, sf):
    """One rater never varies: its correlations are undefined."""
    return A.spearman_rho(A.contingency(doc_patterns(spark, sf), L.rater_pairs(DOC_RATERS)))


@query("spearman_p", with_ctes({**_PAIR_STATS, **p_ctes("st", BY)}, f"""SELECT x.rater_a, x.rater_b, x.variable, x.n,
  {r6('x.rho')} AS rho, {r6('y.p')} AS p FROM st x JOIN pv y ON y.rater_a = x.rater_a AND y.rater_b = x.rater_b
  AND y.variable = x.variable"""))
def _(spark, sf):
    return A.with_p_value(A.spearman_rho(_table(spark, sf)))


PAIR_ALPHA = {
    "pair_rows": "SELECT rater_a, rater_b, variable, unit_id, a AS score FROM fx_pairs UNION ALL "
                 "SELECT rater_a, rater_b, variable, unit_id, b FROM fx_pairs",
    **alpha_ctes("pair_rows", BY),
}


@query("pair_metrics", with_ctes({**_PAIR_STATS, **PAIR_ALPHA}, f"""SELECT x.rater_a, x.rater_b, x.variable, x.n,
  {r6('x.rho')} AS rho, {r6('x.mad')} AS mad, {r6('x.msd')} AS msd, {r6('x.pct_exact')} AS pct_exact,
  {r6('y.alpha')} AS alpha FROM st x JOIN al y ON y.rater_a = x.rater_a AND y.rater_b = x.rater_b
  AND y.variable = x.variable"""))
def _(spark, sf):
    return A.pair_metrics(_table(spark, sf))


MANY = [f"S{i:02d}" for i in range(20)]
_MANY_SQL = {
    "many": """SELECT unit_id, rater, MAX(score) AS score FROM (SELECT CAST(l_orderkey AS VARCHAR) AS unit_id,
  CONCAT('S', LPAD(CAST(l_suppkey % 20 AS VARCHAR), 2, '0')) AS rater, CASE WHEN l_quantity <= 16 THEN 1 WHEN l_quantity <= 33
  THEN 2 ELSE 3 END AS score FROM lineitem) q GROUP BY unit_id, rater""",
    "many_pairs": """SELECT x.rater AS rater_a, y.rater AS rater_b, 'V1' AS variable, x.score AS a, y.score AS b
  FROM many x JOIN many y ON y.unit_id = x.unit_id AND x.rater < y.rater""",
    **pair_ctes("many_pairs", BY)}


@query("pair_metrics_many", with_ctes(_MANY_SQL, f"""SELECT rater_a, rater_b, variable, n, {r6('rho')} AS rho,
  {r6('mad')} AS mad, {r6('pct_exact')} AS pct_exact FROM st"""))
def _(spark, sf):
    """Twenty raters, 190 pairs; of a rater's repeated scores of a unit the highest counts."""
    rater = F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0"))
    score = F.when(F.col("l_quantity") <= 16, 1).when(F.col("l_quantity") <= 33, 2).otherwise(3)
    ratings = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("unit_id"), F.lit("V1").alias("variable"), rater.alias("rater"),
        score.alias("score"))
    counts = A.contingency_dense(L.score_grid(ratings, MANY), MANY)
    return A.pair_metrics(counts).select(*BY, "n", "rho", "mad", "pct_exact")


_ALPHA = alpha_ctes("fx_ratings", ["variable"])
_ALPHA_SELECT = f"SELECT variable, n_units, n_ratings, {r6('alpha')} AS alpha FROM al"


@query("krippendorff_alpha_ordinal", with_ctes(_ALPHA, _ALPHA_SELECT))
def _(spark, sf):
    """Any number of raters: no rater list is needed."""
    valid = validity_filter(line_ratings(spark, sf), LINE_VARS)
    latest = latest_scores(valid, ["unit_id", "rater"], LATEST, LINE_VARS)
    return A.krippendorff_alpha(A.unit_profiles_wide(latest, LINE_VARS))


@query("krippendorff_alpha_long", with_ctes(_ALPHA, _ALPHA_SELECT))
def _(spark, sf):
    """The same statistic from long ratings."""
    valid = validity_filter(line_ratings(spark, sf), LINE_VARS)
    latest = latest_scores(valid, ["unit_id", "rater"], LATEST, LINE_VARS)
    return A.krippendorff_alpha(A.unit_profiles(melt_scores(latest, LINE_VARS)))


_CONSTANT = "SELECT unit_id, variable, score FROM fx_docs WHERE rater = 'r_const'"


@query("krippendorff_alpha_constant", with_ctes(
    {"ones": f"{_CONSTANT} UNION ALL {_CONSTANT}", **alpha_ctes("ones", ["variable"])}, _ALPHA_SELECT))
def _(spark, sf):
    """A single value in the domain: alpha is undefined."""
    docs = doc_ratings(spark, sf).select("unit_id", F.col("r_const").alias("first"), F.col("r_const").alias("second"))
    ratings = docs.unpivot(["unit_id"], ["first", "second"], "rater", "score").withColumn("variable", F.lit("V1"))
    return A.krippendorff_alpha(A.unit_profiles(ratings))


_SUBSET_ROWS = ", ".join(f"('{s}', '{r}')" for s, rs in SUBSETS.items() for r in rs)
SUBSET_ALPHA = {"subset_rows": "SELECT s.subset, r.variable, r.unit_id, r.score FROM fx_ratings r JOIN (VALUES "
                               f"{_SUBSET_ROWS}) AS s(subset, rater) ON s.rater = r.rater",
                **alpha_ctes("subset_rows", ["subset", "variable"])}


@query("alpha_by_subset", with_ctes(SUBSET_ALPHA, f"""SELECT subset, variable, n_units, n_ratings, {r6('alpha')} AS alpha FROM al"""))
def _(spark, sf):
    return A.alpha_by_subset(L.pattern_counts(line_grid(spark, sf, STUDY), STUDY), SUBSETS)


# -------------------------------------------------------------------------- labels of statistics

_ZONE = ("CASE WHEN {x} IS NULL THEN 'n/a' WHEN {x} >= 0.80 THEN 'reliable' WHEN {x} >= 0.67 THEN 'tentative' "
         "ELSE 'below' END")


@query("agreement_zone", with_ctes(_DOC_PAIRS, f"SELECT rater_a, rater_b, {_ZONE.format(x='rho')} AS zone FROM st"))
def _(spark, sf):
    rho = A.spearman_rho(A.contingency(doc_patterns(spark, sf), L.rater_pairs(DOC_RATERS)))
    return rho.select("rater_a", "rater_b", agreement_zone(F.col("rho")).alias("zone"))


@query("stability_verdict", with_ctes(_DOC_PAIRS, """SELECT rater_a, rater_b, CASE WHEN rho > 0.80 THEN 'Stable'
  WHEN rho > 0.60 THEN 'Acceptable' ELSE 'Unstable' END AS verdict FROM st"""))
def _(spark, sf):
    rho = A.spearman_rho(A.contingency(doc_patterns(spark, sf), L.rater_pairs(DOC_RATERS)))
    return rho.select("rater_a", "rater_b", stability_verdict(F.col("rho")).alias("verdict"))


@query("drift_direction", with_ctes(_CONDITION_STATS, f"""SELECT rater_a, rater_b, variable, {r6('msd')} AS msd,
  CASE WHEN msd > 0 THEN 'positive' WHEN msd < 0 THEN 'negative' ELSE 'same' END AS sign,
  CASE WHEN msd > 0.01 THEN 'positive' WHEN msd < -0.01 THEN 'negative' ELSE 'same' END AS direction FROM st"""))
def _(spark, sf):
    drift = A.msd(A.contingency(condition_patterns(spark, sf), L.rater_pairs(ALL_CONDITIONS)))
    return drift.select(*BY, "msd", drift_direction(F.col("msd")).alias("sign"),
                        drift_direction(F.col("msd"), 0.01).alias("direction"))


@query("minmax_scale", with_ctes(_CONDITION_STATS, f"""SELECT variable, {r6('mad')} AS mad,
  {r6('60 + 220 * (mad - MIN(mad) OVER ()) / (MAX(mad) OVER () - MIN(mad) OVER () + 1e-9)')} AS dot_size
  FROM st WHERE rater_a = 'neutral' AND rater_b = 'extreme_rep'"""))
def _(spark, sf):
    mad = A.mad(A.contingency(condition_patterns(spark, sf), [("neutral", "extreme_rep")]))
    return minmax_scale(mad.select("variable", "mad"), "mad", "dot_size", 60.0, 220.0)


@query("format_metric", with_ctes(_DOC_PAIRS, """SELECT rater_a, rater_b, COALESCE(PRINTF('%.2f', CAST(rho AS DOUBLE)), 'n/a') AS rho_text
  FROM st"""))
def _(spark, sf):
    rho = A.spearman_rho(A.contingency(doc_patterns(spark, sf), L.rater_pairs(DOC_RATERS)))
    return rho.select("rater_a", "rater_b", format_metric(F.col("rho")).alias("rho_text"))
