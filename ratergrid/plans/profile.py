"""Descriptive profiles of posts, scores, totals and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid.operators import disagreement as D, profile as R
from ratergrid.operators.agreement import contingency
from ratergrid.operators.alignment import grid_to_ratings
from ratergrid.operators.posts import classify_engagement
from ratergrid.plans.fixtures import (DOC_RATERS, RATERS, condition_annotations, condition_patterns,
                                      doc_patterns, line_grid, line_ratings, posts, table)
from ratergrid.plans.registry import query, r6, with_ctes
from ratergrid.schemas import SCORE_COLS
from ratergrid.session import stored

FIRST, SECOND = "neutral", "extreme_rep"


@query("value_counts", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return R.value_counts(table(spark, sf, "events"), "event_type")


@query("tier_composition", with_ctes({"tiers": """SELECT CASE WHEN likeCount <= 50 THEN 'low'
  WHEN likeCount <= 500 THEN 'medium' ELSE 'high' END AS engagement_level FROM fx_posts"""},
    f"""SELECT t.engagement_level, t.ord, COUNT(p.engagement_level) AS n,
  {r6('100.0 * COUNT(p.engagement_level) / (SELECT COUNT(*) FROM tiers)')} AS pct
  FROM (VALUES ('low', 1), ('medium', 2), ('high', 3)) AS t(engagement_level, ord)
  LEFT JOIN tiers p ON p.engagement_level = t.engagement_level GROUP BY t.engagement_level, t.ord"""))
def _(spark, sf):
    return R.tier_composition(classify_engagement(posts(spark, sf), "likeCount"))


def _describe_sql(col: str, src: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (f"SELECT COUNT({col}) AS count, {r6(f'AVG({x})')} AS mean, {r6(f'STDDEV_SAMP({x})')} AS std, "
            f"{r6(f'MIN({col})')} AS min, {r6(f'QUANTILE_CONT({x}, 0.25)')} AS q25, "
            f"{r6(f'QUANTILE_CONT({x}, 0.5)')} AS q50, {r6(f'QUANTILE_CONT({x}, 0.75)')} AS q75, "
            f"{r6(f'MAX({col})')} AS max FROM {src}")


@query("describe_numeric", with_ctes({}, _describe_sql("likeCount", "fx_posts")))
def _(spark, sf):
    return R.describe_numeric(posts(spark, sf), "likeCount")


@query("describe_text_length", _describe_sql("LENGTH(text)", "documents"))
def _(spark, sf):
    return R.describe_numeric(table(spark, sf, "documents").select(F.length("text").alias("len")), "len")


@query("describe_price", _describe_sql("l_extendedprice", "lineitem"))
def _(spark, sf):
    return R.describe_numeric(table(spark, sf, "lineitem"), "l_extendedprice")


@query("describe_stamps", _describe_sql("((epoch_us(ts) // 1000 - 1704067200000) / 1000.0)", "events"))
def _(spark, sf):
    """Stamps of a month to the millisecond: very many distinct values within a narrow range."""
    since = F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000
    stamps = table(spark, sf, "events").select((since / 1000.0).alias("seconds"))
    return R.describe_numeric(stamps, "seconds")


@query("describe_numeric_approx", with_ctes({}, """SELECT COUNT(likeCount) AS count, MIN(likeCount) + 0.0e0 AS min,
  MAX(likeCount) + 0.0e0 AS max, TRUE AS q25_close, TRUE AS q50_close, TRUE AS q75_close FROM fx_posts"""))
def _(spark, sf):
    """The sketched quartiles lie within their rank error: that much is exact."""
    df = posts(spark, sf).select("likeCount")
    sketch = R.describe_numeric(df, "likeCount", approx=True, accuracy=1000)
    x, total = F.col("likeCount"), F.count("likeCount")
    near = sketch.select(F.struct(*R.QUARTILES).alias("q")).scalar()
    ranks = df.agg(total.alias("n"), *[F.count_if(x < near[q]).alias(f"{q}_below") for q in R.QUARTILES],
                   *[F.count_if(x <= near[q]).alias(f"{q}_upto") for q in R.QUARTILES])
    ok = [((F.col(f"{q}_below") <= p * F.col("n") + F.col("n") / 1000 + 1)
           & (F.col(f"{q}_upto") >= p * F.col("n") - F.col("n") / 1000 - 1)).alias(f"{q}_close")
          for q, p in R.QUARTILES.items()]
    close = ranks.select(F.struct(*ok).alias("ok")).scalar()
    return sketch.select("count", "min", "max", *[close[f"{q}_close"].alias(f"{q}_close") for q in R.QUARTILES])


@query("date_extent", with_ctes({}, "SELECT MIN(date) AS first, MAX(date) AS last FROM fx_posts"))
def _(spark, sf):
    return R.date_extent(posts(spark, sf))


@query("all_match", with_ctes({}, """SELECT BOOL_AND(COALESCE(lang = 'en', FALSE)) AS all_english,
  BOOL_AND(likeCount >= 0) AS all_counted FROM fx_posts"""))
def _(spark, sf):
    return R.all_match(posts(spark, sf), all_english=F.col("lang") == "en", all_counted=F.col("likeCount") >= 0)


@query("model_coverage", with_ctes({}, """SELECT rater, COUNT(*) AS n_rows, (SELECT COUNT(DISTINCT rater) FROM fx_ratings_raw)
  AS n_models FROM fx_ratings_raw GROUP BY rater"""))
def _(spark, sf):
    return R.model_coverage(line_ratings(spark, sf))


_DISTRIBUTION = """SELECT g.rater, g.variable, CAST(s.score AS INT) AS score, COUNT(r.score) AS n FROM
  (SELECT DISTINCT rater, variable FROM {src}) g CROSS JOIN (VALUES (1), (2), (3)) AS s(score)
  LEFT JOIN {src} r ON r.rater = g.rater AND r.variable = g.variable AND r.score = s.score
  GROUP BY g.rater, g.variable, s.score"""


@query("score_distribution", with_ctes({}, _DISTRIBUTION.format(src="fx_ratings")))
def _(spark, sf):
    return R.score_distribution(R.score_counts(grid_to_ratings(line_grid(spark, sf), RATERS)))


@query("score_distribution_patterns", with_ctes({}, _DISTRIBUTION.format(src="fx_docs")))
def _(spark, sf):
    """From score patterns; the constant rater fills with zeros."""
    return R.score_distribution(R.pattern_score_counts(doc_patterns(spark, sf), DOC_RATERS))


@query("score_proportions", with_ctes({}, f"""SELECT r.variable, CAST(s.score AS INT) AS score,
  {r6(f"AVG(CASE WHEN r.condition = '{FIRST}' THEN CASE WHEN r.score = s.score THEN 1 ELSE 0 END END)")} AS prompt_a,
  {r6(f"AVG(CASE WHEN r.condition = '{SECOND}' THEN CASE WHEN r.score = s.score THEN 1 ELSE 0 END END)")} AS prompt_b
  FROM fx_conditions r CROSS JOIN (VALUES (1), (2), (3)) AS s(score) GROUP BY r.variable, s.score"""))
def _(spark, sf):
    counts = R.pattern_score_counts(condition_patterns(spark, sf), [FIRST, SECOND])
    return R.score_proportions(counts, {FIRST: "prompt_a", SECOND: "prompt_b"})


@query("floor_effect", with_ctes({}, f"""SELECT rater, variable, {r6('AVG(CASE WHEN score = 1 THEN 1 ELSE 0 END)')} AS floor_share,
  AVG(CASE WHEN score = 1 THEN 1 ELSE 0 END) > 0.9 AS floor_effect FROM fx_docs GROUP BY rater, variable"""))
def _(spark, sf):
    return R.floor_effect(R.pattern_score_counts(doc_patterns(spark, sf), DOC_RATERS))


# ------------------------------------------------------------------------------ totals and spread

_TOTALS = {"totals": "SELECT unit_id, rater, SUM(score) AS total FROM fx_ratings GROUP BY unit_id, rater"}
_SPREAD = {**_TOTALS, "spread": """SELECT unit_id, AVG(total) AS mean_score, MAX(total) - MIN(total) AS spread,
  COUNT(*) AS n_raters FROM totals GROUP BY unit_id HAVING COUNT(*) >= 2"""}


def _totals(spark, sf):
    return D.unit_totals(grid_to_ratings(line_grid(spark, sf), RATERS))


@query("unit_totals", with_ctes(_TOTALS, "SELECT unit_id, rater, CAST(total AS BIGINT) AS total_score FROM totals"))
def _(spark, sf):
    return _totals(spark, sf)


@query("spread_map", with_ctes(_SPREAD, f"""SELECT unit_id, {r6('mean_score')} AS mean_score, CAST(spread AS BIGINT) AS spread,
  n_raters FROM spread"""))
def _(spark, sf):
    return D.spread_map(_totals(spark, sf))


@query("spread_map_conditions", with_ctes({"totals": "SELECT unit_id, condition, SUM(score) AS total FROM fx_conditions "
                                                     "GROUP BY unit_id, condition"},
    f"""SELECT unit_id, {r6('AVG(total)')} AS mean_score, CAST(MAX(total) - MIN(total) AS INT) AS spread, COUNT(*) AS n_raters
  FROM totals GROUP BY unit_id"""))
def _(spark, sf):
    """From wide rows the totals need no grouping of their own."""
    return D.spread_map(D.total_score(condition_annotations(spark, sf)))


@query("spread_medians", with_ctes(_SPREAD, f"""SELECT {r6('QUANTILE_CONT(CAST(mean_score AS DOUBLE), 0.5)')} AS median_mean_score,
  {r6('QUANTILE_CONT(CAST(spread AS DOUBLE), 0.5)')} AS median_spread FROM spread"""))
def _(spark, sf):
    return D.spread_medians(D.spread_map(_totals(spark, sf)))


@query("spread_quadrant", with_ctes({**_SPREAD, "med": """SELECT QUANTILE_CONT(CAST(mean_score AS DOUBLE), 0.5) AS mx,
  QUANTILE_CONT(CAST(spread AS DOUBLE), 0.5) AS my FROM spread"""},
    """SELECT unit_id, CONCAT(CASE WHEN mean_score > mx THEN 'high score' ELSE 'low score' END, ' / ',
  CASE WHEN spread > my THEN 'high spread' ELSE 'low spread' END) AS quadrant FROM spread CROSS JOIN med"""))
def _(spark, sf):
    spread = stored(D.spread_map(_totals(spark, sf)), "spread")  # read by the medians and by the labels
    return D.spread_quadrant(spread).select("unit_id", "quadrant")


_DIFF = {"diffs": f"""SELECT unit_id, SUM(CASE WHEN condition = '{SECOND}' THEN score ELSE -score END) AS diff
  FROM fx_conditions WHERE condition IN ('{FIRST}', '{SECOND}') GROUP BY unit_id"""}


def _differences(spark, sf):
    return D.total_differences(D.total_score(condition_annotations(spark, sf)), FIRST, SECOND)


@query("score_divergence_hist", with_ctes(_DIFF, """SELECT CAST(b.diff AS INT) AS diff, COUNT(d.diff) AS n,
  CASE WHEN b.diff = 0 THEN 'exact' WHEN ABS(b.diff) <= 2 THEN 'near' ELSE 'far' END AS bucket
  FROM (SELECT UNNEST(GENERATE_SERIES(-4, 4)) AS diff) b LEFT JOIN diffs d ON d.diff = b.diff GROUP BY b.diff"""))
def _(spark, sf):
    return D.score_divergence_hist(_differences(spark, sf))


@query("score_divergence_stats", with_ctes(_DIFF, f"""SELECT COUNT(*) AS n, {r6('AVG(diff)')} AS mean_diff,
  {r6('AVG(ABS(diff))')} AS mean_abs, {r6('100 * AVG(CASE WHEN ABS(diff) <= 3 THEN 1 ELSE 0 END)')} AS pct_within FROM diffs"""))
def _(spark, sf):
    return D.score_divergence_stats(_differences(spark, sf))


_DRIFT = {"drift": f"SELECT variable, a - b AS drift FROM fx_condition_pairs WHERE rater_a = '{FIRST}' AND rater_b = '{SECOND}'"}


def _drifts(spark, sf):
    return D.drift_values(contingency(condition_patterns(spark, sf), [(FIRST, SECOND)]), ["variable"])


@query("drift_quantiles", with_ctes(_DRIFT, f"""SELECT variable, {r6('AVG(drift)')} AS mean_drift,
  {r6('QUANTILE_CONT(CAST(drift AS DOUBLE), 0.25)')} AS q25, {r6('QUANTILE_CONT(CAST(drift AS DOUBLE), 0.75)')} AS q75,
  CASE WHEN AVG(drift) > 0.01 THEN 'positive' WHEN AVG(drift) < -0.01 THEN 'negative' ELSE 'same' END AS direction
  FROM drift GROUP BY variable"""))
def _(spark, sf):
    return D.drift_quantiles(_drifts(spark, sf))


@query("drift_counts", with_ctes(_DRIFT, f"""SELECT variable, COUNT(CASE WHEN drift > 0 THEN 1 END) AS n_up,
  COUNT(CASE WHEN drift = 0 THEN 1 END) AS n_same, COUNT(CASE WHEN drift < 0 THEN 1 END) AS n_down,
  {r6('AVG(drift)')} AS mean_drift FROM drift GROUP BY variable"""))
def _(spark, sf):
    return D.drift_counts(_drifts(spark, sf))


@query("drift_table", with_ctes({}, "SELECT unit_id, " + ", ".join(
    f"MAX(CASE WHEN variable = '{v}' THEN a END) AS {v}_H1, MAX(CASE WHEN variable = '{v}' THEN b END) AS {v}_H2, "
    f"MAX(CASE WHEN variable = '{v}' THEN a - b END) AS {v}_drift" for v in SCORE_COLS) +
    f" FROM fx_condition_pairs WHERE rater_a = '{FIRST}' AND rater_b = '{SECOND}' GROUP BY unit_id"))
def _(spark, sf):
    return D.drift_table(condition_annotations(spark, sf), FIRST, SECOND)
