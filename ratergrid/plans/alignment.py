"""Rating hygiene, alignment of raters, reshaping and id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ratergrid.functions.verdicts import divergence_bucket
from ratergrid.operators import alignment as L, hygiene as H
from ratergrid.operators.agreement import cumulative_counts
from ratergrid.operators.disagreement import total_score
from ratergrid.operators.profile import score_counts
from ratergrid.operators.reports import case_extract
from ratergrid.plans.fixtures import (BASELINE, CONDITIONS, HUMANS, LATEST, LINE_VARS,
                                      MODELS, RATERS, condition_annotations, condition_grid,
                                      line_grid, line_ratings, table)
from ratergrid.plans.registry import query, with_ctes
from ratergrid.schemas import SCORE_COLS

STUDY = HUMANS + MODELS
_IN_STUDY = "rater IN ('L1', 'L2', 'L3', 'L4', 'L5')"
_VALID = "V1 IN (1, 2, 3) AND V2 IN (1, 2, 3) AND V3 IN (1, 2, 3) AND V4 IN (1, 2, 3)"


@query("validity_filter", with_ctes({}, f"SELECT unit_id, rater, V1, V2, V3, V4 FROM fx_ratings_raw WHERE {_VALID}"))
def _(spark, sf):
    return H.validity_filter(line_ratings(spark, sf), LINE_VARS).select("unit_id", "rater", *LINE_VARS)


_BAD = {"bad": "SELECT unit_id, CASE WHEN V1 NOT IN (1, 2, 3) THEN 'V1' WHEN V2 NOT IN (1, 2, 3) THEN 'V2' "
               "WHEN V3 NOT IN (1, 2, 3) THEN 'V3' WHEN V4 NOT IN (1, 2, 3) THEN 'V4' END AS \"column\", "
               "CASE WHEN V1 NOT IN (1, 2, 3) THEN V1 WHEN V2 NOT IN (1, 2, 3) THEN V2 "
               "WHEN V3 NOT IN (1, 2, 3) THEN V3 ELSE V4 END AS raw_value FROM fx_ratings_raw "
               f"WHERE NOT ({_VALID})"}


@query("invalid_report", with_ctes(_BAD, """SELECT "column", COUNT(*) AS n_invalid, COUNT(DISTINCT raw_value) AS n_values
  FROM bad GROUP BY "column" """))
def _(spark, sf):
    return H.invalid_report(line_ratings(spark, sf), LINE_VARS)


@query("invalid_rows", with_ctes(_BAD, "SELECT unit_id, \"column\", CAST(raw_value AS VARCHAR) AS raw_value FROM bad"))
def _(spark, sf):
    return H.invalid_rows(line_ratings(spark, sf), LINE_VARS)


@query("dedupe_latest", with_ctes({}, "SELECT unit_id, rater, V1, V2, V3, V4 FROM fx_latest"))
def _(spark, sf):
    valid = H.validity_filter(line_ratings(spark, sf), LINE_VARS)
    return H.dedupe_latest(valid, ["unit_id", "rater"], LATEST).select("unit_id", "rater", *LINE_VARS)


@query("total_score", with_ctes({}, "SELECT unit_id, rater, V1 + V2 + V3 + V4 AS total_score FROM fx_ratings_raw"))
def _(spark, sf):
    return total_score(line_ratings(spark, sf), LINE_VARS).select("unit_id", "rater", "total_score")


@query("melt_scores", with_ctes({}, " UNION ALL ".join(
    f"SELECT unit_id, rater, '{v}' AS variable, {v} AS score FROM fx_ratings_raw" for v in LINE_VARS)))
def _(spark, sf):
    return H.melt_scores(line_ratings(spark, sf), LINE_VARS)


@query("overlap_semi", """SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return H.overlap_semi(docs, table(spark, sf, "labels"), "doc_id")


@query("missing_ids", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return H.missing_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("id_set_ops", with_ctes({}, """SELECT i.unit_id,
  i.unit_id IN (SELECT unit_id FROM fx_ratings_raw WHERE rater = 'L1') AS in_a,
  i.unit_id IN (SELECT unit_id FROM fx_ratings_raw WHERE rater = 'L2') AS in_b
  FROM (SELECT DISTINCT unit_id FROM fx_ratings_raw WHERE rater IN ('L1', 'L2')) i"""))
def _(spark, sf):
    ratings = line_ratings(spark, sf)
    return H.id_set_ops(ratings.where("rater = 'L1'"), ratings.where("rater = 'L2'"))


@query("sorted_ids", with_ctes({}, "SELECT DISTINCT unit_id FROM fx_ratings_raw ORDER BY unit_id"))
def _(spark, sf):
    return H.sorted_ids(line_ratings(spark, sf))


@query("head_preview", "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 3")
def _(spark, sf):
    return H.head_preview(table(spark, sf, "documents"), 3, "doc_id", ["doc_id", "lang", "text"])


@query("annotation_id", with_ctes({}, """SELECT unit_id, rater, MD5(CONCAT(LENGTH(unit_id), ':', unit_id,
  COALESCE(CAST(LENGTH(rater) AS VARCHAR) || ':' || rater, '-1:'))) AS annotation_id FROM (SELECT unit_id,
  CASE WHEN rater <> 'L7' THEN rater END AS rater FROM fx_latest) q"""))
def _(spark, sf):
    """One rater has no name, so some keys hold a NULL."""
    valid = H.validity_filter(line_ratings(spark, sf), LINE_VARS)
    latest = H.dedupe_latest(valid, ["unit_id", "rater"], LATEST).select("unit_id", "rater")
    unnamed = latest.withColumn("rater", F.when(F.col("rater") != "L7", F.col("rater")))
    return H.annotation_id(unnamed, ["unit_id", "rater"])


# -------------------------------------------------------------------------------- side by side

@query("score_grid", with_ctes({}, "SELECT unit_id, variable, " + ", ".join(
    f"MAX(CASE WHEN rater = '{r}' THEN score END) AS {r}" for r in RATERS) +
    " FROM fx_ratings GROUP BY unit_id, variable"))
def _(spark, sf):
    return line_grid(spark, sf)


_CORE = {"full_units": f"SELECT unit_id, variable FROM fx_ratings WHERE {_IN_STUDY} GROUP BY unit_id, variable "
                       "HAVING COUNT(DISTINCT rater) = 5"}


@query("latest_grid_by_day", with_ctes({"by_day": f"""SELECT * FROM (SELECT unit_id, rater, V1, V2, V3, V4, ROW_NUMBER() OVER (
  PARTITION BY unit_id, rater ORDER BY CAST(l_shipdate AS DATE) DESC, V4 DESC, V3 DESC, V2 DESC, V1 DESC) AS rn FROM fx_ratings_raw
  WHERE V1 IN (1, 2, 3) AND V2 IN (1, 2, 3) AND V3 IN (1, 2, 3) AND V4 IN (1, 2, 3)) q WHERE rn = 1""",
    "by_day_long": " UNION ALL ".join(f"SELECT unit_id, rater, '{v}' AS variable, {v} AS score FROM by_day" for v in LINE_VARS)},
    "SELECT unit_id, variable, " + ", ".join(f"MAX(CASE WHEN rater = '{r}' THEN score END) AS {r}" for r in RATERS) +
    " FROM by_day_long GROUP BY unit_id, variable"))
def _(spark, sf):
    """The latest day counts; of ratings of one day the highest scores, the last variable first."""
    valid = H.validity_filter(line_ratings(spark, sf), LINE_VARS).withColumn("day", F.col("l_shipdate").cast("date"))
    return L.latest_score_grid(valid, RATERS, ["day"], LINE_VARS)


@query("common_core", with_ctes({"counted": f"""SELECT *, COUNT(*) OVER (PARTITION BY unit_id, variable) AS raters
  FROM fx_ratings WHERE {_IN_STUDY}"""}, "SELECT unit_id, variable, rater, score FROM counted WHERE raters = 5"))
def _(spark, sf):
    core = L.common_core(line_grid(spark, sf, STUDY), STUDY)
    return L.grid_to_ratings(core, STUDY).select("unit_id", "variable", "rater", "score")


@query("core_units", with_ctes({}, f"""SELECT unit_id FROM fx_ratings_raw WHERE {_IN_STUDY} GROUP BY unit_id
  HAVING COUNT(DISTINCT rater) = 5"""))
def _(spark, sf):
    return L.core_units(line_ratings(spark, sf), STUDY)


@query("pattern_counts", with_ctes({"grid": "SELECT unit_id, variable, " + ", ".join(
    f"MAX(CASE WHEN rater = '{r}' THEN score END) AS {r}" for r in RATERS) +
    " FROM fx_ratings GROUP BY unit_id, variable"},
    f"SELECT variable, {', '.join(RATERS)}, COUNT(*) AS n FROM grid GROUP BY variable, {', '.join(RATERS)}"))
def _(spark, sf):
    return L.pattern_counts(line_grid(spark, sf), RATERS)


@query("rater_pairs", with_ctes({"seen": """SELECT rater_a, rater_b, variable, COUNT(DISTINCT unit_id) AS n_units FROM fx_pairs
  WHERE rater_a IN ('L1', 'L2', 'L3', 'L4', 'L5') AND rater_b IN ('L1', 'L2', 'L3', 'L4', 'L5')
  GROUP BY rater_a, rater_b, variable"""},
    """SELECT CAST(DENSE_RANK() OVER (ORDER BY CASE WHEN rater_a = 'L1' AND rater_b = 'L2' THEN 0 ELSE 1 END,
  rater_a, rater_b) AS INT) AS pair_ord, rater_a, rater_b, variable, n_units FROM seen"""))
def _(spark, sf):
    """Human pair, human with model, model pairs, with the units each pair shares."""
    pairs = L.study_pairs(HUMANS, MODELS)
    patterns = L.pattern_counts(line_grid(spark, sf, STUDY), STUDY)
    order = reduce(lambda c, p: c.when((F.col("rater_a") == p[1][0]) & (F.col("rater_b") == p[1][1]), p[0]),
                   enumerate(pairs, 1), F)
    shared = L.paired_scores(patterns, pairs, keep=["variable", "n"])
    return shared.groupBy("rater_a", "rater_b", "variable").agg(F.sum("n").alias("n_units")).select(
        order.alias("pair_ord"), "rater_a", "rater_b", "variable", "n_units")


def _pairs_sql(source: str, rater: str, pairs: list[tuple[str, str]]) -> str:
    """Score pairs from one pivot per unit, without joining the ratings with themselves."""
    names = sorted({r for pair in pairs for r in pair})
    cells = ", ".join(f"MAX(CASE WHEN {rater} = '{r}' THEN score END) AS {r}" for r in names)
    rows = ", ".join(f"{{'rater_a': '{x}', 'rater_b': '{y}', 'a': {x}, 'b': {y}}}" for x, y in pairs)
    return with_ctes({"pivoted": f"SELECT unit_id, variable, {cells} FROM {source} GROUP BY unit_id, variable",
                      "fanned": f"SELECT unit_id, variable, UNNEST([{rows}]) AS p FROM pivoted"},
                     """SELECT unit_id, variable, p.rater_a AS rater_a, p.rater_b AS rater_b, p.a AS a, p.b AS b FROM fanned
  WHERE p.a IS NOT NULL AND p.b IS NOT NULL""")


@query("paired_scores", _pairs_sql("fx_ratings", "rater", L.rater_pairs(RATERS)))
def _(spark, sf):
    return L.paired_scores(line_grid(spark, sf), L.rater_pairs(RATERS))


@query("baseline_compare", _pairs_sql("fx_conditions", "condition", L.baseline_pairs(BASELINE, CONDITIONS)))
def _(spark, sf):
    return L.paired_scores(condition_grid(spark, sf), L.baseline_pairs(BASELINE, CONDITIONS))


SUBSETS = L.study_subsets(HUMANS, MODELS)
_SUBSET_ROWS = ", ".join(f"('{s}', '{r}')" for s, rs in SUBSETS.items() for r in rs)


@query("rater_subsets", with_ctes({}, f"""SELECT r.unit_id, r.variable, s.subset, r.rater, r.score FROM fx_ratings r
  JOIN (VALUES {_SUBSET_ROWS}) AS s(subset, rater) ON s.rater = r.rater"""))
def _(spark, sf):
    return L.rater_subsets(line_grid(spark, sf, STUDY), SUBSETS)


@query("case_extract", with_ctes({"wide": "SELECT unit_id, condition AS rater, " + ", ".join(
    f"MAX(CASE WHEN variable = '{v}' THEN score END) AS {v}" for v in SCORE_COLS) +
    " FROM fx_conditions GROUP BY unit_id, condition"},
    f"""SELECT c.case_name, w.unit_id, w.rater, {', '.join(SCORE_COLS)}, {' + '.join(SCORE_COLS)} AS total_score
  FROM wide w JOIN (VALUES ('Case 1', '9'), ('Case 2', '18'), ('Case 3', '90')) AS c(case_name, unit_id)
  ON c.unit_id = w.unit_id"""))
def _(spark, sf):
    cases = [("Case 1", "9"), ("Case 2", "18"), ("Case 3", "90")]
    rows = case_extract(total_score(condition_annotations(spark, sf)), cases)
    return rows.select("case_name", "unit_id", "rater", *SCORE_COLS, "total_score")


@query("cumulative_counts", with_ctes({"counts": "SELECT rater, variable, score, COUNT(*) AS n FROM fx_ratings "
                                                 "GROUP BY rater, variable, score"},
    """SELECT rater, variable, score, n, CAST(SUM(n) OVER (PARTITION BY rater, variable ORDER BY score) AS BIGINT) AS upto
  FROM counts"""))
def _(spark, sf):
    ratings = L.grid_to_ratings(line_grid(spark, sf), RATERS)
    return cumulative_counts(score_counts(ratings), ["rater", "variable"])


@query("divergence_bucket", with_ctes({"totals": """SELECT unit_id, SUM(CASE WHEN condition = 'neutral' THEN score END) AS a,
  SUM(CASE WHEN condition = 'extreme_rep' THEN score END) AS b FROM fx_conditions GROUP BY unit_id"""},
    """SELECT unit_id, CAST(b - a AS INT) AS diff, CASE WHEN b = a THEN 'exact' WHEN ABS(b - a) <= 2 THEN 'near' ELSE 'far' END
  AS bucket FROM totals"""))
def _(spark, sf):
    totals = total_score(condition_annotations(spark, sf))
    per_unit = totals.groupBy("unit_id").agg(*[
        F.max(F.when(F.col("rater") == r, F.col("total_score"))).alias(n)
        for r, n in (("neutral", "a"), ("extreme_rep", "b"))])
    diff = F.col("b") - F.col("a")
    return per_unit.select("unit_id", diff.alias("diff"), divergence_bucket(diff).alias("bucket"))
