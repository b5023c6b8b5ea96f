"""Exact samples: the SQL ranks whole strata, the operators do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid.operators import posts as P, sampling as Z
from ratergrid.operators.profile import tier_composition
from ratergrid.plans.fixtures import END, START, posts, table
from ratergrid.plans.registry import query, with_ctes

SIZE, SEED = 2000, 45
REANNOTATE, REANNOTATE_SEED = 50, 42
_QUOTA = "CASE engagement_level WHEN 'low' THEN 1000 WHEN 'medium' THEN 600 ELSE 400 END"
_ORD = "CASE engagement_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_MD5 = "MD5(CONCAT('{seed}:', CAST({id} AS VARCHAR)))"

SAMPLE_SQL = {
    "ranked": "SELECT *, ROW_NUMBER() OVER (PARTITION BY engagement_level ORDER BY "
              f"{_MD5.format(seed=SEED, id='id')}, id) AS rn FROM fx_tiered",
    "sampled": f"SELECT *, ROW_NUMBER() OVER (ORDER BY {_ORD}, rn) AS row_id FROM ranked WHERE rn <= {_QUOTA}",
}


def _pool(spark, sf):
    pool = P.filter_date_range(P.filter_language(posts(spark, sf)), START, END)
    return P.classify_engagement(pool.select(F.col("id").alias("tweet_id"),
                                             F.col("likeCount").alias("like_count"), "date"))


def _sample(spark, sf):
    return Z.stratified_sample(_pool(spark, sf), "engagement_level", Z.tier_quota(SIZE), "tweet_id", SEED)


@query("stratified_sample", with_ctes(SAMPLE_SQL, "SELECT id AS tweet_id, likeCount AS like_count, engagement_level "
                                                  "FROM sampled"))
def _(spark, sf):
    return _sample(spark, sf).select("tweet_id", "like_count", "engagement_level")


@query("assign_row_id", with_ctes(SAMPLE_SQL, "SELECT CAST(row_id AS INT) AS row_id, id AS tweet_id FROM sampled"))
def _(spark, sf):
    return _sample(spark, sf).select("row_id", "tweet_id")


@query("union_strata", with_ctes(SAMPLE_SQL, "SELECT engagement_level, COUNT(*) AS n, MIN(row_id) AS first_row, "
                                             "MAX(row_id) AS last_row FROM sampled GROUP BY engagement_level"))
def _(spark, sf):
    return _sample(spark, sf).groupBy("engagement_level").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").cast("bigint").alias("first_row"),
        F.max("row_id").cast("bigint").alias("last_row"))


@query("tier_quota", with_ctes({}, f"""SELECT engagement_level, CAST({_ORD} AS INT) AS ord, CAST({_QUOTA} AS BIGINT) AS quota,
  COUNT(*) AS n FROM fx_tiered GROUP BY engagement_level"""))
def _(spark, sf):
    pool = _pool(spark, sf)
    quotas = Z.quota_table(pool, Z.tier_quota(SIZE), "engagement_level")
    return tier_composition(pool).drop("ord", "pct").join(quotas, "engagement_level").select(
        "engagement_level", "ord", "quota", "n")


@query("tier_shortfall", with_ctes({"avail": "SELECT engagement_level, COUNT(*) AS n FROM fx_tiered GROUP BY engagement_level"},
    """SELECT t.engagement_level, CAST(t.quota AS BIGINT) AS target, COALESCE(a.n, 0) AS available,
  LEAST(t.quota, COALESCE(a.n, 0)) AS taken, GREATEST(t.quota - COALESCE(a.n, 0), 0) AS shortfall
  FROM (VALUES ('low', CAST(1000 AS BIGINT)), ('medium', 600), ('high', 400)) AS t(engagement_level, quota)
  LEFT JOIN avail a ON a.engagement_level = t.engagement_level"""))
def _(spark, sf):
    return Z.tier_shortfall(_pool(spark, sf), "engagement_level", Z.tier_quota(SIZE))


@query("simple_random_sample", f"""SELECT doc_id, lang, text FROM documents
  ORDER BY {_MD5.format(seed=SEED, id='doc_id')}, doc_id LIMIT 300""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return Z.simple_random_sample(docs, 300, "doc_id", SEED)


@query("subsample_for_reannotation", with_ctes({"first": f"""SELECT doc_id FROM documents
  ORDER BY {_MD5.format(seed=SEED, id='doc_id')}, doc_id LIMIT 300"""},
    f"SELECT doc_id FROM first ORDER BY {_MD5.format(seed=REANNOTATE_SEED, id='doc_id')}, doc_id LIMIT {REANNOTATE}"))
def _(spark, sf):
    first = Z.simple_random_sample(table(spark, sf, "documents").select("doc_id"), 300, "doc_id", SEED)
    return Z.simple_random_sample(first, REANNOTATE, "doc_id", REANNOTATE_SEED)


@query("bounded_collect", with_ctes({}, """SELECT date_day, id FROM fx_posts WHERE lang = 'en'
  ORDER BY date_day, id LIMIT 3333"""))
def _(spark, sf):
    accepted = P.filter_language(posts(spark, sf)).select("date_day", "id")
    return Z.bounded_collect(accepted, 3333, "date_day", "id")


# ------------------------------------------------------------------------- missing ids, groups and positions

_GAPS = {"gaps": "SELECT event_id, CASE WHEN user_id % 17 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events"}
_GAP_ORDER = "MD5(CONCAT('45:', COALESCE(CAST(user_id AS VARCHAR), CONCAT('null,', CAST(event_id AS VARCHAR)))))"


def _gaps(spark, sf):
    user = F.when(F.col("user_id") % 17 != 0, F.col("user_id"))
    return table(spark, sf, "events").select("event_id", user.alias("user_id"), "event_type")


@query("sample_missing_ids", with_ctes(_GAPS, f"""SELECT event_id, user_id FROM gaps
  ORDER BY {_GAP_ORDER}, user_id NULLS FIRST, event_id LIMIT 400"""))
def _(spark, sf):
    """Ids repeat, and one in 17 is missing."""
    return Z.simple_random_sample(_gaps(spark, sf), 400, "user_id", SEED, ["event_id"]).drop("event_type")


@query("stratified_missing_ids", with_ctes({**_GAPS, "ranked": f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type
  ORDER BY {_GAP_ORDER}, user_id NULLS FIRST, event_id) AS rn FROM gaps"""},
    """SELECT event_id, user_id, event_type FROM ranked WHERE rn <= CASE event_type WHEN 'view' THEN 300
  WHEN 'click' THEN 50 ELSE 0 END"""))
def _(spark, sf):
    return Z.stratified_sample(_gaps(spark, sf), "event_type", {"view": 300, "click": 50}, "user_id", SEED,
                               ["event_id"]).drop("row_id")


@query("collect_missing_positions", with_ctes(_GAPS, """SELECT COUNT(*) AS n, COUNT(user_id) AS n_with_id,
  MAX(user_id) AS last_id, COUNT(DISTINCT event_type) AS n_types FROM (SELECT * FROM gaps WHERE event_type <> 'view'
  ORDER BY event_type, user_id NULLS FIRST LIMIT 2000) q"""))
def _(spark, sf):
    """Positions repeat and are missing; rows that share the last one are alternatives, so counts are compared."""
    rows = _gaps(spark, sf).where("event_type <> 'view'")
    return Z.bounded_collect(rows, 2000, "event_type", "user_id", 64).agg(
        F.count(F.lit(1)).alias("n"), F.count("user_id").alias("n_with_id"), F.max("user_id").alias("last_id"),
        F.count_distinct("event_type").alias("n_types"))
