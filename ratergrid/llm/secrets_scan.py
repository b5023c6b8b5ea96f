"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern, with their places. The digest of each candidate's value is counted over the whole
corpus by distinct repositories, owners and documents: a value that many of these have was copied from an example, one
that a single owner has in few places is that owner's. Long mixed tokens that no pattern names are candidates too; those that look alive and
belong to one owner are added to the spans, those that owners share are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratergrid.llm.common import quoted, whole_text
from ratergrid.llm.spans import with_places
from ratergrid.session import stored

#: Kinds in the order of the report: pattern, group of the value, least length of the value. Fixed values.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "owned": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ["assign", "access", "hex"]
#: Owners from which on a value counts as widely copied.
COPIED_OWNERS = 3
#: Repositories, and documents, from which on it does so within one or two owners too.
COPIED_REPOS, COPIED_DOCS = 4, 20
#: Words of values that are made up (or digits that open, end or run through one), and the kinds of characters that an
#: unnamed token needs.
DUMMY = "example|sample|dummy|changeme|placeholder|xxxx|^0000|0000$|00000000|^1234|1234$|12345678"
MIXED = ["[A-Z]", "[a-z]", "[0-9]"]


def _spans(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``_<kind>``: array of (start, kind number, end, value) for the spans that pass."""
    pattern, group, least = KINDS[kind]
    df = with_places(df, f"_{kind}", F.col("_text"), pattern)

    def span(s: Column) -> Column:
        value = F.regexp_extract(s["value"], pattern, group) if group else s["value"]
        return F.struct(s["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("kind"), s["end"].alias("end"),
                        value.alias("value"))

    return df.withColumn(f"_{kind}", F.filter(F.transform(f"_{kind}", span), lambda s: F.length(s["value"]) >= least))


def _unnamed(found: DataFrame) -> DataFrame:
    """Unnamed candidates (_row, _owner, _repo, _span) that overlap no base span of their text."""
    own = found.where(F.size("_owned") > 0)
    every = own.select("_row", "_owner", "_repo", F.explode(F.concat("base", "_owned")).alias("_span"))
    base = F.col("_span.kind") < len(BASE)
    before = Window.partitionBy("_row").orderBy("_span.start")
    after = Window.partitionBy("_row").orderBy(F.desc("_span.start"))  # a running minimum; frames to the end are quadratic
    placed = every.withColumns({"_before": F.max(F.when(base, F.col("_span.end"))).over(before),
                                "_after": F.min(F.when(base, F.col("_span.start"))).over(after)})
    return placed.where(~base & (F.coalesce("_before", F.lit(0)) <= F.col("_span.start")) & (
        F.col("_after").isNull() | (F.col("_after") >= F.col("_span.end")))).select("_row", "_owner", "_repo", "_span")


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _live(value: Column) -> Column:
    return ~F.lower(value).rlike(DUMMY)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base (array of spans), spans (array), n_copied,
    n_live, spread. A span is (start, kind, end, value), ends exclusive, in code points; spread has start, kind, owners,
    repos and docs (how many have its value) of base spans and of all unnamed candidates.

    ``repo_col`` names a repository of the owner. A value is widely copied when at least ``COPIED_OWNERS`` owners,
    ``COPIED_REPOS`` repositories or ``COPIED_DOCS`` documents have it. n_copied counts base spans of such values,
    n_live those of a single owner that are not copied and look alive; unnamed ones of that kind are added to spans.
    NULL and empty texts have no spans; a NULL owner or repository counts as one of its own. Repeated rows are rows of
    the same owner; ids are only carried along. An empty table gives no rows. Columns besides the four named are not
    read.
    """
    found = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(quoted(id_col)).alias("doc_id"),
                        F.coalesce(F.col(quoted(owner_col)).cast("string"), F.lit("")).alias("_owner"),
                        F.coalesce(F.col(quoted(repo_col)).cast("string"), F.lit("")).alias("_repo"),
                        whole_text(text_col).alias("_text"))
    for kind in KINDS:
        found = _spans(found, kind)
    found = found.withColumn("base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE])))
    mixed = F.filter("_owned", lambda s: F.forall(F.array(*[s["value"].rlike(p) for p in MIXED]), lambda x: x) & _live(s["value"]))
    found = found.withColumn("_owned", mixed)
    found = stored(found.select("_row", "doc_id", "_owner", "_repo", *[F.size(f"_{k}").cast("long").alias(f"n_{k}")
                                                                      for k in BASE], "base", "_owned"), "candidates")

    named = found.select("_row", "_owner", "_repo", F.explode("base").alias("_span"))
    one = named.unionByName(_unnamed(found)).withColumn("_digest", F.unhex(F.sha2(F.col("_span.value").cast("binary"), 256)))
    one = stored(one, "spans")
    each = one.select("_row", "_owner", "_repo", "_digest").distinct()
    owners = each.groupBy("_digest", "_owner", "_repo").agg(F.count("*").alias("_docs")).groupBy("_digest", "_owner").agg(
        F.count("*").alias("_repos"), F.sum("_docs").alias("_docs")).groupBy("_digest").agg(
        F.count("*").alias("_owners"), F.sum("_repos").alias("_repos"), F.sum("_docs").alias("_docs"))
    judged = one.join(stored(owners, "owners"), "_digest")
    base = F.col("_span.kind") < len(BASE)
    copied = (F.col("_owners") >= COPIED_OWNERS) | (F.col("_repos") >= COPIED_REPOS) | (F.col("_docs") >= COPIED_DOCS)
    own = (F.col("_owners") == 1) & ~copied
    per_row = judged.groupBy("_row").agg(
        F.count_if(base & copied).alias("n_copied"),
        F.count_if(base & own & _live(F.col("_span.value"))).alias("n_live"),
        F.collect_list(F.when(~base & own, F.col("_span"))).alias("_added"),
        F.array_sort(F.collect_list(F.struct(
            F.col("_span.start").alias("start"), F.col("_span.kind").alias("kind"), F.col("_owners").alias("owners"),
            F.col("_repos").alias("repos"), F.col("_docs").alias("docs")))).alias("spread"))
    return found.join(per_row, "_row", "left").select(
        "doc_id", *[f"n_{k}" for k in BASE], "base",
        F.array_sort(F.concat("base", F.coalesce("_added", F.filter("base", lambda _: F.lit(False))))).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("spread", F.array().cast("array<struct<start:bigint,kind:int,owners:bigint,repos:bigint,docs:bigint>>")).alias(
            "spread"))


def secret_report(docs: DataFrame) -> DataFrame:
    """The scan with spans as text and the base spans' digest."""
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex",
                                     F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                                     _listed(F.col("spans")).alias("spans"), "n_copied", "n_live")


def _kind_sql(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    quoted_pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, src, rep, '{kind}' AS kind, {list(KINDS).index(kind)} AS k, v AS value, e - length(h) AS s, e
      FROM (SELECT doc_id, src, rep, h, v, SUM(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS e
        FROM (SELECT doc_id, src, rep, UNNEST(hs) AS h, UNNEST(vs) AS v, UNNEST(gs[1:len(hs)]) AS g,
                     UNNEST(range(len(hs))) AS i
          FROM (SELECT doc_id, src, rep, regexp_extract_all(t, {quoted_pattern}) AS hs, regexp_extract_all(t,
                       {quoted_pattern}, {group}) AS vs, string_split_regex(t, {quoted_pattern}) AS gs FROM d)
          WHERE len(hs) > 0)) WHERE length(v) >= {least}"""


SECRETS_SQL = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, COALESCE(source, '') AS src,
  COALESCE(lang, '') AS rep FROM documents),
base AS ({' UNION ALL '.join(_kind_sql(k) for k in BASE)}),
more AS (SELECT * FROM ({_kind_sql('owned')}) o WHERE {' AND '.join(f"regexp_matches(value, '{p}')" for p in MIXED)}
  AND NOT regexp_matches(lower(value), '{DUMMY}')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
owners AS (SELECT value, COUNT(DISTINCT src) AS n, COUNT(DISTINCT src) >= {COPIED_OWNERS} OR COUNT(DISTINCT (src, rep)) >= {COPIED_REPOS}
    OR COUNT(DISTINCT doc_id) >= {COPIED_DOCS} AS copied FROM every GROUP BY value),
judged AS (SELECT e.*, o.n = 1 AND NOT o.copied AS own, o.copied FROM every e JOIN owners o USING (value)
  WHERE k < {len(BASE)} OR (o.n = 1 AND NOT o.copied)),
per AS (SELECT doc_id, COUNT(*) FILTER (kind = 'assign') AS n_assign, COUNT(*) FILTER (kind = 'access') AS n_access,
  COUNT(*) FILTER (kind = 'hex') AS n_hex,
  STRING_AGG(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base,
  STRING_AGG(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
  COUNT(*) FILTER (k < {len(BASE)} AND copied) AS n_copied,
  COUNT(*) FILTER (k < {len(BASE)} AND own AND NOT regexp_matches(lower(value), '{DUMMY}')) AS n_live
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
  sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n_copied, 0) AS n_copied,
  COALESCE(n_live, 0) AS n_live FROM d LEFT JOIN per USING (doc_id)"""
