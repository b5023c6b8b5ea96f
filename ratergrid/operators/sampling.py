"""Exact, repeatable sampling.

Rows are ordered by ``md5(seed:id)``, so a sample depends on the seed and the ids only, not on how
the data is partitioned. A stratum may hold nearly all rows; it is never sorted or shuffled whole.
A first pass counts rows per digest prefix and finds the prefix at which a stratum's quota is
reached; the second pass keeps the rows up to that prefix, and only those few are ranked, in groups of
equal leading digits. A row without an id is ordered by its tie columns, so such rows are sampled like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratergrid.dims import map_values, quoted, small_table
from ratergrid.functions.posts import ENGAGEMENT_PROPORTIONS
from ratergrid.session import stored

PREFIX_DIGITS = 5

#: Rows (stratum, digest group) that a sample broadcasts at most, and so the most strata it takes.
MAX_GROUPS = 100_000


def sample_order(id_col: str, seed: int, tie_cols: list[str] = ()) -> Column:
    """Digest that orders rows; a NULL id is replaced by ``null`` and the tie columns, comma-joined."""
    ties = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in tie_cols]
    key = F.coalesce(F.col(quoted(id_col)).cast("string"), F.concat_ws(",", F.lit("null"), *ties))
    return F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))


def tier_quota(n: int, proportions: dict[str, float] = ENGAGEMENT_PROPORTIONS) -> dict[str, int]:
    """Rows wanted per tier: ``n`` times its share, truncated as floating point gives it."""
    return {tier: int(n * share) for tier, share in proportions.items()}


def quota_table(df: DataFrame, quotas: dict[str, int], key: str) -> DataFrame:
    """``quotas`` as a table (key, ord, quota), one row per stratum."""
    rows = [(k, i, int(q)) for i, (k, q) in enumerate(quotas.items(), 1)]
    return small_table(df.sparkSession, rows, f"{key} string, ord int, quota bigint")


def _quota_columns(key: str, quotas: dict[str, int]) -> dict[str, Column]:
    return {"ord": map_values(F.col(key), {k: i for i, k in enumerate(quotas, 1)}),
            "quota": map_values(F.col(key), quotas)}


def _group_digits(strata: int) -> int:
    """Digest digits that split a stratum for ranking; keeps strata x groups within ``MAX_GROUPS``."""
    if strata > MAX_GROUPS:
        raise ValueError(f"{strata} strata: at most {MAX_GROUPS} quotas can be given")
    return max(d for d in range(4) if strata * 16 ** d <= MAX_GROUPS)


def _ranked(df: DataFrame, key: str, quotas: dict[str, int], id_col: str, seed: int,
            tie_cols: list[str], prefix_digits: int) -> DataFrame:
    """Rows within their stratum's quota, with ``rn``, the rank in the stratum, and ``before``, the
    sampled rows of earlier strata."""
    group_digits = min(_group_digits(len(quotas)), prefix_digits)
    keyed = df.where(F.col(key).isin(list(quotas))).withColumn(
        "_order", sample_order(id_col, seed, tie_cols))
    prefix = F.substring("_order", 1, prefix_digits)
    group = F.substring("_order", 1, group_digits).alias("_group")

    in_key = Window.partitionBy(key)
    upto = F.sum("_n").over(in_key.orderBy("_prefix"))
    counts = (keyed.groupBy(key, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumns({"_upto": upto, **_quota_columns(key, quotas)}))
    # the first prefix at which the quota is reached, or the last one of a short stratum
    met = F.min(F.when(F.col("_upto") >= F.col("quota"), F.col("_prefix"))).over(in_key)
    counts = counts.withColumns({
        "_cut": F.coalesce(met, F.max("_prefix").over(in_key)),
        "_taken": F.least(F.sum("_n").over(in_key), F.col("quota"))})
    # ranks run within digest groups, so a large quota is ranked by many tasks
    groups = (counts.groupBy(key, F.substring("_prefix", 1, group_digits).alias("_group"),
                             "ord", "quota", "_cut", "_taken")
              .agg(F.min(F.col("_upto") - F.col("_n")).alias("_group_before"))
              .where(F.col("_group_before") < F.col("quota")))
    earlier = Window.orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    once = F.when(F.col("_group_before") == 0, F.col("_taken"))  # one group of each stratum
    groups = groups.select(key, "_group", "quota", "_cut", "_group_before",
                           F.coalesce(F.sum(once).over(earlier), F.lit(0)).alias("before"))

    # at most 16^group_digits rows per stratum, so the broadcast side does not grow with the data
    near = (keyed.withColumn("_group", group)
            .join(F.broadcast(groups), [key, "_group"]).where(prefix <= F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy(key, "_group").orderBy("_order", id_col, *tie_cols))
    return (near.withColumn("rn", F.col("_group_before") + rank)
            .where(F.col("rn") <= F.col("quota"))
            .drop("_order", "_group", "_group_before", "_cut", "quota"))


def stratified_sample(df: DataFrame, key: str, quotas: dict[str, int], id_col: str, seed: int,
                      tie_cols: list[str] = (), prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """Exactly ``quotas[k]`` rows of each stratum without replacement; a short one gives all it has.

    Adds ``row_id``: 1..n in stratum order, then sample order.
    """
    ranked = _ranked(df, key, quotas, id_col, seed, list(tie_cols), prefix_digits)
    return (ranked.withColumn("row_id", (F.col("before") + F.col("rn")).cast("int"))
            .drop("before", "rn"))


def simple_random_sample(df: DataFrame, n: int, id_col: str, seed: int, tie_cols: list[str] = (),
                         prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """Exactly ``n`` rows, or all when there are fewer."""
    whole = df.withColumn("_all", F.lit("all"))
    return _ranked(whole, "_all", {"all": n}, id_col, seed, list(tie_cols),
                   prefix_digits).select(*df.columns)


def tier_shortfall(df: DataFrame, key: str, quotas: dict[str, int]) -> DataFrame:
    """Wanted, available and taken rows per stratum, absent strata included."""
    available = df.groupBy(key).agg(F.count(F.lit(1)).alias("available"))
    out = quota_table(df, quotas, key).join(available, key, "left")
    out = out.withColumn("available", F.coalesce("available", F.lit(0)))
    return out.select(key, F.col("quota").alias("target"), "available",
                      F.least("quota", "available").alias("taken"),
                      F.greatest(F.col("quota") - F.col("available"), F.lit(0)).alias("shortfall"))


def bounded_collect(df: DataFrame, max_rows: int, group_col: str, position_col: str,
                    width: int = 65536) -> DataFrame:
    """The first ``max_rows`` rows ordered by (group, position), e.g. (file, row number in the file).

    NULL groups and positions come first. Rows that share the position at which the limit falls are
    alternatives: as many as are still missing are taken. Rows are counted per group and run of ``width``
    positions; the counts are written in ranges, summed within each and over the totals of the ranges. Only the run in
    which the limit falls is looked at, and the result is a plain filter.
    """
    binned = df.select(F.col(group_col).alias("_g"), F.col(position_col).alias("_p"),
                       F.floor(F.col(position_col) / width).alias("_run"))
    counts = binned.groupBy("_g", "_run").agg(F.count(F.lit(1)).alias("_n")).repartitionByRange("_g", "_run")
    counts = stored(counts.withColumn("_part", F.spark_partition_id()), "runs")
    earlier = F.sum("_part_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = counts.groupBy("_part").agg(F.sum("_n").alias("_part_n")).select(
        "_part", F.coalesce(earlier, F.lit(0)).alias("_part_before"))  # a row for each partition
    upto = F.col("_part_before") + F.col("_in_part")
    crossing = (counts.withColumn("_in_part", F.sum("_n").over(Window.partitionBy("_part").orderBy("_g", "_run")))
                .join(F.broadcast(totals), "_part")
                .withColumn("_before", upto - F.col("_n"))
                .where((F.col("_before") < max_rows) & (upto >= max_rows))
                .select(F.col("_g").alias("_h"), F.col("_run").alias("_s"), "_before"))
    # at most one run crosses the limit; none does when there are fewer rows than it
    inside = binned.join(F.broadcast(crossing), F.col("_g").eqNullSafe(F.col("_h"))
                         & F.col("_run").eqNullSafe(F.col("_s")))
    places = inside.groupBy("_g", "_p", "_before").agg(F.count(F.lit(1)).alias("_n"))
    reached = F.col("_before") + F.sum("_n").over(Window.orderBy("_p"))
    cut = (places.withColumn("_upto", reached).where(F.col("_upto") >= max_rows).orderBy("_upto")
           .select("_g", "_p", (max_rows - F.col("_upto") + F.col("_n")).alias("_take")).first())
    if max_rows <= 0:
        return df.limit(0)
    if cut is None:
        return df
    row = F.struct(F.col(group_col).alias("_g"), F.col(position_col).alias("_p"))
    last = F.struct(F.lit(cut["_g"]).cast(df.schema[group_col].dataType).alias("_g"),
                    F.lit(cut["_p"]).cast(df.schema[position_col].dataType).alias("_p"))
    return df.where(row < last).unionByName(df.where(row.eqNullSafe(last)).limit(cut["_take"]))
