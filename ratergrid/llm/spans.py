"""Places of pattern matches in whole texts, with DataFrame functions and in time linear in the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Numbers of one block, whose totals are worked out apart.
_BLOCK = 128


def with_running_totals(df: DataFrame, name: str, sizes: Column) -> DataFrame:
    """``df`` with ``name``: the running totals of an array of numbers (NULL for NULL).

    Totals of blocks come first, then those of the blocks before each one, then those within it: about 64 n + n^2 / 2^15
    additions for n numbers. Each step is a column of its own that the next one uses twice, so it is worked out once and
    not put into the function that runs over the elements.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    df = df.withColumn("_sizes", sizes)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_sizes"), F.lit(1)), F.lit(_BLOCK))
    df = df.withColumn("_sums", F.when(F.col("_sizes").isNotNull(), F.transform(
        starts, lambda i: total(F.slice("_sizes", i, _BLOCK)))))
    df = df.withColumn("_before", F.when(F.col("_sums").isNotNull(), F.transform(
        "_sums", lambda _, i: total(F.slice("_sums", F.lit(1), i)))))

    def block(before: Column, k: Column) -> Column:
        return F.transform(F.slice("_sizes", k * _BLOCK + 1, F.lit(_BLOCK)),
                           lambda _, j: before + total(F.slice("_sizes", k * _BLOCK + 1, j + 1)))

    return df.withColumn(name, F.when(F.col("_sizes").isNotNull(), F.flatten(F.transform("_before", block)))).drop(
        "_sizes", "_sums", "_before")


def with_places(df: DataFrame, name: str, text: Column, pattern: str, possible: Column | None = None,
                gaps: bool = False) -> DataFrame:
    """``df`` with ``name``: array of (start, end, value) of the leftmost matches that don't overlap, in code points.

    ``possible`` says, cheaply, which rows can have matches at all; the others get an empty array. With ``gaps`` there is
    also ``gap``, the text between a match and the one before it. Matches are never empty.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_hits", hits if possible is None else F.when(possible, hits))
    some = F.size("_hits") > 0
    df = df.withColumn("_gaps", F.when(some, F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_hits"))))
    df = with_running_totals(df, "_ends", F.when(some, F.zip_with(
        "_gaps", "_hits", lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))))
    fields = ["_ends", "_hits", "_gaps"] if gaps else ["_ends", "_hits"]

    def place(z: Column) -> Column:
        parts = [(z["_ends"] - F.length(z["_hits"])).alias("start"), z["_ends"].alias("end"), z["_hits"].alias("value")]
        return F.struct(*parts, *([z["_gaps"].alias("gap")] if gaps else []))

    none = F.array().cast(f"array<struct<start:bigint,end:bigint,value:string{',gap:string' if gaps else ''}>>")
    return df.withColumn(name, F.coalesce(F.when(some, F.transform(F.arrays_zip(*fields), place)), none)).drop(
        "_hits", "_gaps", "_ends")
