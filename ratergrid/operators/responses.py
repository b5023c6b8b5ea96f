"""Model responses: parse, validate, flatten, and choose among attempts.

Works on a log (unit_id, rater, attempt, raw_text, error) with one row per call.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ratergrid.functions.text import strip_code_fences
from ratergrid.schemas import RAW_RESPONSE_SCHEMA, SCORE_COLS, VALID_SCORES, annotation_schema

# Attempts per call and seconds of back-off per failed attempt.
MAX_ATTEMPTS = 10
RETRY_WAIT = 15

KEY = ["unit_id", "rater"]
# What can be wrong with a response.
ERROR_CODES = ["provider", "parse", "missing_variable", "invalid_score", "missing_reason"]
#: What a call is made with, and how many finished calls, or seconds of them, are handed on together.
CALL_COLS = [*KEY, "text", "post_type", "prompt", "system_prompt"]
HAND_ON, HAND_ON_SECONDS = 500, 5.0


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns whose values are fixed here.

    A filter on a plain derived column is pushed below it with its whole expression, so a parse
    would run once per mention. Filters stay above a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def parse_annotation_json(df: DataFrame, variables: list[str] = SCORE_COLS,
                          raw: str = "raw_text") -> DataFrame:
    """Adds ``cleaned``, ``annotation`` (a struct per variable) and ``parsed``.

    ``parsed`` is true only when the cleaned text is one JSON value and nothing else. Spark's reader
    ignores what follows a value, so the text is read twice inside an envelope: as an array it must
    hold one element, as a member it must leave the closing marker readable.
    """
    envelope = T.StructType([T.StructField("body", annotation_schema(variables)),
                             T.StructField("end", T.IntegerType())])
    text = F.col("cleaned")
    read = F.from_json(F.concat(F.lit('{"body":'), text, F.lit(',"end":1}')), envelope,
                       {"allowSingleQuotes": "false"})
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return (df.transform(computed_once, cleaned=strip_code_fences(F.col(raw)))
            .transform(computed_once, _read=read, _single=single)
            .withColumn("parsed", F.coalesce((F.col("_read.end") == 1) & F.col("_single"),
                                             F.lit(False)))
            .withColumn("annotation", F.when(F.col("parsed"), F.col("_read.body")))
            .drop("_read", "_single"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def score_value(variant: Column) -> Column:
    """Numeric value of a score: numbers in any notation, true as 1; text is not a number."""
    kind = _kind(variant)
    number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return (F.when(number, F.try_variant_get(variant, "$", "double"))
            .when(kind == "BOOLEAN", F.try_variant_get(variant, "$", "boolean").cast("double")))


def validate_annotation(df: DataFrame, variables: list[str] = SCORE_COLS,
                        values: list[int] = VALID_SCORES, error: str | None = None) -> DataFrame:
    """Adds ``error_code``, ``error_variable`` (the first problem found, NULL if none) and ``valid``."""
    checks: list[tuple[Column, str, str | None]] = []
    if error:
        checks.append((F.col(error).isNotNull(), "provider", None))
    checks.append((~F.col("parsed"), "parse", None))
    for v in variables:
        score = score_value(F.col(f"annotation.{v}.score"))
        checks.append((F.col(f"annotation.{v}").isNull(), "missing_variable", v))
        checks.append((~F.coalesce(score.isin([float(x) for x in values]), F.lit(False)),
                       "invalid_score", v))
    checks += [(F.col(f"annotation.{v}.{v}_reason").isNull(), "missing_reason", v)
               for v in variables]
    problem = F.coalesce(*[
        F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(v).cast("string").alias("variable")))
        for bad, code, v in checks])
    return (df.transform(computed_once, _problem=problem)
            .withColumns({"error_code": F.col("_problem.code"),
                          "error_variable": F.col("_problem.variable"),
                          "valid": F.col("_problem").isNull()})
            .drop("_problem"))


def flatten_annotation(df: DataFrame, variables: list[str] = SCORE_COLS) -> DataFrame:
    """Valid rows as columns V*, V*_reason and total_score."""
    scores = {v: score_value(F.col(f"annotation.{v}.score")).cast("int") for v in variables}
    reasons = {f"{v}_reason": F.try_variant_get(F.col(f"annotation.{v}.{v}_reason"), "$", "string")
               for v in variables}
    keep = [c for c in df.columns if c not in ("annotation", "cleaned", "parsed", "valid",
                                               "error_code", "error_variable")]
    out = [c.alias(name) for v in variables
           for name, c in ((v, scores[v]), (f"{v}_reason", reasons[f"{v}_reason"]))]
    return (df.where("valid").select(*keep, *out)
            .withColumn("total_score", reduce(add, [F.col(v) for v in variables])))


def read_responses(df: DataFrame, variables: list[str] = SCORE_COLS,
                   error: str | None = None) -> DataFrame:
    return (df.transform(parse_annotation_json, variables)
            .transform(validate_annotation, variables, VALID_SCORES, error))


def first_valid_attempt(responses: DataFrame, variables: list[str] = SCORE_COLS,
                        keys: list[str] = KEY, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The flattened annotation of the first valid attempt per key, from validated responses."""
    return first_attempt(flatten_annotation(responses, variables), variables, keys, max_attempts)


def first_attempt(flat: DataFrame, variables: list[str] = SCORE_COLS, keys: list[str] = KEY,
                  max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The first attempt per key among flattened valid ones."""
    scores = [c for v in variables for c in (v, f"{v}_reason")]
    flat = flat.where(F.col("attempt") <= max_attempts)
    first = F.min(F.struct("attempt", *scores, "total_score")).alias("first")
    return flat.groupBy(*keys).agg(first).select(*keys, "first.*")


def failed_keys(responses: DataFrame, keys: list[str] = KEY,
                max_attempts: int = MAX_ATTEMPTS, variables: list[str] = SCORE_COLS) -> DataFrame:
    """Keys without a valid attempt, with the number of attempts and the last error.

    Attempt, error and variable travel as one number, which a hash aggregate can hold. Rows that repeat an attempt
    differ at most in their error: the one that is last by code, then by variable, counts.
    """
    codes, names = sorted(ERROR_CODES), sorted(variables)
    code = F.coalesce(*[F.when(F.col("error_code") == c, F.lit(i)) for i, c in enumerate(codes, 1)], F.lit(0))
    name = F.coalesce(*[F.when(F.col("error_variable") == v, F.lit(i)) for i, v in enumerate(names, 1)], F.lit(0))
    width = len(names) + 1
    last = F.max((F.col("attempt").cast("bigint") * (len(codes) + 1) + code) * width + name).alias("_last")
    listed = lambda items, i: F.try_element_at(F.array(*[F.lit(x) for x in items]), F.nullif(i.cast("int"), F.lit(0)))
    return (responses.where(F.col("attempt") <= max_attempts).groupBy(*keys)
            .agg(F.max("valid").alias("any_valid"), F.count(F.lit(1)).alias("attempts"), last)
            .where(~F.col("any_valid"))
            .select(*keys, "attempts",
                    listed(codes, F.floor(F.col("_last") / width) % (len(codes) + 1)).alias("last_error"),
                    listed(names, F.col("_last") % width).alias("last_variable")))


def retry_wait_seconds(responses: DataFrame, keys: list[str] = KEY,
                       max_attempts: int = MAX_ATTEMPTS, wait: int = RETRY_WAIT) -> DataFrame:
    """Back-off per key: each failed attempt but the last allowed waits ``wait`` x its number."""
    waits = ~F.col("valid") & (F.col("attempt") < max_attempts)
    seconds = F.sum(F.when(waits, F.col("attempt") * wait).otherwise(0))
    return responses.groupBy(*keys).agg(seconds.cast("bigint").alias("wait_seconds"))


def error_breakdown(responses: DataFrame) -> DataFrame:
    return (responses.where(F.col("error_code").isNotNull()).groupBy("error_code")
            .agg(F.count(F.lit(1)).alias("n")))


def annotations_to_ratings(annotations: DataFrame, variables: list[str] = SCORE_COLS,
                           keys: list[str] = KEY) -> DataFrame:
    return annotations.unpivot(list(keys), variables, "variable", "score")


def annotator_hook(work: DataFrame, fn: Callable[[str, str, str, str], str],
                   max_attempts: int = 1, tasks: int | None = None) -> DataFrame:
    """Run a user's scorer over planned work and log one row per call.

    ``tasks`` is how many calls run at a time (cluster cores permitting); without it the partitions of
    ``work`` decide, and few rows may then be few tasks.

    ``work`` holds unit_id, rater, text, post_type, prompt and system_prompt. ``fn`` takes the last
    four and returns the response text; what it raises is logged, and the call is tried again up to
    ``max_attempts`` times. Rows of finished calls are handed on every few seconds. What a task has called is lost
    with the task; ``streaming.call_log`` makes calls in batches that are not.
    """
    names = RAW_RESPONSE_SCHEMA.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, since = [], time.monotonic()
        for batch in batches:
            for row in batch.itertuples(index=False):
                for attempt in range(1, max_attempts + 1):
                    try:
                        raw, error = fn(row.text, row.post_type, row.prompt, row.system_prompt), None
                    except Exception as exc:  # the scorer is user code
                        raw, error = None, f"{type(exc).__name__}: {exc}"
                    log.append((row.unit_id, row.rater, attempt, raw, error))
                    if error is None:
                        break
                if len(log) >= HAND_ON or time.monotonic() - since > HAND_ON_SECONDS:
                    yield pd.DataFrame(log, columns=names)
                    log, since = [], time.monotonic()
        if log:
            yield pd.DataFrame(log, columns=names)

    inputs = work.select(F.col("unit_id").cast("string").alias("unit_id"), *CALL_COLS[1:])
    if tasks:  # a stated number is not merged by adaptive execution
        inputs = inputs.repartition(tasks, F.xxhash64("unit_id", "rater"))
    return inputs.mapInPandas(run, RAW_RESPONSE_SCHEMA)
