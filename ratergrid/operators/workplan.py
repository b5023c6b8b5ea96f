"""Planning annotation work: what to run, with which prompt, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratergrid.dims import fan_out, join_dim, literal, quoted, struct_of
from ratergrid.functions.text import render_prompt

PROMPT_SCHEMA = ("prompt_variant string, codebook string, output_format string, lead_in string, "
                 "opening string, closing string")

#: Bits of the filter of posts with open work. It is broadcast in words of 64, at most 262,144 rows.
OPEN_FILTER_BITS = 1 << 24


def work_plan_cross(posts: DataFrame, labels: list[dict]) -> DataFrame:
    """Every post with every model, prompt variant or condition. Fans out in place, no join."""
    return posts.select("*", fan_out(labels))


def _done_flags(done: DataFrame, post_col: str, label_col: str, names: list) -> DataFrame:
    """One row per post with a flag per label: done keys shrink before they are shuffled."""
    flags = [F.max(F.col(label_col) == n).alias(f"_done{i}") for i, n in enumerate(names)]
    return done.where(F.col(label_col).isin(names)).groupBy(post_col).agg(*flags)


def may_be_open(posts: DataFrame, flags: DataFrame, post_col: str, n_labels: int) -> DataFrame:
    """Posts that lack a label, and few others: ids alone meet the flags, and a filter of fixed size meets the posts.

    No post with open work is lost. With more than some millions of these the filter lets ever more done posts pass.
    """
    place = f"pmod(xxhash64({quoted(post_col)}), {OPEN_FILTER_BITS}L)"
    finished = " AND ".join(f"coalesce(_done{i}, false)" for i in range(n_labels))
    words = (posts.select(post_col).join(flags, post_col, "left").where(f"NOT ({finished})")
             .groupBy(F.expr(f"shiftright({place}, 6)").alias("_open_word"))
             .agg(F.expr(f"bit_or(shiftleft(1L, CAST({place} % 64 AS INT)))").alias("_open_bits")))
    hit = (f"shiftright({place}, 6) = _open_word AND "
           f"(shiftright(_open_bits, CAST({place} % 64 AS INT)) & 1L) = 1L")
    return posts.join(F.broadcast(words), F.expr(hit), "left_semi")


def remaining_work(posts: DataFrame, labels: list[dict], done: DataFrame, post_col: str,
                   label_col: str) -> DataFrame:
    """The plan without completed (post, label) keys.

    Done posts are dropped where they are read. What ``may_be_open`` leaves meets its flags once, before the fan-out,
    so text is neither shuffled for done posts nor once per label.
    """
    names = [row[label_col] for row in labels]
    flags = _done_flags(done, post_col, label_col, names)
    flagged = may_be_open(posts, flags, post_col, len(names)).join(flags, post_col, "left")
    items = ", ".join(
        "named_struct('done', coalesce(_done%d, false), 'label', %s)"
        % (i, struct_of({k: literal(v) for k, v in row.items()})) for i, row in enumerate(labels))
    still_open = f"transform(filter(array({items}), x -> NOT x.done), x -> x.label)"
    return flagged.select(*posts.columns, F.expr(f"inline({still_open})"))


def progress_report(posts: DataFrame, labels: list[dict], done: DataFrame, post_col: str,
                    label_col: str) -> DataFrame:
    """Planned, completed and remaining calls. Done keys outside the plan do not count."""
    names = [row[label_col] for row in labels]
    flagged = (posts.select(post_col)
               .join(_done_flags(done, post_col, label_col, names), post_col, "left"))
    finished = sum((F.coalesce(F.col(f"_done{i}").cast("int"), F.lit(0))
                    for i in range(len(names))), F.lit(0))
    total = (F.count(F.lit(1)) * len(names)).alias("total")
    return flagged.agg(total, F.coalesce(F.sum(finished), F.lit(0)).alias("done")).select(
        "total", "done", (F.col("total") - F.col("done")).alias("remaining"))


def build_prompt(plan: DataFrame, prompts: list[tuple], text: str = "text",
                 post_type: str = "post_type") -> DataFrame:
    """Adds ``prompt``, rendered from the variant's codebook and wording (``PROMPT_SCHEMA`` rows)."""
    joined = join_dim(plan, prompts, PROMPT_SCHEMA, "prompt_variant")
    rendered = render_prompt(F.col("codebook"), F.col("output_format"), F.col("lead_in"),
                             F.col(post_type), F.col("opening"), F.col(text), F.col("closing"))
    return joined.select(*plan.columns, rendered.alias("prompt"))


def add_prompt_length(df: DataFrame, col: str = "prompt") -> DataFrame:
    return df.withColumn("prompt_length", F.length(col))


def system_prompt_lookup(plan: DataFrame, prompts: dict[str, str],
                         on: str = "condition") -> DataFrame:
    """Adds the system prompt of each row's condition."""
    return join_dim(plan, list(prompts.items()), f"{on} string, system_prompt string", on, "left")
