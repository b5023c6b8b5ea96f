"""Small tables the user supplies: raters, models, prompts, conditions, cases, quotas.

They are configuration: their size is fixed by the study design and not by the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Configuration of more bytes than this is joined without a hint.
MAX_DIM_BYTES = 8 << 20


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table held in the plan, so its size is known to the optimizer."""
    parsed = StructType.fromDDL(schema)
    return spark.createDataFrame(pd.DataFrame(rows, columns=parsed.names, dtype=object), parsed)


def join_dim(df: DataFrame, rows: list[tuple], schema: str, on: str | list[str],
             how: str = "inner") -> DataFrame:
    """Join configuration rows; broadcast while their size is below ``MAX_DIM_BYTES``."""
    dim = small_table(df.sparkSession, rows, schema)
    size = sum(len(v.encode()) if isinstance(v, str) else 8 for row in rows for v in row)
    return df.join(F.broadcast(dim) if size <= MAX_DIM_BYTES else dim, on, how)


def quoted(name: str) -> str:
    """A column name for use in an expression."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | int | float | bool | None) -> str:
    """A constant for use in an expression."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def struct_of(fields: dict[str, str]) -> str:
    """``named_struct`` over expressions."""
    return "named_struct(" + ", ".join(f"{literal(k)}, {v}" for k, v in fields.items()) + ")"


def inline_rows(rows: list[dict[str, str]]) -> str:
    """Fan a row out to one row per dict of expressions."""
    return "inline(array(" + ", ".join(map(struct_of, rows)) + "))"


def fan_out(rows: list[dict]) -> Column:
    """Fan a row out to one row per dict of constants, without a join."""
    return F.expr(inline_rows([{k: literal(v) for k, v in row.items()} for row in rows]))


def map_values(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Value lookup; values not in ``mapping`` become ``default``."""
    if not mapping:
        return default if default is not None else F.lit(None)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)
