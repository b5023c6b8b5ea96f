"""Query registry and the SQL building blocks of the checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ratergrid.plans.fixtures import FIXTURE_SQL

REGISTRY: dict[str, Query] = {}

# Fixtures that others name several times: worked out once.
HEAVY = {"fx_latest", "fx_ratings", "fx_conditions", "full_units"}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)``. Double columns are rounded, as the SQL does, for comparison."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)
        run.__name__ = run.__qualname__ = name
        REGISTRY[name] = Query(run, sql)
        return fn
    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


# ------------------------------------------------------------------------------------- SQL pieces

def r6(expr: str) -> str:
    return f"(ROUND(CAST({expr} AS DOUBLE), 6) + 0.0)"


def printed(expr: str, digits: int = 3) -> str:
    """Correctly rounded, half to even on the stored value."""
    return f"(CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0)"


def scaled(expr: str, digits: int = 3) -> str:
    return f"(ROUND_EVEN(CAST({expr} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def with_ctes(ctes: dict[str, str], select: str) -> str:
    """``WITH`` the named fixtures the texts mention, in order, then the given tables."""
    texts = list(ctes.values()) + [select]
    needed: dict[str, str] = {}

    def require(text: str) -> None:
        for name, body in FIXTURE_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                require(body)
                needed.setdefault(name, body)

    for text in texts:
        require(text)
    parts = [f"{name} AS {'MATERIALIZED ' if name in HEAVY else ''}({body})"
             for name, body in {**needed, **ctes}.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def on(by: list[str], left: str = "x", right: str = "y") -> str:
    return " AND ".join(f"{left}.{c} = {right}.{c}" for c in by)


def cols(by: list[str], table: str = "") -> str:
    return ", ".join(f"{table}.{c}" if table else c for c in by)


def alpha_ctes(src: str, by: list[str], tag: str = "al") -> dict[str, str]:
    """Ordinal alpha from rows (by, unit_id, score); the result is the table ``{tag}``."""
    b, x = cols(by), cols(by, "x")
    ids = [*by, "unit_id"]
    gap = f"(y.up - x.up + x.n - (x.n + y.n) / 2.0)"
    return {
        f"{tag}_u": f"SELECT {b}, unit_id, score, COUNT(*) AS n FROM {src} GROUP BY {b}, unit_id, score",
        f"{tag}_m": f"SELECT {b}, unit_id, SUM(n) AS m FROM {tag}_u GROUP BY {b}, unit_id HAVING SUM(n) >= 2",
        f"{tag}_o": f"SELECT {x}, x.score AS c, y.score AS k, SUM(x.n * (y.n - CASE WHEN x.score = y.score "
                    f"THEN 1 ELSE 0 END) / (z.m - 1.0)) AS o FROM {tag}_u x JOIN {tag}_u y ON {on(ids)} "
                    f"JOIN {tag}_m z ON {on(ids, 'x', 'z')} GROUP BY {x}, x.score, y.score",
        f"{tag}_n": f"SELECT {b}, c, SUM(o) AS n FROM {tag}_o GROUP BY {b}, c",
        f"{tag}_c": f"SELECT {b}, c, n, SUM(n) OVER (PARTITION BY {b} ORDER BY c) AS up FROM {tag}_n",
        f"{tag}_d": f"SELECT {x}, SUM(COALESCE(o.o, 0) * {gap} * {gap}) AS num, "
                    f"SUM(x.n * y.n * {gap} * {gap}) AS den FROM {tag}_c x JOIN {tag}_c y ON {on(by)} "
                    f"AND x.c < y.c LEFT JOIN {tag}_o o ON {on(by, 'x', 'o')} AND o.c = x.c AND o.k = y.c "
                    f"WHERE x.n > 0 AND y.n > 0 GROUP BY {x}",
        f"{tag}_t": f"SELECT {b}, COUNT(*) AS n_units, SUM(m) AS n_ratings FROM {tag}_m GROUP BY {b}",
        tag: f"SELECT {x}, CAST(x.n_units AS BIGINT) AS n_units, CAST(x.n_ratings AS BIGINT) AS n_ratings, "
             f"CASE WHEN y.den > 0 THEN 1 - (x.n_ratings - 1) * y.num / y.den END AS alpha "
             f"FROM {tag}_t x LEFT JOIN {tag}_d y ON {on(by)}",
    }


def pair_ctes(src: str, by: list[str], tag: str = "st") -> dict[str, str]:
    """Two-rater statistics from rows (by, a, b), ranks taken over the rows; result ``{tag}``.

    Ranks are doubled and centred, so the sums behind rho are exact integers and a rho that lies on a
    rounding tie does not depend on the order in which rows are read.
    """
    b = cols(by)
    rank = lambda v: (f"2 * RANK() OVER (PARTITION BY {b} ORDER BY {v}) + COUNT(*) OVER (PARTITION BY {b}, {v}) "
                      f"- 2 - COUNT(*) OVER (PARTITION BY {b})")
    total = lambda x, y: f"CAST(SUM({x} * {y}) AS DOUBLE)"
    return {
        f"{tag}_r": f"SELECT {b}, a, b, {rank('a')} AS ra, {rank('b')} AS rb FROM {src}",
        tag: f"SELECT {b}, COUNT(*) AS n, CASE WHEN MIN(a) < MAX(a) AND MIN(b) < MAX(b) THEN "
             f"{total('ra', 'rb')} / SQRT({total('ra', 'ra')} * {total('rb', 'rb')}) END AS rho, "
             f"AVG(ABS(a - b)) AS mad, AVG(a - b) AS msd, "
             f"AVG(CASE WHEN a = b THEN 1 ELSE 0 END) AS pct_exact FROM {tag}_r GROUP BY {b}",
    }


def p_ctes(src: str, by: list[str], tag: str = "pv") -> dict[str, str]:
    """Two-sided p of ``rho`` over ``n`` pairs: the finite series of the t distribution."""
    b = cols(by)
    even = ("EXP(LGAMMA(j + 0.5) - LGAMMA(j + 1.0) - 0.5 * LN(PI()) + j * LN(1 - rho * rho))")
    odd = ("EXP(LGAMMA(j + 1.0) - LGAMMA(j + 1.5) + 0.5 * LN(PI()) - LN(2.0) "
           "+ (j + 0.5) * LN(1 - rho * rho))")
    return {
        f"{tag}_s": f"SELECT {b}, rho, n - 2 AS df FROM {src} WHERE rho IS NOT NULL AND n > 2 "
                    f"AND ABS(rho) < 1 - 1e-15",
        f"{tag}_j": f"SELECT {b}, rho, df, UNNEST(GENERATE_SERIES(0, CASE WHEN df % 2 = 0 THEN df // 2 - 1 "
                    f"ELSE (df - 1) // 2 - 1 END)) AS j FROM {tag}_s WHERE df > 1",
        f"{tag}_t": f"SELECT {b}, SUM(CASE WHEN df % 2 = 0 THEN {even} ELSE {odd} END) AS series "
                    f"FROM {tag}_j GROUP BY {b}",
        tag: f"SELECT {cols(by, 'x')}, CASE WHEN x.rho IS NULL OR x.n <= 2 THEN NULL "
             f"WHEN ABS(x.rho) >= 1 - 1e-15 THEN 0.0 WHEN (x.n - 2) % 2 = 0 "
             f"THEN 1 - ABS(x.rho) * COALESCE(y.series, 0) "
             f"ELSE 1 - 2 / PI() * (ASIN(ABS(x.rho)) + ABS(x.rho) * COALESCE(y.series, 0)) END AS p "
             f"FROM {src} x LEFT JOIN {tag}_t y ON {on(by)}",
    }
