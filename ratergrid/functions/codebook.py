"""Scale rules: a rating from yes/no factors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which rule each variable follows.
TWO_FACTOR_VARS = ["V1", "V5", "V6", "V8"]
ACT_VARS = ["V2", "V3"]
CANDIDATE_VARS = ["V4"]
DISTANCE_VARS = ["V7"]


def codebook_rating(variable: str, a: Column, b: Column | None = None,
                    b1: Column | None = None, b2: Column | None = None) -> Column:
    """Rating 1-3 from factors A and B (two-factor scales) or A, B1 and B2.

    Factor combinations the scale does not define give NULL.
    """
    if variable in TWO_FACTOR_VARS:
        return F.lit(1) + a.cast("int") + b.cast("int")
    none, both, either = ~a & ~b1 & ~b2, b1 & b2, b1 | b2
    if variable in ACT_VARS:
        return F.when(none, 1).when(~a & either, 2).when(a & both, 3)
    if variable in CANDIDATE_VARS:
        return F.when(none, 1).when(a & ~either, 2).when(a & both, 3)
    if variable in DISTANCE_VARS:
        return F.when(none, 1).when(a & ~either, 2).when(a & either, 3)
    raise ValueError(f"no scale rule for {variable!r}")
