"""Column functions over prompts and response text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a code fence and as white space in a response.
FENCE = r"(?U)```(?:json)?[\s\x1c-\x1f]*"
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
         "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_space(text: Column) -> Column:
    """Trim all white space; a bare ``trim`` would strip blanks only."""
    return F.btrim(text, F.lit(SPACE))


def strip_code_fences(text: Column) -> Column:
    """Drop fences anywhere, then white space and backticks at the end."""
    body = strip_space(F.regexp_replace(text, FENCE, ""))
    return strip_space(F.rtrim(body, F.lit("`")))


def render_prompt(codebook: Column, output_format: Column, lead_in: Column, post_type: Column,
                  opening: Column, text: Column, closing: Column) -> Column:
    """Codebook, answer format and the quoted post. Null text renders as an empty quote."""
    return F.concat(codebook, F.lit("\n"), output_format, lead_in, post_type, opening,
                    F.coalesce(text, F.lit("")), closing)


def format_metric(value: Column, digits: int = 2) -> Column:
    """``x.xx``, or ``n/a`` when undefined."""
    return (F.when(value.isNull() | F.isnan(value), "n/a")
            .otherwise(F.format_string(f"%.{digits}f", value)))
