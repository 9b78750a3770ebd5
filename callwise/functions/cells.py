"""Column expressions for raw cells: missing tokens, numbers, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwise.config import FIRST_CALL, MISSING_TOKENS


def null_if_missing(col: Column, tokens=MISSING_TOKENS) -> Column:
    """Null where the cell holds one of the texts that mean "no value"."""
    return F.when(~col.isin(*tokens), col)


def filled(col: Column, sentinel: str = FIRST_CALL) -> Column:
    """The cell as text, with the sentinel for null."""
    return F.coalesce(col.cast("string"), F.lit(sentinel))


def filled_blank(col: Column, sentinel: str = FIRST_CALL) -> Column:
    """Like ``filled``, and for the empty string too."""
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(sentinel))


def number_or_zero(col: Column) -> Column:
    """The cell as a double; 0 where it is null or no number.

    Java reads ``1d`` and ``1f`` as numbers; a trailing type letter is no number here.
    """
    text = F.trim(col.cast("string"))
    parsed = F.when(~text.rlike("^[+-]?[0-9.].*[dDfF]$"), text).try_cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(None).cast("double")), F.lit(0.0))


def context_text(notes: Column, prev_outcome: Column) -> Column:
    """Notes and previous outcome in one text, nulls as empty."""
    return F.concat(F.coalesce(notes, F.lit("")), F.lit(" | "), F.coalesce(prev_outcome, F.lit("")))


def one_line(col: Column) -> Column:
    """Text without outer white space, line breaks as spaces."""
    return F.replace(F.regexp_replace(col, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), F.lit("\n"), F.lit(" "))
