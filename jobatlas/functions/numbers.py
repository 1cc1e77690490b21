"""Rounding on the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(c: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, correctly rounded."""
    return F.replace(F.format_number(c.cast("double"), digits), F.lit(","), F.lit(""))


def round_exact(c: Column, digits: int) -> Column:
    """Nearest double with ``digits`` decimals.

    ``round`` works on the shortest decimal text of a double and would turn 2.675, which
    is stored as slightly less, into 2.68; this gives 2.67.
    """
    return fixed_text(c, digits).cast("double")
