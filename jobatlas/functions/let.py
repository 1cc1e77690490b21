"""Bind an intermediate column value so that array functions evaluate it once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time, also inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
