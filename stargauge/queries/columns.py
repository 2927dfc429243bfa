"""Shared output columns of the checked queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded, because the order of a floating sum is not fixed."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), PLACES).alias(name or column)


def text_list(column: str, name: str | None = None) -> Column:
    return F.array_join(column, "|").alias(name or column)
