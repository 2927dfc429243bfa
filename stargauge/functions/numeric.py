"""Expressions on ratings, counts and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_coordinate(value: Column) -> Column:
    """Two places, halves away from zero."""
    return F.round(value, 2)


def fill(value: Column, replacement: Column | float) -> Column:
    return F.coalesce(value, F.lit(replacement))


def first_positive(*values: Column, otherwise: Column) -> Column:
    """The first value above zero; NULL and zero fall through to the next."""
    return F.coalesce(*[F.when(value > 0, value) for value in values], otherwise)


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a prediction; NULL stays NULL and an absent bound does nothing."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def map_total(counts: Column) -> Column:
    """Sum over the values of a map, 0 for a missing map; needs no shuffle."""
    total = F.aggregate(
        F.map_values(counts), F.lit(0).cast("bigint"), lambda acc, n: acc + F.coalesce(n, F.lit(0))
    )
    return F.coalesce(total, F.lit(0).cast("bigint"))


def rmse(truth: Column, prediction: Column) -> Column:
    """Root mean squared error as an aggregate over the rows with both values."""
    return F.sqrt(F.avg(F.pow(truth - prediction, F.lit(2))))


def held_out(key: Column, fold: Column, share: float) -> Column:
    """Whether a row belongs to a fold's hold-out of about ``share`` of all rows.

    The first 32 bits of a hash of fold and key are compared with the share, as hexadecimal
    text, which sorts like the numbers do.
    """
    if share >= 1:
        return F.lit(True)
    digest = F.md5(F.concat_ws("|", fold.cast("string"), key.cast("string")))
    return digest < F.lit(f"{int(share * 2**32):08x}")
