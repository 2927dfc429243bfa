"""The bundle of related DataFrames handed between operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Split:
    """The four entities of one split. A combined split has no reviews."""

    business: DataFrame
    user: DataFrame
    checkin: DataFrame
    review: DataFrame | None = None
