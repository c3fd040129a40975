"""Ordered top-k per anchor, and the text order used to break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def locale_order(name: str | Column) -> Column:
    """Root-locale order of a text column (letters before case, punctuation first)."""
    column = F.col(name) if isinstance(name, str) else name
    return F.collate(column, "UNICODE")


def comparable(score: str | Column = "score") -> Column:
    """A score rounded for comparison.

    Distributed sums depend on the order of addition in their last digits; without the
    rounding, two equal scores would be ordered by noise instead of by file.
    """
    return F.round(score, 10)


def top_ranked(scores: DataFrame, keys: list, limit: int, file="file", score="score") -> DataFrame:
    """Rank by score descending, then file, and keep ``limit`` rows per key.

    The rank filter sits directly on the window so that the planner also limits each
    group before the shuffle.
    """
    is_text = isinstance(scores.schema[file].dataType, StringType)
    ties = [locale_order(file), F.col(file)] if is_text else [F.col(file)]
    order = Window.partitionBy(*keys).orderBy(comparable(score).desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
