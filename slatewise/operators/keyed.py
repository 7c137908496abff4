"""One row per key where a table holds several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(rows: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(pick(row, F.col(order)).alias("row")).select("row.*")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the least order."""
    return _one(rows, keys, order, F.min_by)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order."""
    return _one(rows, keys, order, F.max_by)
