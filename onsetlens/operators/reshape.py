"""Wide matrices to (row, column, value) and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def to_long(wide: DataFrame, ids: Sequence[str], column: str = "column", value: str = "value") -> DataFrame:
    """One row per id and column; columns must share a type."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], column, value)


def to_wide(long: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """One row per ``row``; the columns are named up front, so no extra job looks for them."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def transpose(wide: DataFrame, row: str, rows: Sequence, column: str = "column") -> DataFrame:
    """Exchange rows and columns; ``rows`` names the (few) values of ``row`` that become columns."""
    return to_wide(to_long(wide, [row], column, "value"), column, row, "value", rows)
