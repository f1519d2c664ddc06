"""Column names that may hold dots, spaces or backticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(column: str) -> str:
    """The name as SQL."""
    return "`" + column.replace("`", "``") + "`"


def named(column: str) -> Column:
    """The column with exactly this name."""
    return F.col(quoted(column))
