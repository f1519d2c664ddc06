"""Filter, project, limit: the common view of any source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPARISONS = {
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
}


def apply_filters(df: DataFrame, filters: Mapping | None) -> DataFrame:
    """Keep rows meeting every filter: `{c: value}`, `{c: [values]}`, `{c: {gte|lte|gt|lt: value}}`."""
    for name, wanted in (filters or {}).items():
        c = F.col(name)
        if isinstance(wanted, Mapping):
            unknown = set(wanted) - set(_COMPARISONS)
            if unknown:
                raise ValueError(f"unknown comparison for {name}: {sorted(unknown)}")
            for word, value in wanted.items():
                df = df.where(_COMPARISONS[word](c, value))
        elif isinstance(wanted, (list, tuple, set)):
            df = df.where(c.isin(list(wanted)))
        else:
            df = df.where(c == wanted)
    return df


def view(
    df: DataFrame,
    filters: Mapping | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter first, then project, then limit, so a filter may use a column that is not selected."""
    df = apply_filters(df, filters)
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit else df
