"""Missing-value rules that a plain translation to Spark would get wrong."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def r_ifelse(condition: Column, yes, no) -> Column:
    """``yes`` where true, ``no`` where false, missing where the condition is missing."""
    return F.when(condition, as_column(yes)).when(~condition, as_column(no))


def in_set(column: Column, values: Iterable) -> Column:
    """Membership that is false, never missing, for a missing value."""
    return F.coalesce(column.isin(*values), F.lit(False))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def safe_log(column: Column) -> Column:
    """Natural log of positive values, 0 for zero or below, missing stays missing."""
    value = F.nullif(column.cast("double"), F.lit(float("nan")))
    return F.when(value > 0, F.log(value)).when(value <= 0, F.lit(0.0))


def safe_divide(top: Column, bottom: Column) -> Column:
    """Ratio as double; missing where the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def replace_na(df: DataFrame, values: dict) -> DataFrame:
    """Per-column fill of null and NaN; an unknown column is an error."""
    unknown = [c for c in values if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not found: {unknown}")
    return df.fillna(values)


def drop_na(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Keep complete rows only; NaN counts as missing.

    One condition per column: they are pushed down one by one, and unlike a single
    "at least n known" test they do not multiply in the optimizer.
    """
    known = [~is_missing(df, c) for c in (subset or df.columns)]
    return df.filter(reduce(lambda a, b: a & b, known))
