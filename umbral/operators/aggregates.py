"""Group aggregates. All of them combine map-side, so a hot household stays cheap.

The expression builders let one ``groupBy().agg()`` carry many results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.nulls import safe_divide


def sum_or_zero(column: Column) -> Column:
    """Sum that ignores missing values and is 0 when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def any_flag(column: Column) -> Column:
    """1 if the group's sum is above 0, else 0."""
    return F.when(sum_or_zero(column) > 0, 1).otherwise(0)


def mean_where(column: Column, condition: Column) -> Column:
    """Mean over the members that meet the condition; missing when none does."""
    return F.avg(F.when(condition, column))


def count_where(df: DataFrame, condition: Column, name: str = "count") -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def group_sum(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """``names`` maps the input column to the output column."""
    return df.groupBy(key).agg(*[sum_or_zero(F.col(c)).alias(o) for c, o in names.items()])


def group_rate(df: DataFrame, key: str, names: dict[str, str], size: str | None = None) -> DataFrame:
    """Sum over the group ÷ its stated size column, or ÷ its number of rows."""
    divisor = F.max(size) if size else F.count(F.lit(1))
    return df.groupBy(key).agg(*[safe_divide(sum_or_zero(F.col(c)), divisor).alias(o) for c, o in names.items()])


def group_any(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    return df.groupBy(key).agg(*[any_flag(F.col(c)).alias(o) for c, o in names.items()])


def group_size(df: DataFrame, key: str, name: str = "size") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def group_mean(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(column).alias(name))


def group_mean_if(df: DataFrame, key: str, column: str, condition: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(mean_where(F.col(column), condition).alias(name))
