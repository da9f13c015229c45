"""Choose columns by name, type and role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def starts_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def all_numeric(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def all_nominal(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def all_predictors(df: DataFrame, roles: dict[str, str]) -> list[str]:
    """Every column whose role is not given as something else (``outcome``, ``id``, ...)."""
    return [c for c in df.columns if roles.get(c, "predictor") == "predictor"]
