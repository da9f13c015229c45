"""Projection, schema and filter operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def select_all_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Strict select: a missing name is an error."""
    _require(df, names)
    return df.select(*[quoted(n) for n in names])


def select_any_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Lenient select: missing names are ignored."""
    return df.select(*[quoted(n) for n in names if n in df.columns])


def drop_cols(df: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Negative select; ``strict`` rejects unknown names."""
    if strict:
        _require(df, names)
    return df.drop(*names)


def rename(df: DataFrame, new_names: dict[str, str]) -> DataFrame:
    """Rename ``{old: new}``."""
    _require(df, new_names)
    return df.withColumnsRenamed(new_names)


def mutate(df: DataFrame, **expressions: Column) -> DataFrame:
    """Add or replace columns one after another, so a later one sees an earlier one."""
    for name, expression in expressions.items():
        df = df.withColumn(name, expression)
    return df


def mutate_across(df: DataFrame, names: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same expression over many columns, in one projection."""
    _require(df, names)
    return df.withColumns({n: fn(quoted(n)) for n in names})


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows where the condition is true; a missing condition drops the row."""
    return df.filter(condition)


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """Add the other table's columns that are missing here, as typed nulls."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in like.schema if f.name not in df.columns}
    return df.withColumns(absent) if absent else df


def schema_presence(names: list[str], **tables: DataFrame) -> DataFrame:
    """One row per name: is it a column of each table?"""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, *[n in t.columns for t in tables.values()]) for n in names]
    fields = ", ".join(["name string"] + [f"in_{t} boolean" for t in tables])
    return spark.createDataFrame(rows, fields)


def column_difference(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c not in right.columns]


def pull_column(df: DataFrame, name: str, at_most: int = 10_000) -> list:
    """Values of a short table's column on the driver; a longer table is an error."""
    rows = df.select(quoted(name)).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"{name} has more than {at_most} rows; keep it as a DataFrame")
    return [r[0] for r in rows]
