"""Survey code recodes as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.nulls import as_column, r_ifelse

def recode(column: Column, mapping: dict, default=None) -> Column:
    """Code map; a code that is not listed becomes ``default``, one that is listed as missing stays missing."""
    fallback = as_column(default)
    result = None
    for code, value in mapping.items():
        test = column == F.lit(code)
        result = F.when(test, as_column(value)) if result is None else result.when(test, as_column(value))
    return fallback if result is None else result.otherwise(fallback)


def yes_no(column: Column) -> Column:
    """2 (no) and 9 (unknown) become 0; 1 and missing stay."""
    return F.when(column.isin(2, 9), F.lit(0)).otherwise(column)


def yes_no_family(df: DataFrame, names: list[str]) -> DataFrame:
    """``yes_no`` over several columns, each tested on its own codes."""
    return df.withColumns({n: yes_no(F.col(n)) for n in names})


def zero_amount_means_no(flag: Column, amount: Column, where: Column) -> Column:
    """A stated amount of 0 turns "yes" into "no" (2) on the rows chosen by ``where``."""
    return r_ifelse((amount == 0) & where, 2, flag)


def to_factor(column: Column, labels: dict) -> Column:
    """Code to label by an explicit map, so labels never shift when a code is absent."""
    return recode(column, labels)


def as_factor(column: Column) -> Column:
    return column.cast("string")


def as_character(column: Column) -> Column:
    return column.cast("string")


def as_numeric(column: Column) -> Column:
    """Number, or missing when the text is none."""
    return column.try_cast("double")


def event_label(column: Column, event) -> Column:
    """1.0 for the event class, 0.0 for the others, missing stays missing."""
    return r_ifelse(column == F.lit(event), 1.0, 0.0)


def event_name(label: Column, event: str = "si", other: str = "no") -> Column:
    return r_ifelse(label == 1, event, other)


def rename_values(column: Column, names: dict[str, str]) -> Column:
    """Dictionary lookup by key; values that are not listed stay."""
    return F.coalesce(recode(column, names), column)
