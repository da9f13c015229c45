"""Equi-joins. Spark picks broadcast or sort-merge from the measured sizes."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.operators.columns import quoted

ROW_KEYS = ("id", "Orden")


def left_join_key(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """Keep all left rows; names both sides share outside the key get a suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, on, "left")


def join_indicator(left: DataFrame, right: DataFrame, on: list[str], name: str = "indicator") -> DataFrame:
    """Left join plus where each row was found: ``both`` or ``left_only``."""
    marked = left_join_key(left, right.withColumn(name, F.lit(True)), on)
    return marked.withColumn(name, F.when(quoted(name).isNull(), "left_only").otherwise("both"))


def left_join_natural(left: DataFrame, right: DataFrame, meant: bool = False) -> DataFrame:
    """Join on every shared name; outside the row keys a missing value matches a missing one, with a warning unless that is ``meant``.

    Rows meet by the row keys alone, the other names are compared on the pair: tables that lie by their row key stay where they are.
    """
    shared = [c for c in left.columns if c in right.columns]
    keys, extra = [c for c in shared if c in ROW_KEYS], [c for c in shared if c not in ROW_KEYS]
    if not shared:
        raise ValueError("the two tables share no column")
    if extra and not meant:
        warnings.warn(f"natural join also matches on {extra}", stacklevel=2)
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in shared})
    pairs = {c: (quoted(c), quoted(f"__right_{c}")) for c in shared}
    tests = [pairs[c][0] == pairs[c][1] for c in keys]
    # Without a row key the rows must meet by what they share.
    tests += [F.when(a.isNull(), b.isNull()).otherwise(F.coalesce(a == b, F.lit(False))) if keys else a.eqNullSafe(b) for a, b in (pairs[c] for c in extra)]
    return left.join(renamed, reduce(lambda x, y: x & y, tests), "left").drop(*[f"__right_{c}" for c in shared])


def left_join_project(left: DataFrame, right: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """Left join against a few columns of the right side."""
    return left.join(right.select(*[quoted(c) for c in [*on, *columns]]), on, "left")


def right_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "right")


def anti_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with no partner; only the key of the right side is read."""
    return left.join(right.select(*[quoted(c) for c in on]), on, "left_anti")


def assemble_packs(base: DataFrame, *packs: DataFrame, on: str = "id") -> DataFrame:
    """Star of left joins on the household key; other names two tables share must match too."""
    for pack in packs:
        shared = [c for c in pack.columns if c in base.columns and c != on]
        base = left_join_natural(base, pack, meant=True) if shared else base.join(pack, on, "left")
    return base
