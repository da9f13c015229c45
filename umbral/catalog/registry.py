"""Where queries are registered next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``sql`` is left out where SQL cannot say it."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(apply_settings(spark), sf_dir)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r6(column: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero: sums of doubles differ in the last digits between engines.

    The checking engine scales a double and rounds that number. Spark's own rounding reads its decimal digits, which differs where a value lies halfway.
    """
    column = F.col(column) if isinstance(column, str) else column
    scale = F.lit(10.0**places)
    return F.round(column * scale) / scale + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, places) for n in names})
