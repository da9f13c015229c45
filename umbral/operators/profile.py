"""Missing-value profiles, frequency tables, summaries and consistency rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.functions.nulls import is_missing
from umbral.operators.columns import quoted
from umbral.operators.running import exact_quantiles, known_value, quantile_sketch


def null_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(name, missing, percent)`` per column from one pass over the table."""
    names = names or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(is_missing(df, n)).alias(f"__m{i}") for i, n in enumerate(names)],
    )
    entries = [F.struct(F.lit(n).alias("name"), F.col(f"__m{i}").alias("missing")) for i, n in enumerate(names)]
    long = counts.select("__rows", F.inline(F.array(*entries)))
    return long.select("name", "missing", F.try_divide(F.col("missing") * 100.0, F.col("__rows")).alias("percent"))


def null_profile_where(df: DataFrame, condition: Column, names: list[str] | None = None) -> DataFrame:
    """The same profile for a sub-population."""
    return null_profile(df.filter(condition), names)


def null_profile_compare(train: DataFrame, test: DataFrame) -> DataFrame:
    """Missing percent side by side, each table divided by its own rows."""
    left = null_profile(train).select("name", F.col("percent").alias("percent_train"))
    right = null_profile(test).select("name", F.col("percent").alias("percent_test"))
    return left.join(right, "name", "left")


def null_count_per_row(df: DataFrame, names: list[str] | None = None, into: str = "n_missing") -> DataFrame:
    flags = [is_missing(df, n).cast("int") for n in (names or df.columns)]
    return df.withColumn(into, reduce(lambda a, b: a + b, flags))


def freq_table(df: DataFrame, name: str) -> DataFrame:
    """Count per value, missing left out."""
    return df.filter(~is_missing(df, name)).groupBy(quoted(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def consistency_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, violations)`` for several rules in one pass."""
    counts = df.agg(*[F.count_if(r).alias(f"__r{i}") for i, r in enumerate(rules.values())])
    entries = [F.struct(F.lit(n).alias("rule"), F.col(f"__r{i}").alias("violations")) for i, n in enumerate(rules)]
    return counts.select(F.inline(F.array(*entries)))


QUARTILES = [0.25, 0.5, 0.75]


def column_summary(df: DataFrame, numeric: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Min, quartiles, mean, max and missing per numeric column.

    One pass gives everything but the quartiles, and the ranges they lie in; a second pass counts only the values in these ranges. ``exact=False``
    leaves the second pass out and takes the quartiles of the sketch.
    """
    numeric = numeric or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    parts = []
    for i, c in enumerate(numeric):
        v = known_value(quoted(c))
        parts += [F.min(v).alias(f"lo{i}"), F.avg(v).alias(f"mean{i}"), F.max(v).alias(f"hi{i}"), F.count_if(is_missing(df, c)).alias(f"na{i}")]
        parts.append(quantile_sketch(v, QUARTILES).alias(f"s{i}") if exact else F.percentile_approx(v, QUARTILES, 100_000).alias(f"q{i}"))
    found = df.agg(*parts).first()
    places = range(len(numeric))
    if exact:
        quartiles = {(r.name, r.probability): r.quantile for r in exact_quantiles(df, numeric, QUARTILES, [found[f"s{i}"] for i in places]).collect()}
        cuts = [[quartiles.get((c, p)) for p in QUARTILES] for c in numeric]
    else:
        cuts = [found[f"q{i}"] or [None] * 3 for i in places]
    rows = [(c, found[f"lo{i}"], *cuts[i][:2], found[f"mean{i}"], cuts[i][2], found[f"hi{i}"], found[f"na{i}"]) for i, c in enumerate(numeric)]
    schema = "name string, min double, q1 double, median double, mean double, q3 double, max double, missing bigint"
    return df.sparkSession.createDataFrame(rows, schema)


def level_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows per level for factor columns, in one pass: ``(name, level, n)``."""
    entries = [F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("level")) for c in names]
    return df.select(F.inline(F.array(*entries))).groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))
