"""Group-wide values, distinct roll-ups, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.operators.columns import quoted

ROWS_PER_SALT = 100_000
LARGEST_CODE = 62


def group_mutate(df: DataFrame, key: str, aggregates: dict[str, Column], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Copy group aggregates to every member; a missing key is a group of its own.

    A window would sort a whole group in one task. The aggregates are computed with map-side combine and joined back: a group gets one salt
    for every ``rows_per_salt`` of its measured rows, its aggregates are copied once per salt, and its rows are dealt over the salts, so no task gets more than about
    that many rows of one group. Only the groups with several salts are broadcast, as key and number of salts; there are at most rows ÷ ``rows_per_salt`` of them.
    """
    stats = df.groupBy(quoted(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"), *[a.alias(n) for n, a in aggregates.items()])
    salts = F.ceil(F.col("__rows") / rows_per_salt).cast("bigint")
    several = stats.filter(F.col("__rows") > rows_per_salt).select(F.col("__key").alias("__hot"), salts.alias("__salts"))
    copies = stats.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("__rows")
    dealt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__salts")), F.lit(0).cast("bigint"))
    rows = df.join(F.broadcast(several), quoted(key).eqNullSafe(F.col("__hot")), "left").withColumn("__salt", dealt)
    out = rows.join(copies, quoted(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy")))
    return out.drop("__key", "__copy", "__hot", "__salts", "__salt")


def code_set(column: Column, where: Column | None = None) -> Column:
    """Aggregate: the distinct codes 0..62 of a group, and missing, as bits of one number.

    Unlike ``collect_set`` it has a fixed size and combines map-side in generated code.
    Rows outside ``where`` do not count; with none left the result is missing.
    """
    place = F.when(column.isNull(), LARGEST_CODE + 1).when(column.between(0, LARGEST_CODE), column.cast("int"))
    checked = F.coalesce(place, F.raise_error(F.lit(f"code outside 0..{LARGEST_CODE}")).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), checked)
    return F.bit_or(bit if where is None else F.when(where, bit))


def explode_codes(df: DataFrame, bits: str, name: str) -> DataFrame:
    """One row per code held in a ``code_set`` column; the bit column is replaced by the code."""
    codes = F.filter(
        F.sequence(F.lit(0), F.lit(LARGEST_CODE + 1)),
        lambda c: F.call_function("shiftright", F.col(bits), c).bitwiseAND(F.lit(1).cast("bigint")) == 1,
    )
    return df.withColumn(name, F.explode(codes)).withColumn(name, F.nullif(quoted(name), F.lit(LARGEST_CODE + 1))).drop(bits)


def rollup_distinct(df: DataFrame, key: str, aggregates: dict[str, Column], codes: list[str] = ()) -> DataFrame:
    """Group aggregates, projected with the ``codes`` columns and made unique, in one shuffle.

    Equal to ``group_mutate`` + select + distinct: a group gives one row per combination of codes its rows hold, missing
    ones included. A group's set is bounded by the number of combinations, so codes must be few.
    """
    if not codes:
        return df.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])
    names = [f"c{i}" for i in range(len(codes))]
    held = F.collect_set(F.struct(*[quoted(c).alias(n) for c, n in zip(codes, names)])).alias("__held")
    out = df.groupBy(key).agg(held, *[a.alias(n) for n, a in aggregates.items()]).withColumn("__codes", F.explode("__held"))
    return out.select(key, *[F.col("__codes")[n].alias(c) for c, n in zip(codes, names)], *aggregates)


def top_k(df: DataFrame, column: str, k: int, ties: list[str] = ()) -> DataFrame:
    """Largest ``k`` rows; each task keeps only its own best ``k``."""
    return df.orderBy(F.col(column).desc_nulls_last(), *[F.col(t) for t in ties]).limit(k)


def union_by_name(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Stack rows by column name; absent columns become missing."""
    return top.unionByName(bottom, allowMissingColumns=True)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def bind_stats(left: DataFrame, right: DataFrame, on: str = "name") -> DataFrame:
    """Two per-column statistics side by side."""
    return left.join(right, on, "full")
