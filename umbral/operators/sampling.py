"""Samples, splits and folds as functions of a key, so any engine picks the same rows.

Nothing here is random at run time: a retried or repeated task selects the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 10_000
HASH_DIGITS = 7
TRIM_ROWS = 100_000
MOST_TRIM_BITS = 20
#: Classes whose limits may travel to the driver.
MOST_CLASSES = 1000


def key_hash(key: str, seed: str | int) -> Column:
    """28-bit number from the md5 of ``seed:key``."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def _below(key: str, seed: str | int, fraction: float) -> Column:
    return key_hash(key, seed) % RESOLUTION < round(fraction * RESOLUTION)


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: str | int) -> DataFrame:
    return df.filter(_below(key, seed, fraction))


def split_validation(df: DataFrame, fraction: float, key: str, seed: str | int) -> tuple[DataFrame, DataFrame]:
    """``(train, validation)``: two filters on one hash, no join."""
    chosen = _below(key, seed, fraction)
    return df.filter(~chosen), df.filter(chosen)


def split_three_way(
    df: DataFrame, validation: float, test: float, key: str, seed: str | int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(train, validation, test)``; ``test`` is a share of what validation leaves."""
    first, second = _below(key, seed, validation), _below(key, f"{seed}/rest", test)
    return df.filter(~first & ~second), df.filter(first), df.filter(~first & second)


def kfold(df: DataFrame, folds: int, key: str, seed: str | int, name: str = "fold") -> DataFrame:
    """Disjoint folds 0..v-1 as a column; its hash is not the one the splits use."""
    return df.withColumn(name, (key_hash(key, f"fold:{seed}") % folds).cast("int"))


def downsample(df: DataFrame, label: str, key: str, seed: str | int, under_ratio: float = 1.5) -> DataFrame:
    """Cut every class to at most ``under_ratio`` × the smallest class, exactly, by key hash.

    A histogram of hash ranges finds the range in which a class's limit falls, and only that range (about
    ``TRIM_ROWS`` rows) is ordered, to find the last row that stays. The result is then a filter on ``df``. ``key`` must
    identify rows. Rows without a label belong to no class and are left out; a limit below one row leaves no row.
    """
    known = df.filter(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    limit = int(under_ratio * min(counts.values(), default=0))
    large = [c for c, n in counts.items() if n > limit]
    if not large or limit < 1:
        return known if not large else known.limit(0)
    bits = min(MOST_TRIM_BITS, (max(counts.values()) // TRIM_ROWS).bit_length())
    width = 16**HASH_DIGITS >> bits
    marked = known.filter(F.col(label).isin(large)).select(
        F.col(label).alias("__label"), F.col(key).alias("__key"), key_hash(key, seed).alias("__hash")
    )
    marked = marked.withColumn("__range", F.floor(F.col("__hash") / width))
    upto = Window.partitionBy("__label").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        marked.groupBy("__label", "__range")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .filter((F.col("upto") >= limit) & (F.col("upto") - F.col("n") < limit))
        .select("__label", "__range", (limit - F.col("upto") + F.col("n")).alias("__room"))
    )
    order = Window.partitionBy("__label").orderBy("__hash", "__key")
    at_edge = marked.join(F.broadcast(edge), ["__label", "__range"]).withColumn("__place", F.row_number().over(order))
    last = at_edge.filter(F.col("__place") == F.col("__room")).select("__label", "__hash", "__key").collect()
    stays = ~F.col(label).isin(large)
    place = F.struct(key_hash(key, seed).alias("h"), F.col(key).alias("k"))
    for c, h, k in last:
        stays = stays | ((F.col(label) == F.lit(c)) & (place <= F.struct(F.lit(h).cast("bigint").alias("h"), F.lit(k).cast(df.schema[key].dataType).alias("k"))))
    return known.filter(stays)
