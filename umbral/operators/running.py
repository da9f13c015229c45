"""Running totals over an order that no single task has to hold.

A window without ``partitionBy`` sorts everything in one task. Here the ordered
rows are cut into ranges of similar size, each range is summed on its own, and
the totals of the ranges before it are added from a table with one row per range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RANGES = 20_000
RANGE = "__range"


def place(df: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``__range_<column>``: the number of the value's range, for double columns.

    The cut points come from one pass with fixed-size sketches and only balance the
    work. They stand in the plan as plain numbers, so a retried task sees the same ranges.
    """
    ranges = ranges or min(MOST_RANGES, max(2, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    steps = [i / ranges for i in range(1, ranges)]
    found = df.agg(*[F.percentile_approx(F.col(c), steps, 5 * ranges).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    ends = float("-inf"), float("inf")
    splits = [sorted({ends[0], *(x for x in (found[i] or [0.0]) if x == x), ends[1]}) for i in range(len(columns))]
    splits = [s if len(s) > 2 else [ends[0], 0.0, ends[1]] for s in splits]
    names = [f"{RANGE}_{c}" for c in columns]
    return Bucketizer(inputCols=columns, outputCols=names, splitsArray=splits, handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    by: str | None = None,
    descending: bool = False,
    neighbour: str | None = None,
    at: str | None = None,
) -> DataFrame:
    """Inclusive running sum of each column of ``sums`` along ``order``, as ``cum_<column>``,
    and its grand total as ``all_<column>``.

    ``order`` must be unique within ``by``: aggregate per value first. ``at`` names the
    range column of ``place``. ``neighbour`` receives the order value of the next row.
    """
    if at is None:
        if by:
            raise ValueError("place the values before grouping them by another column")
        df, at = place(df, [order]), f"{RANGE}_{order}"
    keys = [by] if by else []
    direction = F.col(order).desc() if descending else F.col(order).asc()
    first_value = F.max(order) if descending else F.min(order)
    group = F.col(by) if by else F.lit(0)
    totals = df.groupBy(group.alias("__by"), F.col(at).alias("__at")).agg(
        *[F.sum(s).alias(f"__total_{s}") for s in sums], first_value.alias("__first")
    )
    # One row per range and ``by`` value: a bounded table, whatever the size of the data.
    across = Window.partitionBy("__by").orderBy(F.col("__at").desc() if descending else F.col("__at").asc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__by",
        "__at",
        *[F.coalesce(F.sum(f"__total_{s}").over(before), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__total_{s}").over(Window.partitionBy("__by")).alias(f"all_{s}") for s in sums],
        F.lead("__first").over(across).alias("__next_first"),
    )
    match = F.col(at) == F.col("__at")
    if by:
        match &= F.col(by).eqNullSafe(F.col("__by"))
    joined = df.join(F.broadcast(offsets), match).drop("__at", "__by")

    inside = Window.partitionBy(*keys, at).orderBy(direction)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({f"cum_{s}": F.col(f"__before_{s}") + F.sum(s).over(upto) for s in sums})
    if neighbour:
        out = out.withColumn(neighbour, F.coalesce(F.lead(order).over(inside), F.col("__next_first")))
    return out.drop(at, "__next_first", *[f"__before_{s}" for s in sums])


#: Entries of a sketch, and values near a wanted rank that are counted one by one.
ACCURACY = 10_000
MOST_NEAR = 1_000_000


def known_value(column: Column) -> Column:
    """The number, missing where it is not one."""
    number = column.cast("double")
    return F.when(~F.isnan(number), number)


def quantile_sketch(value: Column, probabilities: list[float]) -> Column:
    """How many values there are, and a value safely below and above each wanted quantile: part of any aggregate."""
    slack = 2 / ACCURACY
    at = [min(1.0, max(0.0, p + s)) for p in probabilities for s in (-slack, slack)]
    return F.struct(F.count(value).alias("n"), F.percentile_approx(value, at, ACCURACY).alias("near"))


def _bounds(near: list[float] | None, k: int, low: float, high: float, at: float, slack: float) -> tuple[float, float]:
    """The range of one quantile within ``low..high``; beyond either end of the values it stays open."""
    if near is None:
        return low, high
    return (near[2 * k] if at - slack > 0 else low), (near[2 * k + 1] if at + slack < 1 else high)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], sketches: list | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics, for all columns at once: ``(name, probability, quantile)``.

    A sketch (``quantile_sketch``; given, or from one pass) names a narrow range around each quantile. A second pass counts what lies below it and the distinct
    values inside it: only those are shuffled, a few thousandths of the table. Ranges that would still hold more than ``MOST_NEAR`` values are sketched again first. The sketch
    only saves work: a range that misses its rank is noticed, and its column is counted as a whole.
    """
    values = [known_value(F.col(f"`{c}`")) for c in columns]
    if sketches is None:
        found = df.agg(*[quantile_sketch(v, probabilities).alias(f"s{i}") for i, v in enumerate(values)]).first()
        sketches = list(found)
    slack, ends = 2 / ACCURACY, (float("-inf"), float("inf"))
    wanted, ranges = {}, {}
    for i, s in enumerate(sketches):
        for k, p in enumerate(probabilities):
            if s["n"]:
                wanted[i, k] = (s["n"] - 1) * float(p)
                ranges[i, k] = _bounds(s["near"], k, *ends, p, slack)
    near = {key: 2 * slack * sketches[key[0]]["n"] for key in ranges}
    while any(n > MOST_NEAR for n in near.values()):
        keys = [key for key, n in near.items() if n > MOST_NEAR]
        parts = []
        for j, (i, k) in enumerate(keys):
            low, high = ranges[i, k]
            inside = values[i].between(low, high)
            parts += [F.count_if(values[i] < low).alias(f"b{j}"), F.count_if(inside).alias(f"n{j}")]
            parts.append(F.percentile_approx(F.when(inside, values[i]), [x / 1000 for x in range(1001)], ACCURACY).alias(f"q{j}"))
        found = df.agg(*parts).first()
        for j, key in enumerate(keys):
            n, q = found[f"n{j}"], found[f"q{j}"]
            at = (wanted[key] - found[f"b{j}"]) / max(1, n) * 1000
            low, high = max(0, int(at) - 1), min(1000, int(at) + 2)
            narrower = (q[low] if low > 0 else ranges[key][0], q[high] if high < 1000 else ranges[key][1]) if q else ranges[key]
            settled = not 0 <= at <= 1000 or narrower == ranges[key] or n <= MOST_NEAR
            ranges[key], near[key] = narrower if 0 <= at <= 1000 else ends, 0 if settled else 3 * n / 1000
    rows = _ranked(df, values, wanted, ranges)
    missed = [key for key in wanted if key not in rows]
    if missed:
        rows |= _ranked(df, values, {key: wanted[key] for key in missed}, dict.fromkeys(missed, ends))
    table = [(columns[i], float(probabilities[k]), rows[i, k]) for i, k in wanted]
    return df.sparkSession.createDataFrame(table, "name string, probability double, quantile double")


def _ranked(df: DataFrame, values: list[Column], wanted: dict, ranges: dict) -> dict:
    """The interpolated value at each wanted position, for the keys whose range holds it."""
    if not wanted:
        return {}
    entries = []
    for (i, k), (low, high) in ranges.items():
        inside = F.when(values[i] >= low, values[i])
        entry = F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(wanted[i, k]).alias("position"), inside.alias("value"))
        entries.append(F.when(values[i] <= high, entry))
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    counts = df.select(F.inline(kept)).groupBy("i", "k", "position", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("i", "k").orderBy(F.asc_nulls_first("value"))
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"upto": upto, "following": F.lead("value").over(order)})
    rank = F.floor("position").cast("bigint")
    hit = placed.filter(F.col("value").isNotNull() & (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")))
    share = F.col("position") - rank
    above = F.when((share == 0) | (rank + 1 < F.col("upto")), F.col("value")).otherwise(F.col("following"))
    found = hit.select("i", "k", (F.col("value") + share * (above - F.col("value"))).alias("quantile")).collect()
    return {(r["i"], r["k"]): r["quantile"] for r in found if r["quantile"] is not None}
