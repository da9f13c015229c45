"""A household with a third of all persons: its rows are split, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from umbral.operators.aggregates import group_sum
from umbral.operators.joins import left_join_key

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def tiny_thresholds(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_household_is_split_in_the_join(spark, tiny_thresholds):
    persons = spark.range(0, 30_000, 1, 16).selectExpr("IF(id % 3 = 0, 7, id % 900) AS id", "id AS Orden", "md5(string(id)) AS text", "1 AS one")
    homes = spark.range(900).selectExpr("id", "id * 2 AS Npersug")
    joined = left_join_key(persons, homes, ["id"])
    rolled = joined.groupBy("id").agg(F.sum("one").alias("n"), F.max("Npersug").alias("size"), F.max("text").alias("t"))
    rows = {r.id: (r.n, r.size) for r in rolled.collect()}
    counts = {r.id: r.n for r in group_sum(persons, "id", {"one": "n"}).collect()}
    assert rows == {k: (n, 2 * k) for k, n in counts.items()}
    assert max(counts.values()) > 10_000
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_a_hot_household_is_dealt_over_tasks(spark):
    """Nine rows of ten in one household, some without a key: same rows as a window, no task with a whole group."""
    from umbral.operators.windows import group_mutate

    persons = spark.range(0, 20_000, 1, 4).selectExpr("IF(id % 10 > 0, 7, IF(id % 20 = 0, NULL, id)) AS id", "id AS x", "id % 3 AS __c")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = group_mutate(persons, "id", {"s": F.sum("x"), "n": F.count(F.lit(1))}, rows_per_salt=500)
        per_task = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        rows = {r.x: (r.id, r.s, r.n) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.columns == ["id", "x", "__c", "s", "n"] and len(rows) == 20_000 and sum(per_task) == 20_000 and max(per_task) < 8000
    for key, group in (7, [x for x in range(20_000) if x % 10]), (None, range(0, 20_000, 20)), (10, [10]):
        want = (key, sum(group), len(group))
        assert all(rows[x] == want for x in group)
