"""Hand-made rows for the rules on missing values."""

import pytest
from pyspark.sql import functions as F

from umbral.functions import nulls as N
from umbral.functions import recode as R
from umbral.operators import columns as C
from umbral.operators.aggregates import any_flag, mean_where, sum_or_zero
from umbral.operators.joins import left_join_key, left_join_natural
from umbral.operators.profile import null_profile

NAN = float("nan")


def one(df, column):
    return [r[0] for r in df.select(column.alias("x")).collect()]


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([(1, 5.0), (2, 0.0), (9, None), (None, 3.0)], "a int, m double")


def test_condition_that_is_missing_gives_missing(codes):
    assert one(codes, N.r_ifelse(F.col("a") == 9, 2, F.col("a"))) == [1, 2, 2, None]


def test_zero_amount_rule_keeps_missing_amount_missing(codes):
    assert one(codes, R.zero_amount_means_no(F.col("a"), F.col("m"), F.lit(True))) == [1, 2, None, None]
    assert one(codes, R.zero_amount_means_no(F.col("a"), F.col("m"), F.lit(False))) == [1, 2, 9, None]


def test_recode_treats_missing_as_unlisted(codes):
    assert one(codes, R.recode(F.col("a"), {1: 1, 2: 0})) == [1, 0, None, None]
    wide = {k: k * 10 for k in range(40)}
    assert one(codes, R.recode(F.col("a"), wide, default=-1)) == [10, 20, 90, -1]


def test_membership_is_never_missing(codes):
    assert one(codes, ~N.in_set(F.col("a"), [2, 9])) == [True, False, False, True]


def test_yes_no_keeps_missing(codes):
    assert one(codes, R.yes_no(F.col("a"))) == [1, 0, 0, None]


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, x int")
    out = df.groupBy("k").agg(
        sum_or_zero(F.col("x")).alias("s"), any_flag(F.col("x")).alias("f"), mean_where(F.col("x"), F.col("x") > 5).alias("m")
    )
    assert {r.k: (r.s, r.f, r.m) for r in out.collect()} == {"a": (0, 0, None), "b": (2, 1, None)}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (NAN, 2), (None, 3)], "x double, k int")
    assert [r.k for r in N.drop_na(df).collect()] == [1]
    assert sorted(r.x for r in N.replace_na(df, {"x": 7.0}).collect()) == [1.0, 7.0, 7.0]
    profile = {r.name: (r.missing, round(r.percent, 3)) for r in null_profile(df).collect()}
    assert profile == {"x": (2, 66.667), "k": (0, 0.0)}


def test_division_and_log_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 4.0), (NAN, 1.0)], "x double, y double")
    assert one(df, N.safe_divide(F.col("x"), F.col("y")))[:2] == [None, -0.5]
    assert one(df, N.safe_log(F.col("x"))) == [0.0, 0.0, None]


def test_natural_join_matches_missing_with_missing(spark):
    left = spark.createDataFrame([(1, 1, None, "l1"), (1, 2, 1, "l2")], "id int, Orden int, Pet int, l string")
    right = spark.createDataFrame([(1, 1, None, "r1"), (1, 2, None, "r2")], "id int, Orden int, Pet int, r string")
    with pytest.warns(UserWarning):
        out = left_join_natural(left, right)
    assert sorted((r.l, r.r) for r in out.collect()) == [("l1", "r1"), ("l2", None)]


def test_shared_names_get_suffixes(spark):
    left = spark.createDataFrame([(1, "x")], "id int, c string")
    right = spark.createDataFrame([(1, "y")], "id int, c string")
    assert left_join_key(left, right, ["id"]).columns == ["id", "c.x", "c.y"]


def test_strict_and_lenient_selects(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        C.select_all_of(df, ["a", "z"])
    assert C.select_any_of(df, ["a", "z"]).columns == ["a"]
    with pytest.raises(ValueError):
        C.pull_column(df.union(df), "a", at_most=1)


def test_later_expression_sees_earlier(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert C.mutate(df, a=F.col("a") + 1, b=F.col("a") * 10).first().b == 20


def test_listed_missing_stays_missing_in_maps_of_any_size(spark):
    for size in (2, 40):
        table = {1: None, **{k: k * 10 for k in range(2, size)}, size: 5}
        got = spark.createDataFrame([(1,), (size,), (99,), (None,)], "c int").select(R.recode(F.col("c"), table, -1)).collect()
        assert [r[0] for r in got] == [None, 5, -1, -1]


def test_scores_that_are_no_numbers_are_no_calls(spark):
    from umbral.learning import evaluate, tuning
    from umbral.learning.models import CLASSIFICATION

    rows = [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.3), (1, float("nan")), (0, float("nan")), (0, None), (None, 0.8)]
    df = spark.createDataFrame(rows, "y int, s double")
    m = evaluate.class_metrics(df, "y", "s").first()
    assert (m.recall, m.specificity, m.precision, m.auc) == (0.5, 1.0, 1.0, 1.0)
    assert tuple(evaluate.operating_point(df, "y", "s", 0.5).first()) == (0.5, 0.5, 0.0, 1.0)
    found = tuning.measure_scores(df.select(F.col("y").alias("label"), F.col("s").alias("s0")), 1, ["roc_auc", "sens", "precision", "log_loss"], CLASSIFICATION)[0]
    assert found["roc_auc"] == 1.0 and found["sens"] == 0.5 and found["precision"] == 1.0 and 0 < found["log_loss"] < 1


def test_rounding_halfway_values_as_the_checking_engine_does(spark):
    """Shares of 3,600,000 rows have seven digits that end in 5; two ways to round them part there."""
    import duckdb

    from umbral.catalog.registry import r6

    share = "CAST(9 * id AS DOUBLE) / 3600000"
    got = spark.range(1, 400_000, 2).selectExpr("id", f"{share} AS x", f"1 - {share} AS y").select("id", r6("x").alias("x"), r6("y").alias("y"))
    want = duckdb.sql(f"SELECT id, round({share}, 6) AS x, round(1 - {share}, 6) + 0.0 AS y FROM range(1, 400000, 2) t(id)").fetchall()
    assert sorted(map(tuple, got.collect())) == want
