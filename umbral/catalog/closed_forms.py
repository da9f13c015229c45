"""Small settings of the learned models for which SQL has the exact answer: one or two 0/1 predictors, one split, two columns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.catalog.learning import homes
from umbral.catalog.registry import query, r6, rounded
from umbral.learning import evaluate, models, prep
from umbral.session import scratch_path
from umbral.sources import tables as S
from umbral.sources.views import view_sql

_ROWS = view_sql("hogares") + (
    ", t AS (SELECT id, Pobre, CASE WHEN Ingpcug > 0 THEN ln(Ingpcug) ELSE 0 END AS y, CASE WHEN Npersug <= 2 THEN 1.0e0 ELSE 0.0e0 END AS x, "
    "CASE WHEN P5000 <= 3 THEN 1.0e0 ELSE 0.0e0 END AS w, P5130 AS a, Npersug::DOUBLE AS b, CASE WHEN Npersug <= 2 THEN 1 - Pobre ELSE Pobre END AS mixed FROM hogares), "
    "g AS (SELECT x, COUNT(*)::DOUBLE AS n, AVG(y) AS m, AVG(Pobre) AS s, AVG(mixed) AS share FROM t GROUP BY x)"
)


def _table(spark: SparkSession, sf: str) -> DataFrame:
    small, few = (F.col("Npersug") <= 2).cast("double"), (F.col("P5000") <= 3).cast("double")
    mixed = F.when(F.col("Npersug") <= 2, 1 - F.col("Pobre")).otherwise(F.col("Pobre"))
    df = homes(spark, sf).withColumns({"x": small, "mixed": mixed, "w": few, "b": F.col("Npersug").cast("double")})
    return df.select("id", "Pobre", "mixed", F.col("lIngpcug").alias("y"), "x", "w", F.col("P5130").alias("a"), "b")


def _scores(spark: SparkSession, sf: str, model, kind: str, places: int = 6) -> DataFrame:
    df = prep.design_matrix(_table(spark, sf), ["x"])
    return rounded(models.predict(model.fit(df), df, kind).select("id", "score"), "score", places=places)


@query(_ROWS + "SELECT id, round(m, 6) AS score FROM t JOIN g USING (x)")
def forest_reg_stump(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of one split on all rows: the two means."""
    build = models.rand_forest(models.REGRESSION, "y", mtry="all", min_n=1, trees=3, tree_depth=1, bootstrap=False)
    return _scores(spark, sf, build, "numeric")


@query(_ROWS + "SELECT id, round(share, 6) AS score FROM t JOIN g USING (x)")
def forest_class_stump(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of one split, for a label that is mostly 1 on one side only: a split whose sides agree is merged again."""
    build = models.rand_forest(models.CLASSIFICATION, "mixed", mtry="all", min_n=1, trees=3, tree_depth=1, bootstrap=False)
    return _scores(spark, sf, build, "prob")


@query(_ROWS + "SELECT id, round(m, 6) AS score FROM t JOIN g USING (x)")
def boost_reg_stump(spark: SparkSession, sf: str) -> DataFrame:
    """After the first split the residuals of either side sum to zero, so the second round changes nothing."""
    return _scores(spark, sf, models.boost_tree(models.REGRESSION, "y", tree_depth=1, trees=2, learn_rate=0.3), "numeric")


@query(
    _ROWS + ", f AS (SELECT x, 2 * s - 1 + 0.3 * (4 * s / (1 + exp(2 * (2 * s - 1))) - 4 * (1 - s) / (1 + exp(-2 * (2 * s - 1)))) AS f FROM g) "
    "SELECT id, round(1 / (1 + exp(-2 * f)), 6) AS score FROM t JOIN f USING (x)"
)
def boost_class_stump(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds: the mean of labels -1 and 1, then a step along the mean gradient of the logistic loss."""
    return _scores(spark, sf, models.boost_tree(models.CLASSIFICATION, "Pobre", tree_depth=1, trees=2, learn_rate=0.3), "prob")


@query(
    _ROWS + ", k AS (SELECT (SELECT SUM(n) FROM g) * 0.01 * (SELECT stddev_samp(x) FROM t) * "
    "sign((SELECT s FROM g WHERE x = 1) - (SELECT s FROM g WHERE x = 0)) AS pull) "
    "SELECT id, round(CASE WHEN x = 1 THEN (n * s - pull) / n ELSE (n * s + pull) / n END, 4) AS score FROM t JOIN g USING (x), k"
)
def logit_l1_stump(spark: SparkSession, sf: str) -> DataFrame:
    """The penalty pulls the shares of the two groups towards each other by the same number of rows."""
    return _scores(spark, sf, models.logit_l1("Pobre", 0.01, tol=1e-12, maxIter=500), "prob", places=4)


@query(
    _ROWS + ", c AS (SELECT AVG(a) AS ma, AVG(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, sign(corr(a, b)) AS r FROM t), "
    "z AS (SELECT id, (a - ma) / sa AS u, (b - mb) / sb AS v, r FROM t, c) "
    "SELECT id, round(pow(u + r * v, 2) / 2, 6) + 0.0 AS first, round(pow(u - r * v, 2) / 2, 6) + 0.0 AS second FROM z"
)
def pca_two(spark: SparkSession, sf: str) -> DataFrame:
    """Two standardised columns turn by 45 degrees; squares do not depend on the signs of the axes."""
    df = _table(spark, sf).select("id", "a", "b")
    prepared = prep.prep(prep.Recipe(not_predictors=("id",), numeric=["a", "b"], factors=[], pca_threshold=1.0), df)
    parts = prep.bake(prepared, df, ["id"]).withColumn("p", vector_to_array("features"))
    return parts.select("id", r6(F.pow(F.col("p")[0], 2)).alias("first"), r6(F.pow(F.col("p")[1], 2)).alias("second"))


_GAINS = (

    _ROWS + ", gains AS (SELECT 'x' AS name, SUM(n * m * m) AS gain FROM (SELECT COUNT(*) AS n, AVG(y) AS m FROM t GROUP BY x) AS i UNION ALL "
    "SELECT 'w', SUM(n * m * m) FROM (SELECT COUNT(*) AS n, AVG(y) AS m FROM t GROUP BY w) AS j) "
    "SELECT name AS \"Variable\", CASE WHEN gain = (SELECT MAX(gain) FROM gains) THEN 1.0e0 ELSE 0.0e0 END AS \"Importance\" FROM gains"
)


@query(_GAINS)
def importance_stump(spark: SparkSession, sf: str) -> DataFrame:
    """One split: all importance is on the column it uses."""
    df = prep.design_matrix(_table(spark, sf), ["x", "w"])
    model = models.decision_tree("y", tree_depth=1, min_n=1).fit(df)
    return evaluate.importance(spark, ["x", "w"], model)


@query(_GAINS)
def importance_file_stump(spark: SparkSession, sf: str) -> DataFrame:
    """The same table written as a file and read back."""
    path = scratch_path(spark, "importance")
    S.write_importance(importance_stump(spark, sf), path)
    return spark.read.schema("Variable string, Importance double").option("header", True).csv(path)
