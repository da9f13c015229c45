"""Whole runs whose every step SQL can state: tuned, refitted, cut off and scored on one or two simple predictors; and full-size runs of the other models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.catalog.closed_forms import _table
from umbral.catalog.households import hash_sql
from umbral.catalog.learning import bases, homes
from umbral.catalog.registry import query, rounded
from umbral.learning import discriminant, models, tuning
from umbral.learning.prep import Recipe, design_matrix
from umbral.learning.pruning import tune_pruned_tree
from umbral.operators.sampling import kfold
from umbral.plans.learners import Fixed, PrunedTrees, Tuned, lasso_path
from umbral.plans.workflow import Run, RunConfig, end_to_end, end_to_end_income
from umbral.sources.views import view_sql

_FOLDS = 3
_ROWS = view_sql("hogares") + (
    f", t AS (SELECT id, train, Pobre, Lp, CASE WHEN Ingpcug > 0 THEN ln(Ingpcug) ELSE 0 END AS y, CASE WHEN Npersug <= 2 THEN 1.0e0 ELSE 0.0e0 END AS x, "
    f"CASE WHEN P5000 <= 3 THEN 1.0e0 ELSE 0.0e0 END AS w, P5130 AS a, Npersug::DOUBLE AS b, CAST({hash_sql('fold:123')} % {_FOLDS} AS INT) AS fold, "
    f"CASE WHEN train = 0 THEN 'test' WHEN {hash_sql('123')} % 10000 < 1500 THEN 'held' ELSE 'fit' END AS part FROM hogares)"
)

#: From ``scored`` (id, part, Pobre, p): the cut-off nearest to the corner among held-out rows, and the test rows it calls poor.
_SUBMIT = (
    ", d AS (SELECT p, COUNT(*) FILTER (WHERE Pobre = 1) AS pos, COUNT(*) FILTER (WHERE Pobre = 0) AS neg FROM scored WHERE part = 'held' GROUP BY p), "
    "c AS (SELECT p, SUM(pos) OVER o AS tp, SUM(neg) OVER o AS fp, SUM(pos) OVER () AS ap, SUM(neg) OVER () AS an, lead(p) OVER o AS below FROM d WINDOW o AS (ORDER BY p DESC)), "
    "cut AS (SELECT COALESCE((p + below) / 2, '-Infinity'::DOUBLE) AS threshold FROM c ORDER BY pow(1 - tp::DOUBLE / ap, 2) + pow(fp::DOUBLE / an, 2), threshold LIMIT 1) "
    "SELECT id, round(p, {places}) AS score, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS pobre FROM scored, cut WHERE part = 'test'"
)


def _config(**more) -> RunConfig:
    return RunConfig(**({"interact_numeric": (), "interact_factor": None, "folds": _FOLDS, "factors": ()} | more))


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = _table(spark, sf).join(homes(spark, sf).select("id", "train", "Lp"), "id")
    return df.filter("train = 1"), df.filter("train = 0")


def _submitted(run: Run, test: DataFrame, kind: str, places: int) -> DataFrame:
    """The submission next to the scores behind it."""
    scores = models.predict(run.model, test, kind).select("id", "score")
    return rounded(scores.join(run.submission, "id"), "score", places=places)


@query(
    f"{_ROWS}, k AS (SELECT Pobre, COUNT(*)::DOUBLE AS n, AVG(a) AS ma, AVG(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb FROM t WHERE part = 'fit' GROUP BY Pobre), "
    "s AS (SELECT SUM(n * va) / SUM(n) AS va, SUM(n * vb) / SUM(n) AS vb FROM k), "
    "v AS (SELECT t.id, part, t.Pobre, k.Pobre AS class, ln(n) - 0.5 * ((a - ma) * (a - ma) / s.va + (b - mb) * (b - mb) / s.vb) AS v FROM t, k, s), "
    "scored AS (SELECT i.id, i.part, i.Pobre, 1 / (1 + exp(j.v - i.v)) AS p FROM v i JOIN v j ON i.id = j.id AND i.class = 1 AND j.class = 0)"
    + _SUBMIT.format(places=6)
)
def end_to_end_lda(spark: SparkSession, sf: str) -> DataFrame:
    """Linear discriminant behind the preparation, cut off on held-out rows."""
    train, test = _parts(spark, sf)
    run = end_to_end(train, test, _config(numeric=("a", "b")), Fixed(discriminant.lda_diag))
    return _submitted(run, test, "prob", 6)


_SHARES = "AVG(Pobre) FILTER (WHERE x = 1) AS s1, AVG(Pobre) FILTER (WHERE x = 0) AS s0, COUNT(*) FILTER (WHERE x = 1)::DOUBLE AS n1, COUNT(*) FILTER (WHERE x = 0)::DOUBLE AS n0, stddev_samp(x) AS sd"
_PULLED = "s1 - (n1 + n0) * penalty * sd * sign(s1 - s0) / n1 AS p1, s0 + (n1 + n0) * penalty * sd * sign(s1 - s0) / n0 AS p0"


@query(
    f"{_ROWS}, cand(candidate, penalty) AS (VALUES (0, 0.001::DOUBLE), (1, 0.02::DOUBLE)), "
    f"g AS (SELECT f.fold AS held, {_SHARES} FROM t JOIN (SELECT DISTINCT fold FROM t) f ON t.fold <> f.fold WHERE part = 'fit' GROUP BY f.fold), "
    f"e AS (SELECT candidate, held, {_PULLED} FROM g, cand), "
    "m AS (SELECT candidate, held, 2 * COUNT(*) FILTER (WHERE Pobre = 1 AND called)::DOUBLE / (COUNT(*) FILTER (WHERE Pobre = 1) + COUNT(*) FILTER (WHERE called)) AS f FROM ("
    "SELECT candidate, held, Pobre, CASE WHEN x = 1 THEN p1 ELSE p0 END >= 0.5 AS called FROM e JOIN t ON t.fold = e.held WHERE part = 'fit') q GROUP BY candidate, held), "
    "best AS (SELECT penalty FROM (SELECT candidate, AVG(f) AS f FROM m GROUP BY candidate) JOIN cand USING (candidate) ORDER BY round(f, 12) DESC, candidate LIMIT 1), "
    f"whole AS (SELECT {_SHARES} FROM t WHERE part = 'fit'), last AS (SELECT {_PULLED} FROM whole, best), "
    "scored AS (SELECT id, part, Pobre, CASE WHEN x = 1 THEN p1 ELSE p0 END AS p FROM t, last)" + _SUBMIT.format(places=4)
)
def end_to_end_logit_l1(spark: SparkSession, sf: str) -> DataFrame:
    """L1 logistic regression tuned on F1 over three folds."""
    train, test = _parts(spark, sf)
    build = lambda label, **more: models.logit_l1(label, tol=1e-12, maxIter=500, **more)
    run = end_to_end(train, test, _config(numeric=("x",)), Tuned(build, tuning.grid_expand(penalty=[0.001, 0.02]), "f_meas"))
    return _submitted(run, test, "prob", 4)


@query(
    f"{_ROWS}, g AS (SELECT x, AVG(Pobre) AS s FROM t WHERE part = 'fit' GROUP BY x), "
    "f AS (SELECT x, 2 * s - 1 + 0.3 * (4 * s / (1 + exp(2 * (2 * s - 1))) - 4 * (1 - s) / (1 + exp(-2 * (2 * s - 1)))) AS f FROM g), "
    "scored AS (SELECT id, part, Pobre, 1 / (1 + exp(-2 * f)) AS p FROM t JOIN f USING (x))" + _SUBMIT.format(places=6)
)
def end_to_end_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Two boosting rounds of one split."""
    train, test = _parts(spark, sf)
    build = lambda label, **more: models.boost_tree(models.CLASSIFICATION, label, tree_depth=1, trees=2, **more)
    run = end_to_end(train, test, _config(numeric=("x",)), Tuned(build, [{"learn_rate": 0.3}], "f_meas"))
    return _submitted(run, test, "prob", 6)


# Every subtree of a tree of two splits, for every fold (-1: no row is held out): leaves, squared error of its own rows and of the held-out ones.
_TREES = (
    f"{_ROWS}, cell AS (SELECT f, x, w, COUNT(*) FILTER (WHERE fold <> f)::DOUBLE AS n, SUM(y) FILTER (WHERE fold <> f) AS s, SUM(y * y) FILTER (WHERE fold <> f) AS q, "
    "COUNT(*) FILTER (WHERE fold = f)::DOUBLE AS hn, COALESCE(SUM(y) FILTER (WHERE fold = f), 0) AS hs, COALESCE(SUM(y * y) FILTER (WHERE fold = f), 0) AS hq "
    f"FROM t, (SELECT unnest(range(-1, {_FOLDS})) AS f) WHERE train = 1 GROUP BY f, x, w), "
    "by_x AS (SELECT f, SUM(e) AS e FROM (SELECT f, SUM(q) - SUM(s) * SUM(s) / SUM(n) AS e FROM cell GROUP BY f, x) GROUP BY f), "
    "by_w AS (SELECT f, SUM(e) AS e FROM (SELECT f, SUM(q) - SUM(s) * SUM(s) / SUM(n) AS e FROM cell GROUP BY f, w) GROUP BY f), "
    "named AS (SELECT f, by_x.e <= by_w.e AS x_first, CASE WHEN by_x.e <= by_w.e THEN x ELSE w END AS u, n, s, q, hn, hs, hq FROM cell JOIN by_x USING (f) JOIN by_w USING (f)), "
    "sides AS (SELECT f, u, TRUE AS whole, 1 AS leaves, SUM(q) - SUM(s) * SUM(s) / SUM(n) AS e, SUM(hq) - 2 * SUM(s) / SUM(n) * SUM(hs) + SUM(hn) * pow(SUM(s) / SUM(n), 2) AS h FROM named GROUP BY f, u "
    "UNION ALL SELECT f, u, FALSE, COUNT(*), SUM(q - s * s / n), SUM(hq - 2 * s / n * hs + hn * pow(s / n, 2)) FROM named GROUP BY f, u), "
    "root AS (SELECT f, x_first, SUM(q) - SUM(s) * SUM(s) / SUM(n) AS e, SUM(hq) - 2 * SUM(s) / SUM(n) * SUM(hs) + SUM(hn) * pow(SUM(s) / SUM(n), 2) AS h, SUM(hn) AS hn FROM named GROUP BY f, x_first), "
    "subtrees AS (SELECT f, TRUE AS whole0, TRUE AS whole1, TRUE AS one, 1 AS leaves, e, h FROM root UNION ALL "
    "SELECT a.f, a.whole, b.whole, FALSE, a.leaves + b.leaves, a.e + b.e, a.h + b.h FROM sides a JOIN sides b ON a.f = b.f AND a.u = 0 AND b.u = 1), "
    "best AS (SELECT candidate, cost, f, x_first, whole0, whole1, one, leaves, sqrt(greatest(s.h, 0) / r.hn) AS rmse FROM subtrees s JOIN root r USING (f), cand "
    "QUALIFY row_number() OVER (PARTITION BY candidate, f ORDER BY s.e + cost * r.e * leaves, leaves) = 1)"
)
_COSTS = [10 ** (-10 + 9 * k / 24) for k in range(25)]


def _cost_sql(costs: list[float]) -> str:
    return ", cand(candidate, cost) AS (VALUES " + ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(costs)) + ")"


def _trees_sql(costs: list[float]) -> str:
    return _TREES.replace(", best AS", _cost_sql(costs) + ", best AS")


@query(
    _trees_sql(_COSTS) + " SELECT candidate, round(cost, 12) AS cost, f::INT AS fold, 'rmse' AS metric, round(rmse, 6) AS value FROM best WHERE f >= 0 "
    "UNION ALL SELECT candidate, round(cost, 12), f::INT, 'leaves', leaves::DOUBLE FROM best WHERE f >= 0"
)
def tune_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """25 complexities on three folds from three grown trees."""
    df = kfold(_parts(spark, sf)[0], _FOLDS, "id", 123)
    out = tune_pruned_tree(df, Recipe(label="y", numeric=["x", "w"], factors=[]), "y", tuning.COST_COMPLEXITY.levels(25), tree_depth=2, min_n=1)
    return rounded(rounded(out, "value"), "cost", places=12)


_THREE = [0.0, 0.01, 0.5]


@query(
    _trees_sql(_THREE)
    + ", won AS (SELECT candidate FROM best WHERE f >= 0 GROUP BY candidate ORDER BY round(AVG(rmse), 12), candidate LIMIT 1), "
    "tree AS (SELECT * FROM best JOIN won USING (candidate) WHERE f = -1), "
    "placed AS (SELECT id, train, Lp, y, CASE WHEN one THEN 'all' ELSE CASE WHEN x_first THEN x ELSE w END || CASE WHEN (CASE WHEN x_first THEN x ELSE w END) = 0 AND whole0 "
    "OR (CASE WHEN x_first THEN x ELSE w END) = 1 AND whole1 THEN '' ELSE '/' || CASE WHEN x_first THEN w ELSE x END END END AS leaf FROM t, tree), "
    "means AS (SELECT leaf, AVG(y) AS m FROM placed WHERE train = 1 GROUP BY leaf) "
    "SELECT id, round(m, 6) AS score, CASE WHEN exp(m) <= Lp THEN 1 ELSE 0 END AS pobre FROM placed JOIN means USING (leaf) WHERE train = 0"
)
def end_to_end_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Income run of a pruned tree: complexity by cross-validation, the pruned tree of all rows, income against the line."""
    train, test = _parts(spark, sf)
    config = _config(label="y", numeric=("x", "w"))
    run = end_to_end_income(train, test, config, PrunedTrees(_THREE, {"tree_depth": 2, "min_n": 1}))
    return _submitted(run, test, "numeric", 6)


_FLAT = (
    view_sql("hogares") + ", t AS (SELECT id, Pobre, P5130 AS a, CASE WHEN Pobre = 1 AND Npersug <= 2 THEN 1.0e0 ELSE 0.0e0 END AS x FROM hogares), "
    "k AS (SELECT Pobre, COUNT(*)::DOUBLE AS n, AVG(a) AS ma, AVG(x) AS mx, var_pop(a) AS va, var_pop(x) AS vx FROM t GROUP BY Pobre), "
    "s AS (SELECT SUM(n * vx) / SUM(n) AS vx FROM k), "
    "v AS (SELECT t.id, k.Pobre AS class, ln(n) - 0.5 * (ln(k.va) + ln(CASE WHEN k.vx > 0 THEN k.vx ELSE s.vx END) + (a - ma) * (a - ma) / k.va + (x - mx) * (x - mx) / CASE WHEN k.vx > 0 THEN k.vx ELSE s.vx END) AS v FROM t, k, s) "
    "SELECT i.id, round(1 / (1 + exp(j.v - i.v)), 6) AS probability FROM v i JOIN v j ON i.id = j.id AND i.class = 1 AND j.class = 0"
)


@query(_FLAT)
def qda_flat_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """An indicator that is flat inside one class takes the variance all classes share there."""
    df = homes(spark, sf).withColumn("x", ((F.col("Pobre") == 1) & (F.col("Npersug") <= 2)).cast("double")).withColumn("a", F.col("P5130"))
    df = design_matrix(df.select("id", "Pobre", "a", "x"), ["a", "x"])
    return rounded(models.predict(discriminant.qda_diag("Pobre").fit(df), df, "prob", "probability").select("id", "probability"), "probability")


@query()
def end_to_end_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Boosting on the components of the terms a lasso keeps, from a balanced table."""
    train, test = bases(spark, sf)
    build = lambda label, **more: models.boost_tree(models.CLASSIFICATION, label, **more)
    grid = tuning.grid_expand(tree_depth=[3], trees=[5], learn_rate=[0.1, 0.3])
    config = RunConfig(chosen_by=lasso_path(), under_ratio=1.5, pca_threshold=0.8, folds=2)
    return end_to_end(train, test, config, Tuned(build, grid, "f_meas")).submission


@query()
def end_to_end_qda(spark: SparkSession, sf: str) -> DataFrame:
    """Quadratic discriminant behind the whole preparation with its indicators and interactions."""
    train, test = bases(spark, sf)
    return end_to_end(train, test, RunConfig(), Fixed(discriminant.qda_diag)).submission
