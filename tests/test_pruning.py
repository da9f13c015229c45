"""Cost-complexity pruning against all prunings of small trees; discriminants as saved stages; runs of any learner."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from umbral.learning import discriminant, models, prep, tuning
from umbral.learning.pruning import TreeNodes, judge_subtrees, prune, pruned_tree, saved_nodes, tune_pruned_tree
from umbral.operators.sampling import kfold
from umbral.plans.learners import Fixed, PrunedTrees, Tuned, lasso_path
from umbral.plans.workflow import RunConfig, end_to_end, end_to_end_income, learn
from umbral.sources import tables as S

COSTS = [0.0, 1e-4, 1e-3, 0.01, 0.05, 0.2, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = 3 * (x[:, 0] > 0) + (x[:, 1] > 0.5) * (x[:, 0] > 0) + 0.3 * x[:, 2] + rng.normal(size=500)
    data = [(i, *map(float, r), float(v), int(v > 2)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return kfold(spark.createDataFrame(data, "id long, x0 double, x1 double, x2 double, y double, c int"), 3, "id", 1).cache()


@pytest.fixture(scope="module")
def prepared(rows):
    return prep.design_matrix(rows, ["x0", "x1", "x2"]).cache()


def prunings(nodes, t=0):
    """Every set of leaves a pruned tree can have."""
    yield [t]
    if nodes.left[t] >= 0:
        for a in prunings(nodes, nodes.left[t]):
            for b in prunings(nodes, nodes.right[t]):
                yield a + b


def test_the_best_subtree_of_every_cost_is_that_of_all_prunings(prepared):
    nodes, _ = saved_nodes(models.decision_tree("y", tree_depth=3, min_n=5).fit(prepared))
    every = [sorted(p) for p in prunings(nodes)]
    assert len(every) > 20
    at = nodes.collapse_at()
    costs = sorted({*COSTS, *at.tolist(), *(0.999 * at).tolist()})
    for cost, ends in zip(costs, nodes.ends(costs), strict=True):
        value = lambda leaves: nodes.error[leaves].sum() + cost * nodes.error[0] * len(leaves)
        found = sorted(set(ends.tolist()))
        best = min(value(p) for p in every)
        assert value(found) == pytest.approx(best, rel=1e-9)
        assert len(found) == min(len(p) for p in every if value(p) <= best * (1 + 1e-12))


def test_a_chain_and_a_single_leaf():
    one = TreeNodes(np.array([-1]), np.array([-1]), np.array([2.0]), np.array([5.0]))
    assert one.collapse_at().tolist() == [0] and one.ends([0, 1]).tolist() == [[0], [0]]
    chain = TreeNodes(np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.zeros(5), np.array([10.0, 1, 6, 2, 3]))
    assert chain.collapse_at().tolist() == pytest.approx([0.3, 0, 0.1, 0, 0])


def test_judged_subtrees_score_as_pruned_models_do(prepared):
    train, held = prepared.filter("fold != 0"), prepared.filter("fold = 0")
    tree = models.decision_tree("y", tree_depth=6, min_n=3).fit(train)
    for cost, (rmse, leaves) in zip(COSTS, judge_subtrees(tree, held, "y", COSTS), strict=True):
        small = prune(tree, cost)
        assert small.numNodes == 2 * leaves - 1
        out = small.transform(held).select(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).alias("e")).first()
        assert out.e == pytest.approx(rmse, rel=1e-9)
    assert judge_subtrees(tree, held.limit(0), "y", [0.1])[0][0] is None


def test_a_pruned_tree_is_saved_like_any_model(prepared, tmp_path):
    fitted = pruned_tree("y", 0.01, tree_depth=5).fit(prepared)
    S.save_model(PipelineModel([fitted]), str(tmp_path / "m"))
    again = S.load_model(str(tmp_path / "m"))
    both = models.predict(fitted, prepared, name="one").join(models.predict(again, prepared, name="two").select("id", "two"), "id")
    assert both.filter("one != two").isEmpty() and fitted.numNodes < models.decision_tree("y", tree_depth=5).fit(prepared).numNodes


def test_pruned_trees_are_tuned_from_one_tree_per_fold(rows, monkeypatch):
    from umbral.learning import pruning

    grown = []
    plain = pruning.decision_tree
    monkeypatch.setattr(pruning, "decision_tree", lambda *a, **k: grown.append(1) or plain(*a, **k))
    recipe = prep.Recipe(label="y", numeric=["x0", "x1", "x2"], factors=[])
    out = tune_pruned_tree(rows, recipe, "y", tuning.COST_COMPLEXITY.levels(25), tree_depth=4)
    assert out.count() == 25 * 3 * 2 and len(grown) == 3
    best = tuning.select_best(tuning.collect_metrics(out), "rmse")
    assert 0 < best["cost"] <= 0.1


@pytest.mark.parametrize("pooled", [True, False])
def test_discriminants_are_saved_with_their_settings(spark, prepared, tmp_path, pooled):
    fitted = discriminant.DiagonalDiscriminant("c", pooled, unbiased=True).fit(prepared)
    S.save_model(PipelineModel([fitted]), str(tmp_path / "m"))
    again = S.load_model(str(tmp_path / "m"))
    one, two = (models.predict(m, prepared, "prob").select("id", "score").toPandas().sort_values("id").score.to_numpy() for m in (fitted, again))
    assert (one == two).all() and ((one > 0.5).mean() > 0.2)
    called = fitted.transform(prepared)
    assert called.filter((F.col("prediction") == 1) != (models.event_probability() > 0.5)).isEmpty()


def test_flat_columns_and_odd_classes(spark):
    data = [(0.0, 1.0, 5.0, 0), (0.0, 2.0, 5.0, 0), (1.0, 3.0, 5.0, 1), (0.0, 5.0, 5.0, 1), (9.0, 9.0, 5.0, None)]
    df = spark.createDataFrame(data, "a double, b double, flat double, c int").withColumn("features", array_to_vector(F.array("a", "b", "flat")))
    fitted = discriminant.qda_diag("c").fit(df)
    spread = np.array(fitted.getOrDefault(fitted.variances)).reshape(2, 3)
    assert spread.tolist() == [[pytest.approx(0.125), 0.25, 0.0], [0.25, 1.0, 0.0]]
    scores = [r.score for r in models.predict(fitted, df, "prob").collect()]
    assert all(0 <= s <= 1 for s in scores)
    alone = discriminant.lda_diag("c").fit(df.filter("c = 1"))
    assert {r.prediction for r in alone.transform(df).collect()} == {1.0}
    with pytest.raises(ValueError):
        discriminant.lda_diag("c").fit(df.filter("c IS NULL"))


def test_many_columns_score_in_one_small_plan(spark):
    wide = spark.range(60).select((F.col("id") % 2).cast("int").alias("c"), array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.cos(k * F.col("id")) + F.col("id") % 2)).alias("features"))
    fitted = discriminant.lda_diag("c").fit(wide)
    assert models.predict(fitted, wide, "prob").filter((F.col("score") > 0.5) != (F.col("c") == 1)).isEmpty()


def test_runs_of_other_learners(rows):
    train, test = rows.drop("fold"), rows.drop("fold").withColumn("Lp", F.lit(4.0))
    config = RunConfig(label="c", not_predictors=("id", "y", "c", "fold"), interact_numeric=(), interact_factor=None, folds=2)
    build = lambda label, **more: models.boost_tree(models.CLASSIFICATION, label, tree_depth=2, trees=3, **more)
    for learner in (Fixed(discriminant.qda_diag), Tuned(build, [{"learn_rate": 0.3}], "f_meas"), Fixed(models.dense_classifier, {"hidden": (4,), "epochs": 60})):
        run = end_to_end(train, test, config, learner)
        right = run.submission.join(test, "id").agg(F.avg((F.col("pobre") == F.col("c")).cast("double"))).first()[0]
        assert right > 0.75 and 0 <= run.cutoff <= 1
    income = RunConfig(label="y", not_predictors=("id", "y", "c", "fold", "Lp"), interact_numeric=(), interact_factor=None, folds=2)
    run = end_to_end_income(train, test, income, PrunedTrees([1e-3, 0.9], {"tree_depth": 4}))
    assert run.best["cost"] == 1e-3 and run.submission.count() == 500


def test_terms_a_lasso_drops_are_not_seen_by_the_next_model(rows):
    noisy = rows.drop("fold").withColumn("noise", F.rand(5))
    config = RunConfig(label="y", not_predictors=("id", "y", "c", "fold"), interact_numeric=(), interact_factor=None, folds=2)
    first = learn(noisy, config, lasso_path(5))
    big = lasso_path(1)
    big = type(big)([0.6], [1.0])
    found = learn(noisy, RunConfig(**{**config.__dict__, "chosen_by": big}), Fixed(lambda label, **m: models.ols(label, **m), score="numeric"))
    assert prep.feature_names(found.model) == ["x0"] and len(prep.feature_names(first.model)) == 4


def test_a_balanced_table_is_fitted(rows):
    few = rows.drop("fold").filter("c = 0 OR id % 4 = 0")
    config = RunConfig(label="c", not_predictors=("id", "y", "c", "fold"), interact_numeric=(), interact_factor=None, folds=2, under_ratio=1.0)
    found = learn(few, config, Fixed(discriminant.lda_diag))
    n = found.model.stages[-1].getOrDefault(found.model.stages[-1].counts)
    assert n[0] == n[1] == few.filter("c = 1").count()


def test_a_path_learned_from_sums_is_that_of_prepared_rows(rows):
    """Columns far from zero, a flat one and a factor: same terms, coefficients and scores as preparation and refit by Spark ML."""
    df = rows.withColumns({"far": F.col("x1") * 3 + 1e6, "flat": F.lit(7.0), "f": F.concat(F.lit("l"), F.col("id") % 3)})
    recipe = prep.Recipe(label="y", not_predictors=("id", "y", "c", "fold", "x1"))
    path = lasso_path(4)
    found = type(path)([0.001, 0.05, 0.3], [0.5, 1.0]).learn(df, recipe, "y")
    slow = tuning.finalize_fit(df, recipe, lambda label, **m: models.linear_reg(label, tol=1e-12, solver="l-bfgs", **m), found.best, "y")
    terms = {r.term: r.estimate for r in found.terms.collect()}
    assert list(terms) == ["(Intercept)", *prep.feature_names(slow)] and "flat" not in terms
    want = [slow.stages[-1].intercept, *slow.stages[-1].coefficients.toArray()]
    assert list(terms.values()) == pytest.approx(want, abs=1e-5)
    both = models.predict(found.model, df, name="a").select("id", "a").join(models.predict(slow, df, name="b").select("id", "b"), "id")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-4


def test_a_learned_path_is_saved(spark, rows, tmp_path):
    found = lasso_path(3).learn(rows, prep.Recipe(label="y", not_predictors=("id", "y", "c", "fold")), "y")
    S.save_model(found.model, str(tmp_path / "m"))
    missing = rows.withColumn("x0", F.when(F.col("id") != 5, F.col("x0")))
    a, b = (models.predict(m, missing).select("id", "score").toPandas().sort_values("id").score for m in (found.model, S.load_model(str(tmp_path / "m"))))
    assert a.equals(b) and a.isna().sum() == 1
