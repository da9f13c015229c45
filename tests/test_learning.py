"""Preparation and models against closed forms, optimality conditions and numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from umbral.learning import dense, discriminant, gram, models, prep, scoring, tuning
from umbral.operators.sampling import kfold
from umbral.sources import tables as S

N, P = 600, 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, P)) * np.array([1, 5, 0.1, 2, 1, 1]) + 3
    x[:, 4] = x[:, 0] + 0.01 * rng.normal(size=N)
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + 10 * x[:, 2] + rng.normal(size=N)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    names = [f"x{i}" for i in range(P)]
    rows = [(i, *map(float, r), float(v), int(v > np.median(y))) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", y double, c int")
    return kfold(prep.design_matrix(df, names), 3, "id", 1).cache()


def standard(x, y):
    return (x - x.mean(0)) / x.std(0, ddof=1), y - y.mean(), y.std(ddof=1)


def test_ridge_has_its_closed_form(table, data):
    x, y = data
    z, yc, sy = standard(x, y)
    want = np.linalg.solve(z.T @ z / N + 0.7 / sy * np.eye(P), z.T @ yc / N) / x.std(0, ddof=1)
    model = models.ridge("y", 0.7, solver="l-bfgs", tol=1e-12).fit(table)
    assert model.coefficients.toArray() == pytest.approx(want, abs=1e-5)
    assert gram.fit_path(gram.fold_sums(table, "features", "y", "fold"), 0.7, 0.0)[1:] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("penalty,mixture", [(1e-8, 1.0), (0.05, 1.0), (0.4, 0.5), (2.0, 1.0)])
def test_path_meets_optimality_conditions(table, data, penalty, mixture):
    x, y = data
    z, yc, sy = standard(x, y)
    beta = gram.fit_path(gram.fold_sums(table, "features", "y", "fold"), penalty, mixture)
    b = beta[1:] * x.std(0, ddof=1)
    slope = z.T @ (yc - z @ b) / N - penalty * (1 - mixture) / sy * b
    for j in range(P):
        if b[j]:
            assert slope[j] == pytest.approx(penalty * mixture * np.sign(b[j]), abs=1e-6)
        else:
            assert abs(slope[j]) <= penalty * mixture + 1e-6
    assert beta[0] == pytest.approx(y.mean() - x.mean(0) @ beta[1:])


def test_coordinate_descent_agrees_with_active_set(table):
    s = gram.Standardised.of(sum(gram.fold_sums(table, "features", "y", "fold").values()))
    for l1, l2 in ((0.2, 0.0), (0.05, 0.1)):
        a = gram._active_set(s, np.zeros(P), l1, l2)
        assert gram._coordinates(s, np.zeros(P), l1, l2) == pytest.approx(a, abs=1e-5)


def test_large_penalty_leaves_no_slope(table):
    assert not np.any(models.lasso("y", 100.0).fit(table).coefficients.toArray())
    assert not np.any(gram.fit_path(gram.fold_sums(table, "features", "y", "fold"), 100.0, 1.0)[1:])


def test_one_pass_tuning_equals_cross_validation(table):
    # Without the near copy, on which the iterative fit converges slowly.
    names = [f"x{i}" for i in range(P) if i != 4]
    penalties, mixtures = [0.01, 0.5], [0.0, 0.5, 1.0]
    rows = prep.design_matrix(table.drop("features"), names)
    fast = {(r.mixture, r.penalty, r.fold): r.value for r in gram.tune_linear_path(rows, "features", "y", "fold", penalties, mixtures).collect()}
    recipe = prep.Recipe(label="y", numeric=names, factors=[])
    build = lambda label, **more: models.linear_reg(label, solver="l-bfgs", tol=1e-12, **more)
    slow = tuning.tune_cv(table.drop("features"), recipe, build, tuning.grid_expand(mixture=mixtures, penalty=penalties), "y", ["rmse"], models.REGRESSION)
    rows = slow.collect()
    assert len(rows) == len(fast) == 18
    for r in rows:
        assert fast[r.mixture, r.penalty, r.fold] == pytest.approx(r.value, abs=1e-5)


def test_sums_do_not_depend_on_partitions(table):
    a = gram.fold_sums(table.repartition(1), "features", "y", "fold")
    b = gram.fold_sums(table.repartition(8), "features", "y", "fold")
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_logit_l1_meets_optimality_conditions(table, data):
    x, _ = data
    penalty = 0.02
    model = models.logit_l1("c", penalty, tol=1e-10, maxIter=200).fit(table.coalesce(1))
    c = np.array([r.c for r in table.orderBy("id").select("c").collect()])
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    slope = (x.T @ (c - p) / N) / x.std(0, ddof=1)
    for j, b in enumerate(model.coefficients.toArray()):
        assert slope[j] == pytest.approx(penalty * np.sign(b), abs=1e-3) if b else abs(slope[j]) <= penalty + 1e-3


@pytest.mark.parametrize("pooled", [True, False])
def test_discriminants_follow_the_formula(table, data, pooled):
    x, _ = data
    names = ["x0", "x1", "x2"]
    c = np.array([r.c for r in table.orderBy("id").select("c").collect()])
    rows = prep.design_matrix(table.drop("features"), names)
    fit = discriminant.DiagonalDiscriminant("c", pooled).fit(rows)
    got = [r.score for r in models.predict(fit, rows, "prob").orderBy("id").collect()]
    z = x[:, :3]
    var = [z[c == k].var(0) for k in (0, 1)]
    if pooled:
        var = [(var[0] * (c == 0).sum() + var[1] * (c == 1).sum()) / N] * 2
    score = [np.log((c == k).mean()) - 0.5 * np.log(var[k]).sum() - 0.5 * ((z - z[c == k].mean(0)) ** 2 / var[k]).sum(1) for k in (0, 1)]
    assert got == pytest.approx(1 / (1 + np.exp(score[0] - score[1])))


@pytest.mark.parametrize("build", [
    lambda: models.decision_tree("y", tree_depth=5),
    lambda: models.rand_forest(models.REGRESSION, "y", mtry=3, trees=20),
    lambda: models.boost_tree(models.REGRESSION, "y", trees=10, tree_depth=3, learn_rate=0.3),
])
def test_trees_beat_the_mean(table, build):
    out = build().fit(table).transform(table).select(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("e"), F.var_pop("y").alias("v")).first()
    assert out.e < 0.5 * out.v


def test_dense_ranges_beat_the_mean_and_are_saved(table, tmp_path):
    names = [f"x{i}" for i in range(P)]
    df = table.drop("features")
    model = tuning.finalize_fit(df, prep.Recipe(numeric=names, factors=[]), dense.dense_regressor, {"hidden": (8,), "epochs": 40}, "y")
    S.save_model(model, str(tmp_path / "m"))
    for fitted in (model, S.load_model(str(tmp_path / "m"))):
        out = models.predict(fitted, df).select(F.avg(F.pow(F.col("y") - F.col("score"), 2)).alias("e"), F.var_pop("y").alias("v")).first()
        assert out.e < 0.7 * out.v


def test_pairs_are_judged_as_in_the_whole_grid(table):
    whole = {(r.penalty, r.mixture, r.fold): r.value for r in gram.tune_linear_path(table, "features", "y", "fold", [0.01, 0.2], [0.3, 1.0]).collect()}
    some = gram.tune_linear_path(table, "features", "y", "fold", [], [], [(0.2, 0.3), (0.01, 1.0), (0.2, 0.3)]).collect()
    assert len(some) == 6 and {r.candidate for r in some} == {0, 1}
    assert all(r.value == pytest.approx(whole[r.penalty, r.mixture, r.fold]) for r in some)


def test_recipe_terms_levels_and_missing(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b", 5.0), (2, 2.0, "a", 6.0), (3, 4.0, "c'x", 5.5), (4, None, "a", 1.0), (5, 3.0, "a", 2.0)], "id int, n double, f string, y double"
    )
    recipe = prep.Recipe(label="y", interact_numeric=("n",), interact_factor="f", removed=("f_b",), scale=False)
    prepared = prep.prep(recipe, df)
    assert prep.feature_names(prepared) == ["n", "f_c'x", "n_x_f_b", "n_x_f_c'x"]
    new = spark.createDataFrame([(7, 2.0, "new"), (8, 2.0, "b"), (9, None, "b"), (10, 1.0, None)], "id int, n double, f string")
    got = {r.id: list(r.x) for r in prep.bake(prepared, new, ["id"]).select("id", vector_to_array("features").alias("x")).collect()}
    assert got == {7: [2, 0, 0, 0], 8: [2, 0, 2, 0]}


def test_prediction_keeps_incomplete_rows_and_survives_saving(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2], 2.0 * i) for i in range(20)] + [(99, None, "a", None)], "id int, n double, f string, y double")
    fitted = tuning.finalize_fit(df.filter("y IS NOT NULL"), prep.Recipe(label="y"), models.ols, {}, "y")
    S.save_model(fitted, str(tmp_path / "m"))
    for model in (fitted, S.load_model(str(tmp_path / "m"))):
        scores = {r.id: r.score for r in models.predict(model, df).collect()}
        assert scores[99] is None and scores[7] == pytest.approx(14.0)
    out = models.predict(fitted, df)
    assert {r.pobre for r in scoring.score_threshold(out.filter("id = 99"), "score", 1.0).collect()} == {0}
    assert {r.pobre for r in scoring.score_threshold(out.filter("id = 99"), "score", 1.0, missing_as=None).collect()} == {None}


def test_pca_keeps_fewest_components(spark, data):
    x, _ = data
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(P)))
    prepared = prep.prep(prep.Recipe(not_predictors=(), pca_threshold=0.8), df)
    share = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1] / P
    want = int(np.argmax(np.cumsum(share) >= 0.8)) + 1
    assert prep.feature_names(prepared) == [f"PC{i + 1}" for i in range(want)]


def test_wrong_metric_is_an_error(table):
    recipe = prep.Recipe(label="y", numeric=["x0"], factors=[])
    with pytest.raises(ValueError):
        tuning.tune_cv(table.drop("features"), recipe, models.ols, [{}], "y", ["f_meas"], models.REGRESSION)
    metrics = table.sparkSession.createDataFrame([(0, "rmse", 1.0)], "candidate int, metric string, mean double")
    with pytest.raises(ValueError):
        tuning.select_best(metrics, "mae")


def test_grids():
    assert tuning.PENALTY.levels(3) == pytest.approx([1e-10, 1e-5, 1.0])
    assert tuning.Range(5, 20, whole=True).levels(4) == [5, 10, 15, 20]
    assert len(tuning.grid_regular([5, 5, 2, 3], a=tuning.Range(5, 20, whole=True), b=tuning.Range(5, 20, whole=True),
                                   c=tuning.Range(1000, 2000, whole=True), d=tuning.LEARN_RATE)) == 150
    drawn = tuning.grid_random(9, 1, p=tuning.PENALTY, m=tuning.MIN_N)
    assert drawn == tuning.grid_random(9, 1, p=tuning.PENALTY, m=tuning.MIN_N) and all(2 <= g["m"] <= 40 for g in drawn)


def test_design_entries_hold_every_kind_of_value_without_a_lambda(spark):
    rows = [(2.0, "a"), (-3.0, "b"), (None, "c"), (0.0, None), (float("inf"), "b"), (1.5, "never seen"), (float("nan"), "a"), (4.0, "it's")]
    levels = ["a", "b", "c", "it's"]
    df = spark.createDataFrame(rows, "x double, f string")
    made = prep.DesignVector(["t"], [prep.number_block(["x"]), prep.dummy_block("f", levels), prep.interaction_block(["x", "x"], "f", levels)], ["x", "f"])
    nan = float("nan")
    for (x, f), got in zip(rows, made.transform(df).select("features").collect(), strict=True):
        x = nan if x is None else x
        flags = [nan if f is None else float(f == v) for v in levels[1:]]
        want = [x, *flags, *[x * d for d in flags], *[x * d for d in flags]]
        np.testing.assert_array_equal(got[0].toArray(), want)
    assert "->" not in "".join(made.getOrDefault(made.blocks))


def test_weighted_sums_follow_the_order_of_entries_and_keep_missing_rows(spark):
    rng = np.random.default_rng(5)
    x, w, c = rng.normal(size=(50, 40)) * 10.0 ** rng.integers(-8, 8, 40), rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([(k, None if k % 7 == 3 else x[k].tolist()) for k in range(50)], "k int, x array<double>")
    got = df.select("k", gram.added_up(F.col("x"), w, 0.25).alias("a"), gram.added_up(F.col("x"), w, centre=c).alias("b")).collect()
    for k, a, b in got:
        one, two = 0.25, 0.0
        for j in range(40):
            one, two = one + x[k, j] * w[j], two + (x[k, j] - c[j]) * (x[k, j] - c[j]) * w[j]
        assert (a, b) == ((None, None) if k % 7 == 3 else (one, two))


def test_scores_of_wide_vectors_take_no_lambda(spark, capsys):
    df = array_features(spark)
    for model in (discriminant.qda_diag("y").fit(df), gram.ScaledLinearModel([0.0, 0.0], [1.0, 1.0], [1.0, 2.0], 0.5)):
        model.transform(df).select("prediction").explain(True)
        assert "lambdafunction(((" not in (plan := capsys.readouterr().out) and "zip_with" not in plan


def array_features(spark):
    rows = [(float(k % 2), float(k), float(k * k % 7)) for k in range(20)]
    return prep.design_matrix(spark.createDataFrame(rows, "y double, a double, b double"), ["a", "b"])
