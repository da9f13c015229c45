"""Cross-validation: candidates judged together as one by one, and runs that go on where they ended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbral.learning import discriminant, evaluate, models, prep, tuning
from umbral.operators.sampling import kfold


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 2))
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400)
    rows = [(i, *map(float, r), float(v), int(v > 0)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return kfold(spark.createDataFrame(rows, "id long, x0 double, x1 double, y double, c int"), 2, "id", 1).cache()


RECIPE = {"numeric": ["x0", "x1"], "factors": []}
CLASS_METRICS = [tuning.AREA, "f_meas", "accuracy", "sens", "spec", "precision", "log_loss"]


def test_models_judged_together_score_as_alone(table):
    prepared = prep.design_matrix(table, ["x0", "x1"])
    fitted = [models.logit("c", penalty=p).fit(prepared) for p in (0.0, 0.05)]
    fitted += [models.rand_forest(models.CLASSIFICATION, "c", trees=3, tree_depth=3).fit(prepared), discriminant.qda_diag("c").fit(prepared), models.ols("c").fit(prepared)]
    odd = prepared.withColumn("c", F.when(F.col("id") % 50 > 0, F.col("c")))
    found = tuning.measure_all(fitted, odd, "c", CLASS_METRICS, models.CLASSIFICATION)
    for model, values in zip(fitted, found, strict=True):
        out = model.transform(odd)
        score = models.event_probability() if "probability" in out.columns else F.col("prediction")
        alone = evaluate.class_metrics(out.withColumn("score", score), "c", "score").first()
        want = {tuning.AREA: alone.auc, "f_meas": alone.f_meas, "accuracy": alone.accuracy, "sens": alone.recall, "spec": alone.specificity, "precision": alone.precision, "log_loss": alone.log_loss}
        assert values == {k: pytest.approx(v) for k, v in want.items()}


def test_a_run_goes_on_where_it_ended(table, tmp_path):
    path, fits = str(tmp_path / "results"), []

    def build(label, penalty, broken=False):
        fits.append(penalty)
        if broken:
            raise RuntimeError("the driver is gone")
        return models.lasso(label, penalty)

    recipe, grid = prep.Recipe(label="y", **RECIPE), tuning.grid_expand(penalty=[0.01, 0.1])
    whole = tuning.tune_cv(table, recipe, build, grid, "y", ["rmse", "mae"], models.REGRESSION)
    fits.clear()
    ends = lambda label, penalty: build(label, penalty, broken=len(fits) >= 2)
    with pytest.raises(RuntimeError):
        tuning.tune_cv(table, recipe, ends, grid, "y", ["rmse", "mae"], models.REGRESSION, results=path, parallelism=1)
    fits.clear()
    again = tuning.tune_cv(table, recipe, build, grid, "y", ["rmse", "mae"], models.REGRESSION, results=path)
    assert len(fits) == 2  # the second fold only
    key = lambda r: (r.candidate, r.fold, r.metric)
    a, b = ({key(r): r.value for r in df.collect()} for df in (whole, again))
    assert a == {k: pytest.approx(v) for k, v in b.items()} and len(a) == 8
    fits.clear()
    assert tuning.tune_cv(table, recipe, build, grid, "y", ["rmse", "mae"], models.REGRESSION, results=path).count() == 8 and not fits


def test_areas_of_several_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 9)), k) for k in range(3) for _ in range(200)] + [(None, 1.0, 0), (1, float("nan"), 1), (1, None, 2), (1, 2.0, 9)]
    df = spark.createDataFrame(rows, "y int, s double, k int")
    got = {r.k: r.auc for r in evaluate.auc_by(df, "k", "y", "s").collect()}
    assert got == {**{k: pytest.approx(evaluate.auc(df.filter(F.col("k") == k), "y", "s").first().auc) for k in range(3)}, 9: None}


class Seen(Exception):
    pass


def test_fits_do_not_repeat_the_joins_behind_their_rows(spark, sf, monkeypatch):
    """What is read many times lies in the shared folder, not behind the joins of the survey tables."""
    from umbral.catalog import learning

    def vector(df, *names):
        files.extend(df.inputFiles())
        raise Seen

    files = []
    monkeypatch.setattr(learning, "_vector", vector)
    with pytest.raises(Seen):
        learning.penalised_two(spark, sf)
    assert files and not [f for f in files if "orders.parquet" in f]


@pytest.mark.parametrize("name", ["cv_class_metrics", "logit_l1", "dense_reg"])
def test_preparing_reads_rows_that_were_written(spark, sf, monkeypatch, name):
    from umbral.catalog import learning

    def prepare(recipe, df):
        files.extend(df.inputFiles())
        raise Seen

    files = []
    monkeypatch.setattr(tuning, "prep", prepare)
    with pytest.raises(Seen):
        getattr(learning, name)(spark, sf)
    assert files and not [f for f in files if "orders.parquet" in f]


def test_the_area_reads_written_scores(spark, monkeypatch):
    rows = spark.createDataFrame([(float(k % 2), float(k)) for k in range(20)], "y double, a double")
    rows = prep.design_matrix(rows, ["a"])
    model = models.logit("y").fit(rows)
    monkeypatch.setattr(tuning, "measure_scores", lambda table, *_: table.inputFiles())
    assert tuning.measure_all([model], rows, "y", ["roc_auc", "sens"], models.CLASSIFICATION)
    assert not tuning.measure_all([model], rows, "y", ["sens"], models.CLASSIFICATION)


def test_class_cross_validation_is_the_whole_search(spark, monkeypatch):
    """Five folds, every candidate of the survey's grid, forests of full size."""
    from umbral.catalog import learning

    rows = [(k, "a" if k % 3 else "b", int(k % 7 < 2), *[float(k % m) for m in (5, 4, 11, 6)], k % 2) for k in range(500)]
    names = "id long, Depto string, Pobre int, P5000 double, P5090 double, P5130 double, Npersug double, train int"
    monkeypatch.setattr(learning, "homes", lambda *_: spark.createDataFrame(rows, names))
    seen = []
    judge = lambda df, recipe, build, grid, label: seen.append((df, build, grid)) or spark.createDataFrame([(0, "sens", 0, 1.0)], "candidate int, metric string, fold int, value double")
    monkeypatch.setattr(tuning, "cv_class_metrics", judge)
    learning.cv_class_metrics(spark, "")
    (df, build, grid), = seen
    assert {r.fold for r in df.select("fold").distinct().collect()} == set(range(5)) and df.count() == 250
    assert len({(g["mtry"], g["min_n"]) for g in grid}) == 15 and {g["min_n"] for g in grid} >= {150, 200, 250, 300}
    forest = build("Pobre", **grid[0])
    assert forest.getNumTrees() == 500 and forest.getMaxDepth() == 30
