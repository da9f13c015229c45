"""Grids, cross-validation, metric tables and the choice of a candidate."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.learning import evaluate
from umbral.learning.models import CLASSIFICATION, event_probability
from umbral.learning.prep import Recipe, bake, feature_names, prep
from umbral.session import kept, write_through


@dataclass(frozen=True)
class Range:
    """Bounds of a hyper-parameter; ``log10`` bounds are exponents."""

    low: float
    high: float
    log10: bool = False
    whole: bool = False

    def _real(self, at: np.ndarray) -> list:
        values = 10.0**at if self.log10 else at
        if self.whole:
            return list(dict.fromkeys(int(np.floor(v + 1e-9)) for v in values))
        return [float(v) for v in values]

    def levels(self, n: int) -> list:
        return self._real(np.linspace(self.low, self.high, n) if n > 1 else np.array([self.low]))

    def draw(self, rng: np.random.Generator, n: int) -> list:
        if self.whole:
            return [int(v) for v in rng.integers(int(self.low), int(self.high) + 1, n)]
        return self._real(rng.uniform(self.low, self.high, n))


# The default ranges of the hyper-parameters.
PENALTY = Range(-10, 0, log10=True)
MIXTURE = Range(0, 1)
LEARN_RATE = Range(-10, -1, log10=True)
COST_COMPLEXITY = Range(-10, -1, log10=True)
MIN_N = Range(2, 40, whole=True)

Grid = list[dict]


def grid_regular(levels: int | list[int], **ranges: Range) -> Grid:
    """Every combination of evenly spaced values."""
    counts = levels if isinstance(levels, list) else [levels] * len(ranges)
    return grid_expand(**{n: r.levels(k) for (n, r), k in zip(ranges.items(), counts, strict=True)})


def grid_random(size: int, seed: int, **ranges: Range) -> Grid:
    rng = np.random.default_rng(seed)
    drawn = {n: r.draw(rng, size) for n, r in ranges.items()}
    return [dict(zip(drawn, values)) for values in zip(*drawn.values())]


def grid_expand(**lists: list) -> Grid:
    return [dict(zip(lists, values)) for values in product(*lists.values())]


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "rmse": evaluate.rmse,
    "mae": evaluate.mae,
    "mse": evaluate.mse,
    "f_meas": evaluate.f_measure,
    "accuracy": evaluate.accuracy,
    "sens": evaluate.recall,
    "spec": evaluate.specificity,
    "precision": evaluate.precision,
    "log_loss": evaluate.log_loss,
}
REGRESSION_METRICS = {"rmse", "mae", "mse"}
LESS_IS_BETTER = {*REGRESSION_METRICS, "log_loss"}
AREA = "roc_auc"
#: Folds whose numbers may travel to the driver.
MOST_FOLDS = 1000


def side_by_side(models: list[Model], held: DataFrame, label: str, kind: str) -> DataFrame:
    """The label and one score column per model, ``s0, s1, …``: the event's probability (or the predicted number where there is none)."""
    out, scores = held, []
    for i, model in enumerate(models):
        names = {model.getParam(p): f"__{p}{i}" for p in ("predictionCol", "probabilityCol", "rawPredictionCol") if model.hasParam(p)}
        out = model.copy(names).transform(out)
        probability = kind == CLASSIFICATION and f"__probabilityCol{i}" in out.columns
        scores.append((event_probability(f"__probabilityCol{i}") if probability else F.col(f"__predictionCol{i}")).alias(f"s{i}"))
    return out.select(F.col(label).alias("label"), *scores)


def measure_all(models: list[Model], held: DataFrame, label: str, metrics: list[str], kind: str) -> list[dict[str, float]]:
    """Metrics of every model on the same rows. The area reads the scores several times, so they are written first."""
    table = side_by_side(models, held, label, kind)
    return measure_scores(write_through(table, "scores") if AREA in metrics else table, len(models), metrics, kind)


def measure_scores(table: DataFrame, n: int, metrics: list[str], kind: str) -> list[dict[str, float]]:
    """Metrics of the scores ``s0 …`` against ``label``: all of them from one pass, all areas from one set of counts.

    Class metrics cover the rows whose score is a number, the area too, which is exact.
    """
    plain = [m for m in metrics if m != AREA]
    parts = []
    for i in range(n):
        score = F.col(f"s{i}")
        if kind == CLASSIFICATION:
            valid = F.col("label").isNotNull() & score.isNotNull() & ~F.isnan(score)
            truth = F.when(valid, F.col("label") == 1)
            parts += [METRICS[m](truth, score if m == "log_loss" else score >= 0.5).alias(f"{m}{i}") for m in plain]
        else:
            parts += [METRICS[m](F.col("label"), score).alias(f"{m}{i}") for m in plain]
    row = table.agg(*parts).first() if parts else None
    out = [{m: row[f"{m}{i}"] for m in plain} for i in range(n)]
    if AREA in metrics:
        entries = [F.struct(F.lit(i).alias("model"), F.col(f"s{i}").alias("score")) for i in range(n)]
        areas = evaluate.auc_by(table.select("label", F.inline(F.array(*entries))), "model", "label", "score")
        found = {r["model"]: r["auc"] for r in areas.collect()}
        out = [{**o, AREA: found.get(i)} for i, o in enumerate(out)]
    return out


def built(build: Callable[..., Estimator], prepared: PipelineModel, label: str, params: dict) -> Estimator:
    """The estimator for prepared rows; a builder that asks for ``width`` gets the length of their vector."""
    if "width" in inspect.signature(build).parameters and "width" not in params:
        params = {**params, "width": len(feature_names(prepared))}
    return build(label=label, **params)


def tune_cv(
    df: DataFrame,
    recipe: Recipe,
    build: Callable[..., Estimator],
    grid: Grid,
    label: str,
    metrics: list[str],
    kind: str,
    fold: str = "fold",
    parallelism: int = 4,
    results: str | None = None,
) -> DataFrame:
    """Fit every candidate on every fold: ``(candidate, parameters…, fold, metric, value)``.

    Preparation is learned once per fold, on its training rows only, and the prepared rows are kept for all candidates of that fold, which
    are judged together. With ``results``, a folder of the shared storage, each fold's rows are written there when they are known, and a run
    that finds them (after the driver was lost) goes on with the next fold.
    """
    unknown = [m for m in metrics if m not in METRICS and m != AREA]
    wrong = [m for m in metrics if (m in REGRESSION_METRICS) == (kind == CLASSIFICATION)]
    if unknown or wrong:
        raise ValueError(f"metrics {unknown or wrong} do not fit {kind}")
    folds = sorted(r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if not 2 <= len(folds) <= MOST_FOLDS:
        raise ValueError(f"{len(folds)} folds")

    def judged(k) -> list[dict]:
        train, held = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        prepared = prep(recipe, train)
        with kept(bake(prepared, train, [label])) as rows, ThreadPool(parallelism) as pool:
            models = pool.map(lambda params: built(build, prepared, label, params).fit(rows), grid)
        found = measure_all(models, bake(prepared, held, [label]), label, metrics, kind)
        return [
            {"candidate": i, **params, "fold": int(k), "metric": m, "value": v if v is None else float(v)}
            for i, (params, values) in enumerate(zip(grid, found, strict=True))
            for m, v in values.items()
        ]

    spark = df.sparkSession
    if results is None:
        return spark.createDataFrame([r for k in folds for r in judged(k)])
    for k in folds:
        path = f"{results}/part-{k}"
        if not _written(spark, path):
            spark.createDataFrame(judged(k)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(*[f"{results}/part-{k}" for k in folds])


def _written(spark: SparkSession, path: str) -> bool:
    """True if a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def cv_class_metrics(df: DataFrame, recipe: Recipe, build: Callable[..., Estimator], grid: Grid, label: str, **more) -> DataFrame:
    """Cross-validation with area under the curve, sensitivity and specificity."""
    return tune_cv(df, recipe, build, grid, label, [AREA, "sens", "spec"], CLASSIFICATION, **more)


NOT_PARAMETERS = ("fold", "value")


def collect_metrics(result: DataFrame) -> DataFrame:
    """Mean, standard error and number of folds per candidate and metric."""
    keys = [c for c in result.columns if c not in NOT_PARAMETERS]
    spread = F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))
    return result.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"), spread.alias("std_err"))


def best_first(metrics: DataFrame, metric: str) -> DataFrame:
    up = metric in LESS_IS_BETTER
    order = F.col("mean").asc_nulls_last() if up else F.col("mean").desc_nulls_last()
    return metrics.filter(F.col("metric") == metric).orderBy(order, "candidate")


def select_best(metrics: DataFrame, metric: str) -> dict:
    """Parameters of the best candidate: least error or most of the others; ties by number."""
    row = best_first(metrics, metric).first()
    if row is None:
        raise ValueError(f"{metric} was not computed")
    return {k: v for k, v in row.asDict().items() if k not in ("metric", "mean", "n", "std_err")}


def finalize_fit(df: DataFrame, recipe: Recipe, build: Callable[..., Estimator], best: dict, label: str) -> PipelineModel:
    """Refit preparation and the chosen candidate on the whole training table."""
    params = {k: v for k, v in best.items() if k != "candidate"}
    prepared = prep(recipe, df)
    with kept(bake(prepared, df, [label])) as rows:
        model = built(build, prepared, label, params).fit(rows)
    return PipelineModel([*prepared.stages, model])


def tuning_curve(metrics: DataFrame, parameter: str, metric: str) -> DataFrame:
    """Metric by parameter value, in order."""
    return metrics.filter(F.col("metric") == metric).select(parameter, "mean", "std_err").orderBy(parameter)
