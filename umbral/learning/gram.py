"""Tune penalised linear models from one pass over the data.

Every candidate and fold of a linear fit needs only XᵀX, Xᵀy and yᵀy. Tasks add these
up per fold, Spark sums them, and each (fold, mixture) path is solved from p × p sums.
On columns scaled by their sample deviation the loss is

    RSS / 2n + λ·α·‖b‖₁ + (λ / sd(y))·(1 − α)/2·‖b‖²

which is what ``LinearRegression`` minimises, so tuned penalties carry over to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

MOST_FEATURES = 4000
TOLERANCE = 1e-9
RIDGE = 1e-12
SWEEPS = 5000
#: Folds, and numbers of all folds' matrices, that may travel to the driver.
MOST_FOLDS = 100
MOST_NUMBERS = 100_000_000
ADDING_GROUPS = 32
ROWS_AT_ONCE = 1024


def rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A fixed-width list column as an n × p matrix."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def added_up(features: Column, weights: np.ndarray, start: float = 0.0, centre: np.ndarray | None = None) -> Column:
    """``start`` and, one after the other, every entry of an array times its weight, or its squared distance from ``centre`` times that.

    Equal rows have equal sums wherever they lie in a batch: the entries are added in their order.
    """

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        known = rows.drop_null()
        x = known.flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1)
        out = np.full(len(known), start)
        for k in range(0, len(known), ROWS_AT_ONCE):
            part = x[k : k + ROWS_AT_ONCE]
            terms = (part if centre is None else (part - centre) ** 2) * weights
            terms[:, 0] += start
            out[k : k + ROWS_AT_ONCE] = np.add.accumulate(terms, axis=1)[:, -1]
        if len(known) == len(rows):
            return pa.array(out)
        valid = rows.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(out).take(pa.array(np.cumsum(valid) - 1, mask=~valid))

    return run(features)


def fold_sums(df: DataFrame, features: str, label: str, fold: str, shift: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """ZᵀZ of Z = [1, X − shift, y] for each fold; the driver receives folds × (p + 2)² numbers. ``features`` is a vector or an array.

    Any row's values are a good ``shift``: without it, variances of columns far from zero lose digits.
    """
    first = df.select(features).first()
    if first is None:
        raise ValueError("no rows to learn from")
    width = len(first[0])
    if width > MOST_FEATURES:
        raise ValueError(f"{width} features; use tune_cv beyond {MOST_FEATURES}")
    rows = df.select(
        F.col(fold).cast("int").alias("fold"),
        F.col(label).cast("double").alias("y"),
        (F.col(features) if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(features)).alias("x"),
    ).filter("fold IS NOT NULL AND y IS NOT NULL")
    most = min(MOST_FOLDS, MOST_NUMBERS // (width + 2) ** 2)

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            x = rows_of(batch, "x")
            z = np.column_stack([np.ones(batch.num_rows), x if shift is None else x - shift, batch.column("y").to_numpy(zero_copy_only=False)])
            for k in np.unique(folds):
                part = z[folds == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
            if len(sums) > most:
                raise ValueError(f"{len(sums)} folds of {width} features; at most {most} can be kept")
        for k, m in sums.items():
            size = m.shape[0]
            yield pa.RecordBatch.from_pydict(
                {
                    "fold": pa.array([k] * size, pa.int32()),
                    "i": pa.array(range(size), pa.int32()),
                    "line": pa.array(list(m), pa.list_(pa.float64())),
                }
            )

    # Each split gives one matrix; they are added up in groups first, so no task adds those of all splits.
    parts = rows.mapInArrow(add_up, "fold int, i int, line array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ADDING_GROUPS)))
    groups = parts.groupBy("fold", "i", "part").agg(Summarizer.sum(array_to_vector("line")).alias("vector"))
    lines = groups.select("fold", "i", vector_to_array("vector").alias("line"))
    summed = lines.groupBy("fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("line"))).alias("line"))
    out: dict[int, np.ndarray] = {}
    for r in summed.toPandas().itertuples(index=False):
        out.setdefault(int(r.fold), np.zeros((width + 2, width + 2)))[int(r.i)] = r.line
    return dict(sorted(out.items()))


@dataclass(frozen=True)
class Standardised:
    """Sums of one training set with columns centred and scaled; constant columns are left out."""

    kept: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    y_mean: float
    y_sd: float
    gram: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(m: np.ndarray) -> Standardised:
        n = m[0, 0]
        mean, y_mean = m[0, 1:-1] / n, m[0, -1] / n
        cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
        cross = m[1:-1, -1] / n - mean * y_mean
        y_var = max(m[-1, -1] / n - y_mean**2, 0.0)
        var = np.diag(cov)
        scale = np.maximum(np.diag(m)[1:-1] / n, 1e-300)
        kept = np.flatnonzero(var > 1e-12 * scale)
        bessel = n / (n - 1)
        sd = np.sqrt(var[kept] * bessel)
        return Standardised(
            kept, mean[kept], sd, y_mean, float(np.sqrt(y_var * bessel)),
            cov[np.ix_(kept, kept)] / np.outer(sd, sd), cross[kept] / sd,
        )

    def raw(self, b: np.ndarray, width: int) -> np.ndarray:
        """[intercept, coefficients…] on the original columns."""
        out = np.zeros(width + 1)
        out[1 + self.kept] = b / self.sd
        out[0] = self.y_mean - float(self.mean @ (b / self.sd))
        return out


def solve_path(s: Standardised, mixture: float, penalties: list[float]) -> dict[float, np.ndarray]:
    """Standardised coefficients per penalty, from the largest penalty down with warm starts."""
    if s.y_sd == 0:
        return {p: np.zeros(len(s.cross)) for p in penalties}
    if mixture == 0:
        values, vectors = np.linalg.eigh(s.gram)
        turned = vectors.T @ s.cross
        bottom = lambda p: np.maximum(values, 0) + p / s.y_sd
        return {p: vectors @ np.where(bottom(p) > 1e-13, turned / np.maximum(bottom(p), 1e-13), 0.0) for p in penalties}
    out, b = {}, np.zeros(len(s.cross))
    for p in sorted(penalties, reverse=True):
        b = _descend(s, b.copy(), p * mixture, p * (1 - mixture) / s.y_sd)
        out[p] = b
    return out


def _descend(s: Standardised, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Penalised minimum from a start: active-set steps, or coordinate descent should they not settle."""
    found = _active_set(s, b.copy(), l1, l2)
    return found if found is not None else _coordinates(s, b, l1, l2)


def _active_set(s: Standardised, b: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """Feature-sign search: solve for the present signs, stop at the first zero crossing,
    then let in the column that violates the optimality condition most."""
    slack = TOLERANCE * max(1.0, s.y_sd)
    signs, refused = np.sign(b), np.zeros(len(b), bool)
    for _ in range(20 * len(b) + 100):
        used = np.flatnonzero(signs)
        if len(used):
            block = s.gram[np.ix_(used, used)] + (l2 + RIDGE) * np.eye(len(used))
            target = np.linalg.solve(block, s.cross[used] - l1 * signs[used])
            crossing = np.sign(target) != signs[used]
            if crossing.any():
                start = b[used]
                way = np.where(crossing, np.abs(start) / np.maximum(np.abs(start - target), 1e-300), 1.0)
                step = way.min()
                b[used] = start + step * (target - start)
                leaving = used[crossing & (way <= step)]
                b[leaving], signs[leaving] = 0.0, 0.0
                refused[leaving] |= step == 0
                continue
            b[used] = target
        pull = np.abs(s.cross - s.gram @ b)
        pull[(signs != 0) | refused] = 0.0
        j = int(np.argmax(pull)) if len(pull) else 0
        if not len(pull) or pull[j] <= l1 + slack:
            # Columns that were refused once must hold the condition as well; else coordinate descent goes on from here.
            left_out = np.abs(s.cross - s.gram @ b)[refused & (signs == 0)]
            return b if not len(left_out) or left_out.max() <= l1 + slack else None
        signs[j] = np.sign(s.cross[j] - s.gram[j] @ b)
    return None


def _coordinates(s: Standardised, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    gram, rest = s.gram, s.cross - s.gram @ b
    diagonal, slack = np.diag(gram), TOLERANCE * max(1.0, s.y_sd)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(b)):
            pull = rest[j] + diagonal[j] * b[j]
            step = np.sign(pull) * max(abs(pull) - l1, 0.0) / (diagonal[j] + l2) - b[j]
            if step:
                rest -= gram[j] * step
                b[j] += step
                moved = max(moved, abs(step))
        if moved <= slack:
            return b
    raise RuntimeError(f"no solution after {SWEEPS} sweeps: columns may be nearly the same")


def held_out_rmse(m: np.ndarray, beta: np.ndarray) -> float:
    """RMSE on the rows behind the sums ``m`` of a fit ``beta`` = [intercept, coefficients…]."""
    full = np.append(beta, -1.0)
    return float(np.sqrt(max(full @ m @ full, 0.0) / m[0, 0]))


def tune_linear_path(
    df: DataFrame, features: str, label: str, fold: str, penalties: list[float], mixtures: list[float], pairs: list[tuple[float, float]] | None = None
) -> DataFrame:
    """Held-out RMSE of every (penalty, mixture) on every fold: ``(candidate, penalty, mixture, fold, metric, value)``.

    Equal to fitting each candidate on each fold, at the cost of one pass. The small
    solves run as Spark tasks, one per fold and mixture.
    """
    return tune_sums(df.sparkSession, fold_sums(df, features, label, fold), penalties, mixtures, pairs)


def tune_sums(
    spark: SparkSession, sums: dict[int, np.ndarray], penalties: list[float], mixtures: list[float], pairs: list[tuple[float, float]] | None = None
) -> DataFrame:
    """The same from the sums. ``pairs`` of penalty and mixture stand for every penalty with every mixture."""
    if len(sums) < 2:
        raise ValueError("need rows in at least two folds")
    shared = spark.sparkContext.broadcast(sums)
    pairs = pairs if pairs is not None else [(p, m) for m in mixtures for p in penalties]
    pairs = list(dict.fromkeys((float(p), float(m)) for p, m in pairs))
    number = {pair: i for i, pair in enumerate(pairs)}
    paths: dict[float, list[float]] = {}
    for p, m in pairs:
        paths.setdefault(m, []).append(p)

    def solve(batches):
        parts = shared.value
        total = sum(parts.values())
        for pdf in batches:
            for job in pdf.itertuples(index=False):
                train, held = total - parts[job.fold], parts[job.fold]
                s = Standardised.of(train)
                path = solve_path(s, job.mixture, paths[job.mixture])
                width = train.shape[0] - 2
                yield pd.DataFrame(
                    {
                        "candidate": [number[p, job.mixture] for p in path],
                        "penalty": list(path),
                        "mixture": job.mixture,
                        "fold": job.fold,
                        "metric": "rmse",
                        "value": [held_out_rmse(held, s.raw(b, width)) for b in path.values()],
                    }
                )

    jobs = spark.createDataFrame([(k, m) for m in paths for k in sums], "fold int, mixture double")
    spread = jobs.repartition(min(len(sums) * len(paths), 4 * spark.sparkContext.defaultParallelism))
    return spread.mapInPandas(
        solve, "candidate int, penalty double, mixture double, fold int, metric string, value double"
    )


def fit_path(sums: dict[int, np.ndarray], penalty: float, mixture: float) -> np.ndarray:
    """[intercept, coefficients…] of one candidate on all rows, from the same sums."""
    total = sum(sums.values())
    s = Standardised.of(total)
    return s.raw(solve_path(s, mixture, [penalty])[penalty], total.shape[0] - 2)


class ScaledLinearModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A linear model of centred and scaled columns that reads them as they are; saved and loaded like any other stage."""

    means = Param(Params._dummy(), "means", "centre of each column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "sample deviation of each column", TypeConverters.toListFloat)
    slopes = Param(Params._dummy(), "slopes", "coefficients of the scaled columns", TypeConverters.toListFloat)
    level = Param(Params._dummy(), "level", "prediction at the centre", TypeConverters.toFloat)

    def __init__(self, means=(), deviations=(), slopes=(), level: float = 0.0, features: str = "features"):
        super().__init__()
        self._set(means=list(means), deviations=list(deviations), slopes=list(slopes), level=float(level), featuresCol=features)

    @property
    def coefficients(self) -> DenseVector:
        """Of the scaled columns."""
        return Vectors.dense(self.getOrDefault(self.slopes))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.level)

    def _transform(self, df: DataFrame) -> DataFrame:
        slopes, means = self.coefficients.toArray(), np.array(self.getOrDefault(self.means))
        weights = slopes / np.array(self.getOrDefault(self.deviations))
        total = added_up(vector_to_array(self.getFeaturesCol()), weights, float(self.intercept - weights @ means)) if len(weights) else F.lit(self.intercept)
        return df.withColumn(self.getPredictionCol(), total)


def fit_scaled(sums: dict[int, np.ndarray], shift: np.ndarray, penalty: float, mixture: float, features: str) -> tuple[list[int], ScaledLinearModel]:
    """Columns that vary, and the model of one candidate on them, from sums over ``X − shift``."""
    s = Standardised.of(sum(sums.values()))
    slopes = solve_path(s, mixture, [penalty])[penalty]
    return s.kept.tolist(), ScaledLinearModel((s.mean + shift[s.kept]).tolist(), s.sd.tolist(), slopes.tolist(), s.y_mean, features)
