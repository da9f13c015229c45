"""Diagonal discriminant analysis over the prepared vector: one aggregate per class, then a closed-form score.

Means and variances of all columns come from one pass of Spark's ``Summarizer``; the model holds them as arrays and scores rows by sums over Arrow batches, so the
plan has the same size for three columns and for three thousand. Model and settings are saved and loaded like those of any other stage.

A column that is flat inside a class (an indicator of a place where the class does not occur) says nothing about spread there: it takes the variance that all classes
share. A column that is flat in every class has no such variance and is left out of the score.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.learning.gram import added_up

MOST_CLASSES = 1000


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    """Columns read and made, under the names all classifiers use."""


class DiagonalDiscriminantModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Class sizes, and per class and column the mean and variance (0 leaves the column out)."""

    classes = Param(Params._dummy(), "classes", "labels, in order", TypeConverters.toListFloat)
    counts = Param(Params._dummy(), "counts", "rows of each class", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means, class by class", TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "variances, class by class", TypeConverters.toListFloat)

    def __init__(self, **learned):
        super().__init__()
        self._set(**learned)

    def _class_scores(self) -> Column:
        """Log density of each class, up to a number that all classes share, as an array."""
        classes, counts = self.getOrDefault(self.classes), np.array(self.getOrDefault(self.counts))
        means = np.array(self.getOrDefault(self.means)).reshape(len(classes), -1)
        variances = np.array(self.getOrDefault(self.variances)).reshape(len(classes), -1)
        scores = []
        for n, mean, spread in zip(counts, means, variances, strict=True):
            used = spread > 0
            weight = np.where(used, 0.5 / np.where(used, spread, 1.0), 0.0)
            constant = log(n / counts.sum()) - 0.5 * float(np.log(spread[used]).sum())
            scores.append(F.lit(constant) - added_up(F.col("__x"), weight, centre=mean))
        return F.array(*scores)

    def _transform(self, df: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        out = df.withColumn("__x", vector_to_array(self.getFeaturesCol())).withColumn("__s", self._class_scores())
        out = out.withColumn("__top", F.array_max("__s"))
        out = out.withColumn("__e", F.transform("__s", lambda s: F.exp(s - F.col("__top"))))
        total = F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)
        share = F.transform("__e", lambda e: e / F.col("__sum"))
        best = F.element_at(F.lit(classes), F.array_position("__s", F.col("__top")).cast("int"))
        out = out.withColumn("__sum", total).withColumns({self.getProbabilityCol(): array_to_vector(share), self.getPredictionCol(): best})
        return out.drop("__x", "__s", "__top", "__e", "__sum")


class DiagonalDiscriminant(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """``pooled`` shares one variance per column (linear), else each class has its own (quadratic); ``unbiased`` divides by n − 1 (pooled: n − classes)."""

    pooled = Param(Params._dummy(), "pooled", "one variance for all classes", TypeConverters.toBoolean)
    unbiased = Param(Params._dummy(), "unbiased", "divide by degrees of freedom", TypeConverters.toBoolean)

    def __init__(self, label: str = "label", pooled: bool = True, unbiased: bool = False, features: str = "features"):
        super().__init__()
        self._set(labelCol=label, featuresCol=features, pooled=pooled, unbiased=unbiased)

    def _fit(self, df: DataFrame) -> DiagonalDiscriminantModel:
        label, unbiased = F.col(self.getLabelCol()), self.getOrDefault(self.unbiased)
        parts = Summarizer.metrics("count", "mean", "variance").summary(F.col(self.getFeaturesCol())).alias("s")
        found = df.filter(label.isNotNull()).groupBy(label.cast("double").alias("class")).agg(parts).limit(MOST_CLASSES + 1)
        rows = sorted(found.select("class", "s.count", "s.mean", "s.variance").collect())
        if not rows:
            raise ValueError("no row has a label")
        if len(rows) > MOST_CLASSES:
            raise ValueError(f"{self.getLabelCol()} has more than {MOST_CLASSES} classes")
        counts = np.array([float(r[1]) for r in rows])
        squares = np.array([r[3].toArray() for r in rows]) * (counts - 1)[:, None]
        shared = squares.sum(0) / (counts.sum() - (len(rows) if unbiased else 0)) if counts.sum() > len(rows) or not unbiased else squares.sum(0) * 0
        if self.getOrDefault(self.pooled):
            variances = np.tile(shared, (len(rows), 1))
        else:
            own = squares / np.maximum(counts - 1 if unbiased else counts, 1)[:, None]
            variances = np.where(own > 0, own, shared)
        learned = {"classes": [r[0] for r in rows], "counts": counts.tolist(), "means": np.concatenate([r[2].toArray() for r in rows]).tolist(), "variances": variances.ravel().tolist()}
        return self._copyValues(DiagonalDiscriminantModel(**learned))


def lda_diag(label: str, unbiased: bool = False, features: str = "features") -> DiagonalDiscriminant:
    return DiagonalDiscriminant(label, True, unbiased, features)


def qda_diag(label: str, unbiased: bool = False, features: str = "features") -> DiagonalDiscriminant:
    return DiagonalDiscriminant(label, False, unbiased, features)
