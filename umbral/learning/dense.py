"""Dense-network regression from Spark ML's dense classifier over ranges of the outcome."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import QuantileDiscretizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 1


class ExpectedOutcome(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The mean outcome over all ranges, weighted by the network's probabilities."""

    means = Param(Params._dummy(), "means", "mean outcome of each range", TypeConverters.toListFloat)
    output = Param(Params._dummy(), "output", "name of the prediction", TypeConverters.toString)

    def __init__(self, means=(), output: str = "prediction"):
        super().__init__()
        self._set(means=list(means), output=output)

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = F.zip_with(vector_to_array("__p"), F.lit(self.getOrDefault(self.means)), lambda p, m: p * m)
        value = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
        return df.withColumn(self.getOrDefault(self.output), value).drop("__p", "__raw", "__class")


class DenseRegressor(Estimator):
    """Cut the outcome into ``ranges`` of equal size and let a dense network of Spark ML tell them apart.

    Spark ML has no dense regressor; the expected mean of the ranges is a number again. The fitted stages are saved and loaded like any others.
    """

    def __init__(self, label: str, width: int, hidden: tuple[int, ...] = (150, 150), ranges: int = 10, epochs: int = 30, features: str = "features"):
        super().__init__()
        self.label, self.layers, self.ranges, self.epochs, self.features = label, (width, *hidden), ranges, epochs, features

    def _fit(self, df: DataFrame) -> PipelineModel:
        known = df.filter(F.col(self.label).isNotNull())
        binned = QuantileDiscretizer(numBuckets=self.ranges, inputCol=self.label, outputCol="__bin").fit(known).transform(known)
        means = {int(r[0]): float(r[1]) for r in binned.groupBy("__bin").agg(F.avg(self.label)).collect()}
        last = max(means)
        network = MultilayerPerceptronClassifier(
            featuresCol=self.features, labelCol="__bin", layers=[*self.layers, last + 1], maxIter=self.epochs, seed=SEED,
            probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__class",
        )
        return PipelineModel([network.fit(binned), ExpectedOutcome([means.get(k, 0.0) for k in range(last + 1)])])


def dense_regressor(label: str, width: int, **more) -> DenseRegressor:
    return DenseRegressor(label, width, **more)
