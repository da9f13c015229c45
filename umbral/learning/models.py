"""Model builders: Spark ML estimators under the parameter names the survey work uses."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.learning.prep import complete_rows

SEED = 123
MOST_BINS = 64
CLASSIFICATION, REGRESSION = "classification", "regression"


def linear_reg(label: str, penalty: float = 0.0, mixture: float = 0.0, features: str = "features", **more) -> LinearRegression:
    """Least squares; ``mixture`` 1 is lasso, 0 is ridge, between them elastic net."""
    return LinearRegression(
        featuresCol=features, labelCol=label, regParam=float(penalty), elasticNetParam=float(mixture), **more
    )


def ols(label: str, **more) -> LinearRegression:
    return linear_reg(label, 0.0, 0.0, **more)


def lasso(label: str, penalty: float, **more) -> LinearRegression:
    return linear_reg(label, penalty, 1.0, **more)


def ridge(label: str, penalty: float, **more) -> LinearRegression:
    return linear_reg(label, penalty, 0.0, **more)


def elastic_net(label: str, penalty: float, mixture: float, **more) -> LinearRegression:
    return linear_reg(label, penalty, mixture, **more)


def linear_probability(label: str, penalty: float = 0.0, mixture: float = 0.0, **more) -> LinearRegression:
    """A linear fit of the 0/1 label, its value used as the score."""
    return linear_reg(label, penalty, mixture, **more)


def logit(label: str, penalty: float = 0.0, mixture: float = 1.0, features: str = "features", **more) -> LogisticRegression:
    """Logistic regression; a penalty above 0 with mixture 1 is the L1 form."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, regParam=float(penalty), elasticNetParam=float(mixture), family="binomial", **more
    )


def logit_l1(label: str, penalty: float, **more) -> LogisticRegression:
    return logit(label, penalty, 1.0, **more)


def decision_tree(label: str, cost: float = 0.0, tree_depth: int = 10, min_n: int = 20, features: str = "features", max_bins: int = MOST_BINS, **more):
    """One regression tree; ``cost`` is the least gain a split must bring."""
    return DecisionTreeRegressor(
        featuresCol=features, labelCol=label, minInfoGain=float(cost), maxDepth=tree_depth,
        minInstancesPerNode=min_n, maxBins=max_bins, seed=SEED, **more,
    )


def rand_forest(mode: str, label: str, mtry: int | str = "auto", min_n: int = 5, trees: int = 250,
                tree_depth: int = 10, features: str = "features", max_bins: int = MOST_BINS, **more):
    """Random forest; ``mtry`` columns are tried at each split."""
    kind = RandomForestClassifier if mode == CLASSIFICATION else RandomForestRegressor
    return kind(
        featuresCol=features, labelCol=label, featureSubsetStrategy=str(mtry), minInstancesPerNode=min_n,
        numTrees=trees, maxDepth=tree_depth, maxBins=max_bins, seed=SEED, **more,
    )


def boost_tree(mode: str, label: str, tree_depth: int = 5, trees: int = 100, mtry: int | str = "all",
               learn_rate: float = 0.1, features: str = "features", max_bins: int = MOST_BINS, **more):
    """Gradient boosted trees."""
    kind = GBTClassifier if mode == CLASSIFICATION else GBTRegressor
    return kind(
        featuresCol=features, labelCol=label, maxDepth=tree_depth, maxIter=trees, stepSize=learn_rate,
        featureSubsetStrategy=str(mtry), maxBins=max_bins, seed=SEED, **more,
    )


def dense_classifier(label: str, width: int, hidden: tuple[int, ...] = (150, 150), epochs: int = 30, features: str = "features", **more):
    """Dense network with two outputs."""
    return MultilayerPerceptronClassifier(
        featuresCol=features, labelCol=label, layers=[width, *hidden, 2], maxIter=epochs, seed=SEED, **more
    )


def event_probability(column: str = "probability"):
    return vector_to_array(F.col(column))[1]


def predict(model: Transformer, df: DataFrame, kind: str = "numeric", name: str = "score") -> DataFrame:
    """Add ``name``: the predicted number, the predicted class, or the event's probability.

    Every row stays; one with a missing predictor gets a missing score.
    """
    complete = complete_rows(model, df) if isinstance(model, PipelineModel) else F.lit(True)
    out = model.transform(df)
    value = event_probability() if kind == "prob" else F.col("prediction")
    added = [c for c in out.columns if c not in df.columns and c != name]
    return out.withColumn(name, F.when(complete, value)).drop(*added)
