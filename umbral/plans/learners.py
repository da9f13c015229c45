"""Ways to learn a model from a folded training table: which candidates are tried, how they are judged, what is refitted.

Every learner gets the same preparation and the same folds and gives back one pipeline that prepares and scores rows, so a run (``workflow.py``) does not
depend on the kind of model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame

from umbral.learning.evaluate import coefficients
from umbral.learning.gram import fit_scaled, fold_sums, tune_sums
from umbral.learning.models import CLASSIFICATION
from umbral.learning.prep import Recipe, bake, feature_names, prep
from umbral.learning.pruning import pruned_tree, tune_pruned_tree
from umbral.learning.tuning import COST_COMPLEXITY, MIXTURE, PENALTY, Grid, collect_metrics, finalize_fit, select_best, tune_cv

#: What a score is: the event's probability, or the predicted number.
PROBABILITY, NUMBER = "prob", "numeric"


@dataclass(frozen=True)
class Learned:
    """``terms`` are the coefficients of a linear model; ``metrics`` and ``best`` are empty where nothing was tuned."""

    model: PipelineModel
    metrics: DataFrame | None
    best: dict
    terms: DataFrame | None


def _terms(model: PipelineModel, df: DataFrame) -> DataFrame | None:
    last = model.stages[-1]
    return coefficients(df.sparkSession, feature_names(model), last) if hasattr(last, "coefficients") else None


def _small(metrics: DataFrame) -> DataFrame:
    """One row per candidate and metric: read several times, computed once."""
    return metrics.sparkSession.createDataFrame(metrics.collect(), metrics.schema)


@dataclass(frozen=True)
class LinearPath:
    """Penalised linear models, all candidates from one pass. For a 0/1 label the predicted number is the score.

    That pass adds up products of columns per fold; which columns vary, how they are scaled, every candidate's error and the final fit all
    follow from these sums, so besides factor levels the training table is read once. Components (PCA) are learned by the general preparation first.
    """

    penalties: list[float] = field(default_factory=lambda: PENALTY.levels(50))
    mixtures: list[float] = field(default_factory=lambda: [1.0])
    score: str = NUMBER

    def learn(self, folded: DataFrame, recipe: Recipe, label: str) -> Learned:
        if recipe.pca_threshold:
            stages = prep(recipe, folded).stages
            rows, last = bake(PipelineModel(stages), folded, [label, "fold"]), recipe.output
        else:
            stages, last = recipe.columns(folded)
            if len(stages) == 1:  # the sums read the entries as they are
                rows = folded.filter(stages[0].complete(folded)).select(label, "fold", stages[0].entries().alias(last))
            else:
                rows = bake(PipelineModel(stages), folded, [label, "fold"], last)
        first = rows.select(last).first()
        if first is None:
            raise ValueError("no rows to learn from")
        shift = np.array(first[0])
        sums = fold_sums(rows, last, label, "fold", shift)
        metrics = _small(collect_metrics(tune_sums(folded.sparkSession, sums, self.penalties, self.mixtures)))
        best = select_best(metrics, "rmse")
        varied, model = fit_scaled(sums, shift, best["penalty"], best["mixture"], f"{recipe.output}_varied")
        whole = PipelineModel([*stages, VectorSlicer(inputCol=last, outputCol=f"{recipe.output}_varied", indices=varied), model])
        return Learned(whole, metrics, best, _terms(whole, folded))


def lasso_path(levels: int = 50) -> LinearPath:
    return LinearPath(PENALTY.levels(levels), [1.0])


def ridge_path(levels: int = 50) -> LinearPath:
    return LinearPath(PENALTY.levels(levels), [0.0])


def net_path(levels: int = 30) -> LinearPath:
    """Elastic net: every penalty with every mixture."""
    return LinearPath(PENALTY.levels(levels), MIXTURE.levels(levels))


@dataclass(frozen=True)
class Tuned:
    """Any builder over a grid, judged by cross-validation on one metric; the best candidate is refitted on all rows."""

    build: Callable[..., Estimator]
    grid: Grid
    metric: str
    kind: str = CLASSIFICATION
    parallelism: int = 4

    @property
    def score(self) -> str:
        return PROBABILITY if self.kind == CLASSIFICATION else NUMBER

    def learn(self, folded: DataFrame, recipe: Recipe, label: str) -> Learned:
        result = tune_cv(folded, recipe, self.build, self.grid, label, [self.metric], self.kind, parallelism=self.parallelism)
        metrics = _small(collect_metrics(result))
        best = select_best(metrics, self.metric)
        model = finalize_fit(folded, recipe, self.build, best, label)
        return Learned(model, metrics, best, _terms(model, folded))


@dataclass(frozen=True)
class Fixed:
    """One model without candidates."""

    build: Callable[..., Estimator]
    params: dict = field(default_factory=dict)
    score: str = PROBABILITY

    def learn(self, folded: DataFrame, recipe: Recipe, label: str) -> Learned:
        model = finalize_fit(folded, recipe, self.build, self.params, label)
        return Learned(model, None, dict(self.params), _terms(model, folded))


@dataclass(frozen=True)
class PrunedTrees:
    """A regression tree, its cost complexity tuned from one grown tree per fold."""

    costs: list[float] = field(default_factory=lambda: COST_COMPLEXITY.levels(25))
    grow: dict = field(default_factory=dict)
    score: str = NUMBER

    def learn(self, folded: DataFrame, recipe: Recipe, label: str) -> Learned:
        metrics = _small(collect_metrics(tune_pruned_tree(folded, recipe, label, self.costs, **self.grow)))
        best = select_best(metrics, "rmse")
        model = finalize_fit(folded, recipe, pruned_tree, {"cost": best["cost"], **self.grow}, label)
        return Learned(model, metrics, best, None)


Learner = LinearPath | Tuned | Fixed | PrunedTrees
