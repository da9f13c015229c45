"""The whole run: split, prepare, tune, refit, choose a cut-off and score, whatever the model."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.learning.evaluate import dropped_names, roc_threshold
from umbral.learning.models import predict
from umbral.learning.prep import Recipe
from umbral.learning.scoring import score_income, score_threshold
from umbral.operators.sampling import downsample, kfold, split_validation
from umbral.plans.learners import Learned, Learner, LinearPath, lasso_path
from umbral.session import cut_lineage, write_through


@dataclass(frozen=True)
class RunConfig:
    """Columns, preparation and splits of a run.

    ``numeric`` and ``factors`` name the predictors (all others that ``not_predictors`` does not name, if left out). ``chosen_by`` fits that linear model first and
    drops the terms it sets to 0. ``under_ratio`` cuts every class of the fitting rows to that multiple of the smallest one.
    """

    label: str = "Pobre"
    id: str = "id"
    not_predictors: tuple[str, ...] = ("id", "Lp", "Ingpcug", "lIngpcug", "Pobre", "train", "Clase", "Depto", "fold")
    numeric: tuple[str, ...] | None = None
    factors: tuple[str, ...] | None = None
    interact_numeric: tuple[str, ...] = ("P5130", "Educ_avg", "tasa_ocupados", "tasa_inactivos", "P5000", "edad_pet")
    interact_factor: str | None = "Dominio"
    removed: tuple[str, ...] = ()
    chosen_by: LinearPath | None = None
    under_ratio: float | None = None
    pca_threshold: float | None = None
    validation: float = 0.15
    folds: int = 5
    seed: int = 123
    missing_as: int | None = 0

    def recipe(self) -> Recipe:
        return Recipe(
            label=self.label,
            not_predictors=self.not_predictors,
            numeric=None if self.numeric is None else list(self.numeric),
            factors=None if self.factors is None else list(self.factors),
            interact_numeric=self.interact_numeric,
            interact_factor=self.interact_factor,
            removed=self.removed,
            pca_threshold=self.pca_threshold,
        )


@dataclass(frozen=True)
class Run:
    model: PipelineModel
    terms: DataFrame | None
    metrics: DataFrame | None
    best: dict
    cutoff: float | None
    submission: DataFrame


def learn(train: DataFrame, config: RunConfig, learner: Learner) -> Learned:
    """The learner's model from ``train``, on the terms a first model chose and on a balanced table if the run asks for that."""
    folded = kfold(train, config.folds, config.id, config.seed)
    if config.chosen_by is not None:
        # Components mix all terms, so the choice is made before them.
        first = config.chosen_by.learn(folded, replace(config, pca_threshold=None).recipe(), config.label)
        config = replace(config, removed=(*config.removed, *dropped_names(first.terms)))
    if config.under_ratio is not None:
        folded = write_through(downsample(folded, config.label, config.id, config.seed, config.under_ratio), "balanced")
    return learner.learn(folded, config.recipe(), config.label)


def end_to_end(train: DataFrame, test: DataFrame, config: RunConfig = RunConfig(), learner: Learner | None = None) -> Run:
    """Classifier run: cut-off from held-out rows, then ``(id, pobre)`` for the test table. Without a learner, the lasso path."""
    learner = learner or lasso_path()
    # Learning reads the table several times; the joins behind it run once.
    train = write_through(train, "train")
    fitting, held_out = split_validation(train, config.validation, config.id, config.seed)
    found = learn(fitting, config, learner)
    # The curve reads the scores several times; written once, they are not computed again.
    judged = cut_lineage(predict(found.model, held_out, learner.score).select(F.col(config.label).alias("real"), "score"))
    cutoff = roc_threshold(judged, "real", "score").first()["threshold"]
    submission = score_threshold(predict(found.model, test, learner.score), "score", cutoff, config.missing_as)
    return Run(found.model, found.terms, found.metrics, found.best, cutoff, submission)


def end_to_end_income(train: DataFrame, test: DataFrame, config: RunConfig, learner: Learner | None = None) -> Run:
    """Income run: no validation rows; predicted income is compared with the poverty line."""
    found = learn(write_through(train, "train"), config, learner or lasso_path())
    submission = score_income(predict(found.model, test), "score", "Lp", config.missing_as)
    return Run(found.model, found.terms, found.metrics, found.best, None, submission)
