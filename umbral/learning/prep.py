"""Feature preparation: learned on one table, applied to any.

Dummies and interactions are arrays of one projection that fills the feature vector
(``DesignVector``): a wide table of made columns would multiply in the optimizer and its
generated code grows too long to be compiled. What follows are stock Spark ML stages, so a
prepared pipeline is saved and loaded like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    PCA,
    PCAModel,
    StandardScaler,
    VarianceThresholdSelector,
    VarianceThresholdSelectorModel,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.nulls import is_missing
from umbral.functions.selectors import all_nominal, all_numeric
from umbral.operators.columns import drop_cols, quoted
from umbral.sources.tables import learn_levels

BETWEEN = "_x_"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dummy_expressions(levels: dict[str, list[str]]) -> dict[str, str]:
    """``{factor_level: SQL}``; the first sorted level is the base and gets no column.

    A level never seen in training is 0 everywhere; a missing value stays missing.
    """
    return {
        f"{f}_{v}": f"CAST(CAST({_sql_name(f)} AS STRING) = {_sql_text(v)} AS DOUBLE)"
        for f, values in levels.items()
        for v in values[1:]
    }


def dummy(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Replace each factor by its indicator columns."""
    made = {n: F.expr(e) for n, e in dummy_expressions(levels).items()}
    return df.withColumns(made).drop(*levels)


def interaction_expressions(numeric: list[str], dummies: list[str]) -> dict[str, str]:
    """``{numeric_x_dummy: SQL}`` for every pair of a number and an indicator."""
    return {
        f"{n}{BETWEEN}{d}": f"CAST({_sql_name(n)} AS DOUBLE) * {_sql_name(d)}" for n in numeric for d in dummies
    }


def interact(df: DataFrame, numeric: list[str], dummies: list[str]) -> DataFrame:
    return df.withColumns({n: F.expr(e) for n, e in interaction_expressions(numeric, dummies).items()})


def zero_variance_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns with a single value, from one pass."""
    ends = df.agg(*[F.struct(F.min(quoted(n)), F.max(quoted(n))).alias(f"c{i}") for i, n in enumerate(names)])
    found = ends.first()
    return [n for i, n in enumerate(names) if found[i][0] == found[i][1] or found[i][0] is None]


def drop_zero_variance(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.drop(*zero_variance_columns(df, names or df.columns))


def learn_scale(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation per column, from one pass."""
    found = df.agg(*[F.struct(F.avg(quoted(n)), F.stddev_samp(quoted(n))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n: (found[i][0], found[i][1]) for i, n in enumerate(names)}


def normalize(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Centre and scale by learned values, whatever table they are applied to."""
    flat = [n for n, (_, s) in scale.items() if not s]
    if flat:
        raise ValueError(f"columns without spread cannot be scaled, drop them first: {flat}")
    return df.withColumns({n: (quoted(n) - F.lit(m)) / F.lit(s) for n, (m, s) in scale.items()})


def remove_terms(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop predictors by name; unknown names are ignored."""
    return drop_cols(df, names, strict=False)


class DesignVector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """One vector column from SQL arrays laid end to end; an entry that is missing is NaN."""

    terms = Param(Params._dummy(), "terms", "names of the entries", TypeConverters.toListString)
    blocks = Param(Params._dummy(), "blocks", "SQL arrays of doubles", TypeConverters.toListString)
    sources = Param(Params._dummy(), "sources", "columns the entries are made of", TypeConverters.toListString)
    output = Param(Params._dummy(), "output", "name of the vector column", TypeConverters.toString)

    def __init__(self, terms: list[str] = (), blocks: list[str] = (), sources: list[str] = (), output: str = "features"):
        super().__init__()
        self._set(terms=list(terms), blocks=list(blocks), sources=list(sources), output=output)

    def entries(self) -> Column:
        """All entries as one array."""
        return F.concat(*[F.expr(b) for b in self.getOrDefault(self.blocks)])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault(self.output), array_to_vector(self.entries()))

    def complete(self, df: DataFrame) -> Column:
        """True where every source column is known."""
        known = [~is_missing(df, c) for c in self.getOrDefault(self.sources)]
        return reduce(lambda a, b: a & b, known, F.lit(True))


def _known(expression: str) -> str:
    return f"coalesce({expression}, double('NaN'))"


def number_block(names: list[str]) -> str:
    return "array(" + ", ".join(_known(f"CAST({_sql_name(n)} AS DOUBLE)") for n in names) + ")"


def _at_level(factor: str, levels: list[str], here: str = "1D", elsewhere: str = "0D") -> str:
    """One entry for each level but the first: ``here`` at the row's level, ``elsewhere`` at all others.

    The entries are cut from a longer array at the place of the level, which takes no comparison for each entry.
    """
    texts, n = ", ".join(_sql_text(v) for v in levels[1:]), len(levels) - 1
    place = f"CAST(array_position(array({texts}), CAST({_sql_name(factor)} AS STRING)) AS INT)"
    side = f"array_repeat({elsewhere}, {n})"
    return f"coalesce(slice(concat({side}, array({here}), {side}), {n + 2} - {place}, {n}), array_repeat(double('NaN'), {n}))"


def dummy_block(factor: str, levels: list[str]) -> str:
    """Indicators of all levels but the first."""
    return _at_level(factor, levels)


def interaction_block(numbers: list[str], factor: str, levels: list[str]) -> str:
    """Every number times every indicator, number by number."""
    values = [_known(f"CAST({_sql_name(n)} AS DOUBLE)") for n in numbers]
    return "concat(" + ", ".join(_at_level(factor, levels, f"{v} * 1D", f"{v} * 0D") for v in values) + ")"


def complete_rows(prepared: PipelineModel, df: DataFrame) -> Column:
    """True where the prepared vector has no missing entry."""
    tests = [s.complete(df) for s in prepared.stages if isinstance(s, DesignVector)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class PcaThreshold(Estimator):
    """Principal components, kept up to the fewest that explain ``threshold`` of the variance."""

    def __init__(self, inputCol: str, outputCol: str, threshold: float = 0.8):
        super().__init__()
        self.inputCol, self.outputCol, self.threshold = inputCol, outputCol, threshold

    def _fit(self, df: DataFrame) -> PipelineModel:
        width = len(df.select(self.inputCol).first()[0])
        full = PCA(k=width, inputCol=self.inputCol, outputCol=f"{self.outputCol}_all").fit(df)
        reached, kept = 0.0, 0
        for share in full.explainedVariance.toArray():
            reached, kept = reached + share, kept + 1
            if reached >= self.threshold - 1e-12:
                break
        cut = VectorSlicer(inputCol=f"{self.outputCol}_all", outputCol=self.outputCol, indices=list(range(kept)))
        return PipelineModel([full, cut])


class Recipe(Estimator):
    """Declared preparation: dummies, interactions, removed terms, zero variance, scaling, PCA.

    Without ``numeric`` and ``factors`` every number and text column that has no other
    role is a predictor. Incomplete rows are not learned from.
    """

    def __init__(
        self,
        label: str | None = None,
        not_predictors: tuple[str, ...] = ("id",),
        numeric: list[str] | None = None,
        factors: list[str] | None = None,
        interact_numeric: tuple[str, ...] = (),
        interact_factor: str | None = None,
        removed: tuple[str, ...] = (),
        scale: bool = True,
        pca_threshold: float | None = None,
        output: str = "features",
    ):
        super().__init__()
        self.label, self.not_predictors = label, tuple(not_predictors)
        self.numeric, self.factors = numeric, factors
        self.interact_numeric, self.interact_factor = tuple(interact_numeric), interact_factor
        self.removed, self.scale, self.pca_threshold = set(removed), scale, pca_threshold
        self.output = output

    def design(self, df: DataFrame, output: str) -> DesignVector:
        """The vector's entries, with factor levels learned from ``df``."""
        out = [*self.not_predictors, *([self.label] if self.label else [])]
        numeric = list(self.numeric) if self.numeric is not None else all_numeric(df, out)
        factors = list(self.factors) if self.factors is not None else all_nominal(df, out)
        levels = {f: v for f, v in learn_levels(df, factors).items() if len(v) > 1}
        terms = [*numeric, *dummy_expressions(levels)]
        blocks = [number_block(numeric)] if numeric else []
        blocks += [dummy_block(f, v) for f, v in levels.items()]
        crossed = list(self.interact_numeric) if self.interact_factor in levels else []
        if crossed:
            own = levels[self.interact_factor]
            terms += interaction_expressions(crossed, list(dummy_expressions({self.interact_factor: own})))
            blocks.append(interaction_block(crossed, self.interact_factor, own))
        return DesignVector(terms, blocks, list(dict.fromkeys([*numeric, *factors, *crossed])), output)

    def columns(self, df: DataFrame) -> tuple[list[Transformer], str]:
        """The stages that make the vector of all terms that are not removed, and its name; only factor levels are learned."""
        raw = f"{self.output}_raw"
        design = self.design(df, raw)
        terms = design.getOrDefault(design.terms)
        kept = [i for i, t in enumerate(terms) if t not in self.removed]
        if not kept:
            raise ValueError("no predictor is left")
        if len(kept) == len(terms):
            return [design], raw
        return [design, VectorSlicer(inputCol=raw, outputCol=f"{raw}_kept", indices=kept)], f"{raw}_kept"

    def _fit(self, df: DataFrame) -> PipelineModel:
        varied = f"{self.output}_varied"
        made, last = self.columns(df)
        rows = PipelineModel(made).transform(df.filter(made[0].complete(df))).select(last)
        tail = [VarianceThresholdSelector(varianceThreshold=0.0, featuresCol=last, outputCol=varied)]
        if self.scale:
            last = f"{self.output}_scaled" if self.pca_threshold else self.output
            tail.append(StandardScaler(withMean=True, withStd=True, inputCol=varied, outputCol=last))
        if self.pca_threshold:
            tail.append(PcaThreshold(last if self.scale else varied, self.output, self.pca_threshold))
        if len(tail) == 1:
            tail[0].setOutputCol(self.output)
        return PipelineModel([*made, *_flatten(Pipeline(stages=tail).fit(rows).stages)])


def _flatten(stages: list) -> list:
    return [x for s in stages for x in (_flatten(s.stages) if isinstance(s, PipelineModel) else [s])]


def prep(recipe: Recipe, train: DataFrame) -> PipelineModel:
    return recipe.fit(train)


def bake(prepared: PipelineModel, df: DataFrame, keep: list[str] | None = None, output: str = "features") -> DataFrame:
    """Apply learned preparation to the complete rows; keep the given columns and the vector."""
    keep = [c for c in (keep if keep is not None else df.columns) if c in df.columns]
    made = prepared.transform(df.filter(complete_rows(prepared, df)))
    return made.select(*[quoted(c) for c in keep], output)


def feature_names(prepared: PipelineModel) -> list[str]:
    """Names of the vector's entries: columns that vary, or ``PC1..`` after PCA."""
    names: list[str] = []
    for stage in prepared.stages:
        if isinstance(stage, DesignVector):
            names = stage.getOrDefault(stage.terms)
        elif isinstance(stage, VarianceThresholdSelectorModel):
            names = [names[i] for i in stage.selectedFeatures]
        elif isinstance(stage, PCAModel):
            names = [f"PC{i + 1}" for i in range(stage.getK())]
        elif isinstance(stage, VectorSlicer):
            names = [names[i] for i in stage.getIndices()]
    return names


def design_matrix(df: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    """All named columns of the complete rows as one numeric vector, no intercept column."""
    design = DesignVector(names, [number_block(names)], names, output)
    return design.transform(df.filter(design.complete(df)))


def workflow(recipe: Recipe, model: Estimator) -> Pipeline:
    """Preparation and model as one unit that is tuned, fitted and applied."""
    return Pipeline(stages=[recipe, model])
