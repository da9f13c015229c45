"""Regression and class metrics, ROC curve, cut-off and term tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.nulls import safe_divide
from umbral.functions.recode import rename_values
from umbral.operators.columns import pull_column
from umbral.operators.running import RANGE, place, running_totals
from umbral.operators.windows import top_k

LOG_FLOOR = 1e-15

# Readable names of the strongest variables.
READABLE = {
    "pensionados": "Pensionados",
    "P5130": "Estimación arriendo",
    "prop_pet": "Propor. PET",
    "Npersug": "Npersug",
    "Educ_avg": "Educ_avg",
    "tasa_ocupados": "Tasa ocupados",
    "tamano_empresa": "Tamaño empresa",
    "pensiones": "Pensiones",
    "horas_trabajadas": "Horas trabajadas",
    "prima_servicios": "Prima_servicios",
    "edad_pet": "Edad_PET",
    "P5140": "Valor arriendo",
    "tasa_inactivos": "Tasa inactivos",
    "P5090_5": "Vivienda_es",
    "remesas_internas": "Remesas_internas",
    "ayuda_instituciones": "Aux_instituciones",
    "P5000": "Número cuartos",
    "Educ_jefe": "Educ_jefe",
    "ingresos_trabajo": "Ingresos_trabajo",
    "Dominio_RURAL": "Dominio:RURAL",
}


def rmse(label: Column, prediction: Column) -> Column:
    return F.sqrt(mse(label, prediction))


def mse(label: Column, prediction: Column) -> Column:
    return F.avg(F.pow(label - prediction, F.lit(2.0)))


def mae(label: Column, prediction: Column) -> Column:
    return F.avg(F.abs(label - prediction))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with rmse, mae and mse from one pass."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), mse(y, p).alias("mse"))


def _cells(event: Column, called: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(event & called),
        "fp": F.count_if(~event & called),
        "fn": F.count_if(event & ~called),
        "tn": F.count_if(~event & ~called),
    }


def precision(event: Column, called: Column) -> Column:
    n = _cells(event, called)
    return safe_divide(n["tp"], n["tp"] + n["fp"])


def recall(event: Column, called: Column) -> Column:
    n = _cells(event, called)
    return safe_divide(n["tp"], n["tp"] + n["fn"])


def specificity(event: Column, called: Column) -> Column:
    n = _cells(event, called)
    return safe_divide(n["tn"], n["tn"] + n["fp"])


def accuracy(event: Column, called: Column) -> Column:
    return F.avg((event == called).cast("double"))


def f_measure(event: Column, called: Column) -> Column:
    """Harmonic mean of precision and recall of the event class."""
    n = _cells(event, called)
    return safe_divide(2 * n["tp"], 2 * n["tp"] + n["fp"] + n["fn"])


def log_loss(event: Column, probability: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(LOG_FLOOR)), F.lit(1 - LOG_FLOOR))
    return -F.avg(F.when(event, F.log(p)).when(~event, F.log1p(-p)))


def f1(df: DataFrame, label: str, prediction: str, event=1) -> DataFrame:
    return df.agg(f_measure(F.col(label) == event, F.col(prediction) == event).alias("f_meas"))


def scored(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows with a label and a score; a score that is not a number counts as missing (it would compare above every cut-off)."""
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def class_metrics(df: DataFrame, label: str, probability: str, cutoff: float = 0.5) -> DataFrame:
    """One row: accuracy, precision, recall, specificity, F, log loss and AUC, all over rows with a label and a score."""
    df = scored(df, label, probability)
    event, called = F.col(label) == 1, F.col(probability) >= cutoff
    shares = df.agg(
        accuracy(event, called).alias("accuracy"),
        precision(event, called).alias("precision"),
        recall(event, called).alias("recall"),
        specificity(event, called).alias("specificity"),
        f_measure(event, called).alias("f_meas"),
        log_loss(event, F.col(probability)).alias("log_loss"),
    )
    return shares.withColumn("auc", auc(df, label, probability).scalar())


def _points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Events and others per distinct score, with running totals from the highest score down.

    Counting per score is the only shuffle of the whole table; it combines map-side.
    """
    known = scored(df, label, score).select(F.col(score).cast("double").alias("score"), F.col(label).alias("label"))
    at = f"{RANGE}_score"
    counts = place(known, ["score"]).groupBy("score", at).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return running_totals(counts, "score", ["pos", "neg"], descending=True, neighbour="next_score", at=at)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sensitivity and specificity of "call it an event from this score up", per distinct score.

    ``threshold`` lies midway to the next lower score (−infinity below the lowest).
    """
    midway = (F.col("score") + F.col("next_score")) / 2
    return _points(df, label, score).select(
        "score",
        F.coalesce(midway, F.lit(float("-inf"))).alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        safe_divide(F.col("cum_pos"), F.col("all_pos")).alias("sensitivity"),
        (1 - safe_divide(F.col("cum_neg"), F.col("all_neg"))).alias("specificity"),
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; equals the share of well-ordered pairs."""
    p = _points(df, label, score)
    strip = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return p.agg(safe_divide(F.sum(strip), F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("auc"))


def auc_by(df: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """``(by, auc)``: the area for every value of a column (a few: candidates, folds), from one set of counts."""
    known = scored(df, label, score).select(F.col(by), F.col(score).cast("double").alias("score"), F.col(label).alias("label"))
    at = f"{RANGE}_score"
    counts = place(known, ["score"]).groupBy(by, "score", at).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    p = running_totals(counts, "score", ["pos", "neg"], by=by, descending=True, at=at)
    strip = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return p.groupBy(by).agg(safe_divide(F.sum(strip), F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("auc"))


def roc_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The curve's point closest to the top-left corner; ties go to the lowest cut-off."""
    gap = F.pow(1 - F.col("sensitivity"), F.lit(2.0)) + F.pow(1 - F.col("specificity"), F.lit(2.0))
    curve = roc_curve(df, label, score).withColumn("distance", gap)
    return curve.orderBy(F.col("distance").asc_nulls_last(), F.col("threshold").asc()).limit(1)


def operating_point(df: DataFrame, label: str, score: str, cutoffs: float | list[float]) -> DataFrame:
    """True and false positive and true negative rate per cut-off; all cut-offs in one pass over rows with a label and a score."""
    df = scored(df, label, score)
    cutoffs = cutoffs if isinstance(cutoffs, list) else [cutoffs]
    event = F.col(label) == 1
    parts = []
    for i, c in enumerate(cutoffs):
        called = F.col(score) > c
        parts += [recall(event, called).alias(f"t{i}"), specificity(event, called).alias(f"n{i}")]
    rows = [
        F.struct(
            F.lit(float(c)).alias("threshold"),
            F.col(f"t{i}").alias("tpr"),
            (1 - F.col(f"n{i}")).alias("fpr"),
            F.col(f"n{i}").alias("tnr"),
        )
        for i, c in enumerate(cutoffs)
    ]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("real"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def coefficients(spark, names: list[str], model) -> DataFrame:
    """``(term, estimate)`` of a fitted linear model, intercept first."""
    rows = [("(Intercept)", float(model.intercept))]
    rows += [(n, float(b)) for n, b in zip(names, model.coefficients.toArray(), strict=True)]
    return spark.createDataFrame(rows, "term string, estimate double")


def selected_terms(terms: DataFrame, kept: bool) -> DataFrame:
    """Terms a penalised fit kept (estimate not 0) or dropped (estimate 0)."""
    return terms.filter(F.col("estimate") != 0 if kept else F.col("estimate") == 0)


def dropped_names(terms: DataFrame) -> list[str]:
    return pull_column(selected_terms(terms, kept=False), "term")


def importance(spark, names: list[str], model, readable: dict[str, str] = READABLE, k: int = 20) -> DataFrame:
    """Impurity importance of the ``k`` strongest variables, under readable names."""
    values = model.featureImportances.toArray()
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values, strict=True)], "Variable string, Importance double"
    )
    best = top_k(table, "Importance", k, ties=["Variable"])
    return best.withColumn("Variable", rename_values(F.col("Variable"), readable)) if readable else best
