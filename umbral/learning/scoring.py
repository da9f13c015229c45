"""From scores to the submitted ``(id, pobre)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.nulls import r_ifelse


def _flag(condition: Column, missing_as: int | None) -> Column:
    flag = r_ifelse(condition, 1, 0)
    return (flag if missing_as is None else F.coalesce(flag, F.lit(missing_as))).cast("int")


def _known(column: Column) -> Column:
    return F.nullif(column.cast("double"), F.lit(float("nan")))


def score_income(df: DataFrame, prediction: str, line: str = "Lp", missing_as: int | None = 0) -> DataFrame:
    """Poor if the income behind a predicted log income is at or below the line."""
    poor = F.exp(_known(F.col(prediction))) <= F.col(line)
    return df.select("id", _flag(poor, missing_as).alias("pobre"))


def score_threshold(df: DataFrame, score: str, cutoff: float, missing_as: int | None = 0) -> DataFrame:
    """Poor if the score reaches the cut-off."""
    return df.select("id", _flag(_known(F.col(score)) >= cutoff, missing_as).alias("pobre"))
