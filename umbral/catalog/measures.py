"""Aggregates, profiles and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.catalog.registry import query, r6, rounded
from umbral.functions import nulls as N
from umbral.functions import recode as R
from umbral.functions import selectors as X
from umbral.operators import aggregates as A
from umbral.operators import profile as Q
from umbral.plans.households import BONUS_AMOUNTS, EDUCATION
from umbral.sources.views import hogares, personas, view_sql

P, H, PH = view_sql("personas"), view_sql("hogares"), view_sql("personas", "hogares")


@query(P + "SELECT COUNT(*) AS n FROM personas WHERE P6545 = 1 AND P6545s1 = 0")
def count_where(spark: SparkSession, sf: str) -> DataFrame:
    return A.count_where(personas(spark, sf), (F.col("P6545") == 1) & (F.col("P6545s1") == 0), "n")


@query(P + "SELECT id, COALESCE(SUM(Oc), 0)::BIGINT AS n_oc, COALESCE(SUM(Ina), 0)::BIGINT AS n_ina FROM personas GROUP BY id")
def group_sum(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_sum(personas(spark, sf), "id", {"Oc": "n_oc", "Ina": "n_ina"})


@query(P + "SELECT id, round(COALESCE(SUM(Oc), 0)::DOUBLE / COUNT(*), 6) AS rate_oc FROM personas GROUP BY id")
def group_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.group_rate(personas(spark, sf), "id", {"Oc": "rate_oc"}), "rate_oc")


@query(
    P + "SELECT id, CASE WHEN COALESCE(SUM(Oc), 0) > 0 THEN 1 ELSE 0 END AS any_oc, "
    "CASE WHEN COALESCE(SUM(Des), 0) > 0 THEN 1 ELSE 0 END AS any_des FROM personas GROUP BY id"
)
def group_any(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_any(personas(spark, sf), "id", {"Oc": "any_oc", "Des": "any_des"})


@query(P + "SELECT id, COUNT(*) AS members FROM personas GROUP BY id")
def group_size(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_size(personas(spark, sf), "id", "members")


@query(P + "SELECT id, round(AVG(P6040), 6) AS age FROM personas GROUP BY id")
def group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.group_mean(personas(spark, sf), "id", "P6040", "age"), "age")


@query(P + "SELECT id, round(AVG(P6040) FILTER (WHERE Pet = 1), 6) AS age_pet FROM personas GROUP BY id")
def group_mean_if(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.group_mean_if(personas(spark, sf), "id", "P6040", F.col("Pet") == 1, "age_pet"), "age_pet")


_PROFILED = ["P6090", "P6210", "P6545", "P6545s1", "P6580", "P7495", "Pet", "Oc", "Des", "Ina"]


def _profile_sql(where: str = "TRUE", percent: str = "percent") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
        f"round(100.0 * COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 6)::DOUBLE AS {percent} FROM personas WHERE {where}"
        for c in _PROFILED
    )


@query(P + _profile_sql())
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.null_profile(personas(spark, sf).select(*_PROFILED)), "percent")


@query(P + _profile_sql("P6050 = 1"))
def null_profile_where(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.null_profile_where(personas(spark, sf), F.col("P6050") == 1, _PROFILED), "percent")


@query(
    P + f"SELECT a.name, a.percent_train, b.percent_test FROM ({_profile_sql('train = 1', 'percent_train')}) a "
    f"LEFT JOIN ({_profile_sql('train = 0', 'percent_test')}) b ON a.name = b.name"
)
def null_profile_compare(spark: SparkSession, sf: str) -> DataFrame:
    every = personas(spark, sf).select("train", *_PROFILED)
    out = Q.null_profile_compare(every.filter("train = 1").drop("train"), every.filter("train = 0").drop("train"))
    return rounded(out, "percent_train", "percent_test")


@query(P + "SELECT id, Orden, " + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _PROFILED) + " AS n_missing FROM personas")
def null_per_row(spark: SparkSession, sf: str) -> DataFrame:
    return Q.null_count_per_row(personas(spark, sf), _PROFILED).select("id", "Orden", "n_missing")


@query(P + "SELECT P6090 AS value, COUNT(*) AS n FROM personas WHERE P6090 IS NOT NULL GROUP BY P6090")
def freq_table(spark: SparkSession, sf: str) -> DataFrame:
    return Q.freq_table(personas(spark, sf), "P6090")


_SUMMED = ["P5130", "P5140", "Ingpcug", "Npersug"]


@query(
    H + " UNION ALL ".join(
        f"SELECT '{c}' AS name, MIN({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, "
        f"round(AVG({c}), 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, MAX({c})::DOUBLE AS max, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL) AS missing FROM hogares"
        for c in _SUMMED
    )
)
def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.column_summary(hogares(spark, sf).select(*_SUMMED)), "q1", "median", "mean", "q3")


@query(
    H + "SELECT 'Depto' AS name, Depto AS level, COUNT(*) AS n FROM hogares GROUP BY Depto UNION ALL "
    "SELECT 'P5090', CAST(P5090 AS VARCHAR), COUNT(*) FROM hogares GROUP BY P5090"
)
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.level_counts(hogares(spark, sf), ["Depto", "P5090"])


@query(
    P + " UNION ALL ".join(
        f"SELECT '{f} no with amount' AS rule, COUNT(*) FILTER (WHERE {f} = 2 AND {a} <> 0) AS violations FROM personas "
        f"UNION ALL SELECT '{f} missing with amount', COUNT(*) FILTER (WHERE {f} IS NULL AND {a} <> 0) FROM personas"
        for f, a in BONUS_AMOUNTS.items()
    )
)
def consistency_report(spark: SparkSession, sf: str) -> DataFrame:
    rules = {}
    for f, a in BONUS_AMOUNTS.items():
        rules[f"{f} no with amount"] = (F.col(f) == 2) & (F.col(a) != 0)
        rules[f"{f} missing with amount"] = F.col(f).isNull() & (F.col(a) != 0)
    return Q.consistency_report(personas(spark, sf), rules)


@query(
    P + "SELECT id, Orden, CASE WHEN P6090 IS NULL THEN NULL WHEN P6090 = 9 THEN 2 ELSE P6090 END AS P6090, "
    "CASE WHEN P6920 IS NULL THEN NULL WHEN P6920 = 3 THEN 1 ELSE 0 END AS pensionado FROM personas"
)
def r_ifelse(spark: SparkSession, sf: str) -> DataFrame:
    return personas(spark, sf).select(
        "id", "Orden",
        N.r_ifelse(F.col("P6090") == 9, 2, F.col("P6090")).alias("P6090"),
        N.r_ifelse(F.col("P6920") == 3, 1, 0).alias("pensionado"),
    )


@query(P + "SELECT id, Orden, CASE P6090 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS tiene_salud, CASE P6920 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS cotiza FROM personas")
def recode_map(spark: SparkSession, sf: str) -> DataFrame:
    return personas(spark, sf).select(
        "id", "Orden",
        R.recode(F.col("P6090"), {1: 1, 2: 0}).alias("tiene_salud"),
        R.recode(F.col("P6920"), {1: 1, 2: 0}).alias("cotiza"),
    )


@query(P + "SELECT id, Orden, " + ", ".join(f"CASE WHEN {c} IN (2, 9) THEN 0 ELSE {c} END AS {c}" for c in BONUS_AMOUNTS) + " FROM personas")
def yes_no_family(spark: SparkSession, sf: str) -> DataFrame:
    return R.yes_no_family(personas(spark, sf).select("id", "Orden", *BONUS_AMOUNTS), list(BONUS_AMOUNTS))


@query(
    P + "SELECT id, Orden, CASE WHEN train = 0 THEN P6545 WHEN P6545s1 IS NULL THEN NULL WHEN P6545s1 = 0 THEN 2 ELSE P6545 END AS P6545 FROM personas"
)
def zero_amount_no(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = R.zero_amount_means_no(F.col("P6545"), F.col("P6545s1"), F.col("train") == 1)
    return personas(spark, sf).select("id", "Orden", cleaned.alias("P6545"))


@query(
    P + "SELECT id, Orden, CASE P6210 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EDUCATION.items()) + " END AS nivel FROM personas"
)
def factor_labels(spark: SparkSession, sf: str) -> DataFrame:
    return personas(spark, sf).select("id", "Orden", R.to_factor(F.col("P6210"), EDUCATION).alias("nivel"))


@query(
    H + "SELECT id, CAST(P5090 AS VARCHAR) AS P5090, CAST(id AS VARCHAR) AS id_text, TRY_CAST(substr(Dominio, 8) AS DOUBLE) AS number, "
    "TRY_CAST(Depto AS DOUBLE) AS no_number FROM hogares"
)
def casts(spark: SparkSession, sf: str) -> DataFrame:
    return hogares(spark, sf).select(
        "id",
        R.as_factor(F.col("P5090")).alias("P5090"),
        R.as_character(F.col("id")).alias("id_text"),
        R.as_numeric(F.expr("substring(Dominio, 8)")).alias("number"),
        R.as_numeric(F.col("Depto")).alias("no_number"),
    )


@query(
    H + "SELECT 'starts_with' AS selector, 'P5000' AS name, COUNT(P5000) AS present FROM hogares UNION ALL "
    "SELECT 'starts_with', 'P5090', COUNT(P5090) FROM hogares UNION ALL SELECT 'starts_with', 'P5130', COUNT(P5130) FROM hogares UNION ALL "
    "SELECT 'starts_with', 'P5140', COUNT(P5140) FROM hogares UNION ALL SELECT 'nominal', 'Dominio', COUNT(Dominio) FROM hogares UNION ALL "
    "SELECT 'nominal', 'Depto', COUNT(Depto) FROM hogares UNION ALL SELECT 'numeric', 'Lp', COUNT(Lp) FROM hogares UNION ALL "
    "SELECT 'predictor', 'Npersug', COUNT(Npersug) FROM hogares"
)
def selectors(spark: SparkSession, sf: str) -> DataFrame:
    """Columns each selector picks, with their non-missing rows."""
    df = hogares(spark, sf).select("id", "Dominio", "Depto", "P5000", "P5090", "P5130", "P5140", "Lp", "Npersug", "Pobre")
    picked = [("starts_with", c) for c in X.starts_with(df, "P5")]
    picked += [("nominal", c) for c in X.all_nominal(df)]
    picked += [("numeric", c) for c in X.all_numeric(df.select("Dominio", "Lp"))]
    roles = {"id": "id", "Pobre": "outcome", "Lp": "line"}
    picked += [("predictor", c) for c in X.all_predictors(df.select("id", "Pobre", "Lp", "Npersug"), roles)]
    names = list(dict.fromkeys(c for _, c in picked))
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    rows = [F.struct(F.lit(s).alias("selector"), F.lit(c).alias("name"), F.col(c).alias("present")) for s, c in picked]
    return counts.select(F.inline(F.array(*rows)))


@query(H + "SELECT id, CASE WHEN Pobre = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS label, CASE WHEN Pobre = 1 THEN 'si' ELSE 'no' END AS name FROM hogares")
def relevel(spark: SparkSession, sf: str) -> DataFrame:
    labelled = hogares(spark, sf).select("id", R.event_label(F.col("Pobre"), 1).alias("label"))
    return labelled.withColumn("name", R.event_name(F.col("label")))


@query(
    H + "SELECT id, round(CASE WHEN Ingpcug > 0 THEN ln(Ingpcug) ELSE 0 END, 6) AS log_income, "
    "round(exp(CASE WHEN Ingpcug > 0 THEN ln(Ingpcug) ELSE 0 END), 4) AS income FROM hogares"
)
def safe_log_exp(spark: SparkSession, sf: str) -> DataFrame:
    logged = hogares(spark, sf).select("id", N.safe_log(F.col("Ingpcug")).alias("log_income"))
    return logged.select("id", r6("log_income").alias("log_income"), r6(F.exp("log_income"), 4).alias("income"))


@query(
    H + "SELECT id, Nper - Npersug AS DiffNper, Nper + Npersug AS total, round(CASE WHEN Nper - Npersug = 0 THEN NULL ELSE P5130 / (Nper - Npersug) END, 6) AS ratio, "
    "(Nper > Npersug AND P5130 >= 100) OR NOT (P5000 = 1) AS flag FROM hogares"
)
def arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    more, rent = F.col("Nper") - F.col("Npersug"), F.col("P5130")
    return hogares(spark, sf).select(
        "id",
        more.alias("DiffNper"),
        (F.col("Nper") + F.col("Npersug")).alias("total"),
        r6(N.safe_divide(rent, more)).alias("ratio"),
        (((F.col("Nper") > F.col("Npersug")) & (rent >= 100)) | ~(F.col("P5000") == 1)).alias("flag"),
    )


@query(H + "SELECT id, P5140 IS NULL OR P5000 = 2 AS missing FROM hogares")
def is_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Null and NaN count alike."""
    holed = hogares(spark, sf).withColumn("P5140", F.when(F.col("P5000") == 2, F.lit(float("nan"))).otherwise(F.col("P5140")))
    return holed.select("id", N.is_missing(holed, "P5140").alias("missing"))


@query(P + "SELECT id, Orden, COALESCE(Pet, 0) AS Pet, COALESCE(Oc, 0) AS Oc, COALESCE(P6545s1, -1)::DOUBLE AS P6545s1 FROM personas")
def replace_na(spark: SparkSession, sf: str) -> DataFrame:
    return N.replace_na(personas(spark, sf).select("id", "Orden", "Pet", "Oc", "P6545s1"), {"Pet": 0, "Oc": 0, "P6545s1": -1.0})


@query(P + "SELECT id, Orden, P6090, P6545s1 FROM personas WHERE P6090 IS NOT NULL AND P6545s1 IS NOT NULL")
def drop_na(spark: SparkSession, sf: str) -> DataFrame:
    return N.drop_na(personas(spark, sf).select("id", "Orden", "P6090", "P6545s1"))


@query(H + "SELECT id, CASE Depto WHEN 'AFRICA' THEN 'Africa' WHEN 'ASIA' THEN 'Asia' ELSE Depto END AS Depto FROM hogares")
def rename_values(spark: SparkSession, sf: str) -> DataFrame:
    return hogares(spark, sf).select("id", R.rename_values(F.col("Depto"), {"AFRICA": "Africa", "ASIA": "Asia"}).alias("Depto"))
