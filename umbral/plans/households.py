"""Person to household pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.nulls import drop_na, in_set, r_ifelse, replace_na, safe_divide, safe_log
from umbral.functions.recode import as_character, as_factor, recode, to_factor, yes_no, yes_no_family, zero_amount_means_no
from umbral.operators.aggregates import any_flag, mean_where, sum_or_zero
from umbral.operators.columns import align_columns, drop_cols, mutate_across, quoted, select_all_of, tag
from umbral.operators.joins import assemble_packs, left_join_key, left_join_project, right_join
from umbral.operators.windows import LARGEST_CODE, code_set, explode_codes, rollup_distinct, union_by_name

# Survey codes and their labels.
TENURE = {
    1: "Propia, pagada",
    2: "Propia, pagando",
    3: "Arriendo/subarriendo",
    4: "Usufructo",
    5: "Posesión sin título",
    6: "Otra",
}
EDUCATION = {1: "Ninguno", 2: "Preescolar", 3: "Primaria", 4: "Secundaria", 5: "Media", 6: "Superior"}
OUTSIDE_SPENDING_UNIT = (6, 7, 8, 9)
SERVICE_WORKERS = (6, 8)
ACTIVITY = ("Pet", "Oc", "Des", "Ina")
OTHER_INCOME = ("P7495", "P7500s2", "P7500s3", "P7505", "P7510s1", "P7510s2", "P7510s3", "P7510s5", "P7510s6", "P7510s7")
BONUS_AMOUNTS = {
    "P6545": "P6545s1",
    "P6580": "P6580s1",
    "P6585s1": "P6585s1a1",
    "P6585s2": "P6585s2a1",
    "P6585s3": "P6585s3a1",
    "P6585s4": "P6585s4a1",
}
BONUS_COUNTS = {
    "P6545": "Nprimas",
    "P6580": "Nbonos",
    "P6585s1": "NauxAli",
    "P6585s2": "NauxTra",
    "P6585s3": "NauxFam",
    "P6585s4": "NauxEdu",
}
WEIGHTS = ("Fex_dpto", "Fex_c", "Li", "Nper")
FACTORS = ("P5090", "Dominio", "Depto")
TEST_FILLS = {"edad_pet": 0, "tasa_ocupados": 0, "tasa_inactivos": 0}


def build_survey(persons_train: DataFrame, households_train: DataFrame, persons_test: DataFrame, households_test: DataFrame) -> DataFrame:
    """Join each pair on ``id``, tag the origin, give test the columns it lacks, and stack."""
    train = tag(left_join_key(persons_train, households_train, ["id"]), "train", 1)
    test = tag(left_join_key(persons_test, households_test, ["id"]), "train", 0)
    return union_by_name(train, align_columns(test, train))


def education_level(code: Column) -> Column:
    """The unlisted answer 9 counts as the lowest level."""
    return r_ifelse(code == 9, 1, code)


def person_status_vars(df: DataFrame) -> DataFrame:
    """Tenure, health cover, pension and education of each person."""
    return df.withColumns(
        {
            "vivienda": to_factor(F.col("P5090"), TENURE),
            "tiene_salud": recode(F.col("P6090"), {1: 1, 2: 0}),
            "pensionado": r_ifelse(F.col("P6920") == 3, 1, 0),
            "cotiza_pension": recode(F.col("P6920"), {1: 1, 2: 0}),
            "nivel_educ": education_level(F.col("P6210")),
            "nivel_educ_nombre": to_factor(education_level(F.col("P6210")), EDUCATION),
        }
    )


def clean_bonus_answers(df: DataFrame) -> DataFrame:
    """Fill activity flags; amount 0 means no (train rows); yes/no codes to 0/1."""
    df = replace_na(df, dict.fromkeys(ACTIVITY, 0))
    stated = {f: zero_amount_means_no(F.col(f), F.col(a), F.col("train") == 1) for f, a in BONUS_AMOUNTS.items()}
    return yes_no_family(df.withColumns(stated), list(BONUS_AMOUNTS))


def clean_job_bonuses(df: DataFrame) -> DataFrame:
    """Cleaned answers of the joined survey, and the size difference."""
    return clean_bonus_answers(df).withColumn("DiffNper", F.col("Nper") - F.col("Npersug"))


def urban_flag(column: Column) -> Column:
    """Class 2 (rural) becomes 0, the municipal seat stays 1."""
    return r_ifelse(column == 2, 0, column)


def job_bonus_rollup(people: DataFrame, households: DataFrame, clase: str = "Clase") -> DataFrame:
    """Counts of job bonuses and their rates per head, one row per household (and ``train``, class).

    ``people`` are cleaned answers with ``nivel_educ``; they are added up by household before the sizes are joined, so no person row is.
    """
    counts = {out: sum_or_zero(F.col(c)) for c, out in BONUS_COUNTS.items()}
    rolled = rollup_distinct(people, "id", {**counts, "Educ_avg": sum_or_zero(F.col("nivel_educ"))}, codes=["train", clase])
    sizes = households.groupBy("id").agg(F.max("Npersug").alias("__size"))
    rolled = rolled.withColumnRenamed(clase, "Cabecera").join(sizes, "id", "left")
    rates = {f"{out}PP": safe_divide(F.col(out), F.col("__size")) for out in BONUS_COUNTS.values()}
    rates["Educ_avg"] = safe_divide(F.col("Educ_avg"), F.col("__size"))
    out = rolled.withColumns({**rates, "Cabecera": urban_flag(F.col("Cabecera"))})
    return out.select("id", "train", "Cabecera", *BONUS_COUNTS.values(), *[f"{o}PP" for o in BONUS_COUNTS.values()], "Educ_avg")


def head_of_household(df: DataFrame, names: list[str]) -> DataFrame:
    return select_all_of(df.filter(F.col("P6050") == 1), names)


def attach_head_education(rollup: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per head: a household without one is lost, with two it appears twice."""
    return right_join(rollup, heads, ["id"])


def in_spending_unit(relation: str = "P6050") -> Column:
    """Relations 6 to 9 are outside; a missing relation is inside."""
    return ~in_set(F.col(relation), OUTSIDE_SPENDING_UNIT)


def spending_unit(df: DataFrame) -> DataFrame:
    """Number of members of each household's spending unit."""
    return df.filter(in_spending_unit()).groupBy("id").agg(F.count(F.lit(1)).alias("size_unidad_gasto"))


def _service(column: Column) -> Column:
    return F.sum(F.when(in_set(column, SERVICE_WORKERS), 1).otherwise(0))


def service_workers(df: DataFrame) -> DataFrame:
    """Domestic staff and their kin per household, over all its persons."""
    return df.groupBy("id").agg(_service(F.col("P6050")).alias("servicio_trabajadores"))


def _transfers(member: Column, size: Column) -> dict[str, Column]:
    total = lambda c: sum_or_zero(F.when(member, F.col(c)))
    has = lambda c: any_flag(F.when(member, F.col(c)))
    rate = lambda c: safe_divide(total(c), size)
    return {
        "pensiones": has("P7500s2"),
        "pension_alimenticia": has("P7500s3"),
        "remesas_internas": rate("P7510s1"),
        "remesas_externas": rate("P7510s2"),
        "ayuda_instituciones": rate("P7510s3"),
        "inversiones": rate("P7510s5"),
        "cesantias": has("P7510s6"),
        "otros_ingresos": has("P7510s7"),
    }


def transfers_rollup(df: DataFrame) -> DataFrame:
    """Pensions, remittances, aid and other income of a table of spending-unit members."""
    found = _transfers(F.lit(True), F.count(F.lit(1)))
    return df.groupBy("id").agg(*[e.alias(n) for n, e in found.items()])


def _labour(member: Column) -> dict[str, Column]:
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ACTIVITY}
    of_age = member & (filled["Pet"] == 1)
    return {
        "prop_pet": mean_where(filled["Pet"], member),
        "edad_pet": mean_where(F.col("P6040"), of_age),
        "tasa_ocupados": mean_where(filled["Oc"], of_age),
        "tasa_inactivos": mean_where(filled["Ina"], of_age),
    }


def labour_rollup(df: DataFrame) -> DataFrame:
    """Working-age share, mean age, employment and inactivity of a table of members."""
    return df.groupBy("id").agg(*[e.alias(n) for n, e in _labour(F.lit(True)).items()])


PACK_MEASURES = (
    "pensiones", "pension_alimenticia", "remesas_internas", "remesas_externas", "ayuda_instituciones", "inversiones", "cesantias", "otros_ingresos",
    "prop_pet", "edad_pet", "tasa_ocupados", "tasa_inactivos", "servicio_trabajadores",
)


def household_measures(df: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per household from one aggregate and one shuffle: the pack's measures, and ``more`` aggregates over all its persons.

    Conditions inside the aggregates stand for the spending-unit filter, so the persons are read once and nothing is joined. ``__bits`` holds the classes of
    the members; it is missing where nobody is in the spending unit.
    """
    answers = [*OTHER_INCOME, *ACTIVITY]
    people = mutate_across(df, answers, yes_no).withColumn("__member", in_spending_unit())
    member = F.col("__member")
    measures = {**_transfers(member, F.count_if(member)), **_labour(member), "servicio_trabajadores": _service(F.col("P6050"))}
    every = {**measures, **(more or {})}
    return people.groupBy("id").agg(code_set(F.col("Clase"), where=member).alias("__bits"), *[e.alias(n) for n, e in every.items()])


def household_pack(df: DataFrame) -> DataFrame:
    """Other income, labour and service workers per household and class. Households with nobody in the spending unit are left out."""
    rolled = household_measures(df).filter(F.col("__bits").isNotNull())
    return explode_codes(rolled, "__bits", "Clase").select("id", "Clase", *PACK_MEASURES)


def attach_measures(base: DataFrame, rolled: DataFrame) -> DataFrame:
    """``household_measures`` next to a household table; the pack's measures count where members have the household's class."""
    joined = base.join(rolled, "id", "left")
    place = F.coalesce(F.col("Clase"), F.lit(LARGEST_CODE + 1)).cast("int")
    same = F.call_function("shiftright", F.col("__bits"), place).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return joined.withColumns({m: F.when(same, F.col(m)) for m in PACK_MEASURES}).drop("__bits")


def final_base(packs: list[DataFrame], households: DataFrame, role: str) -> DataFrame:
    """Join the packs, drop weights, then train: complete rows + outcome; test: three fills."""
    base = drop_cols(assemble_packs(*packs), list(WEIGHTS), strict=False)
    factors = {f: as_factor(F.col(f)) for f in FACTORS if f in base.columns}
    if role == "train":
        full = left_join_project(drop_na(base), households, ["Npersug", "Ingpcug", "Pobre"], ["id"])
        return full.withColumns({"lIngpcug": safe_log(F.col("Ingpcug")), **factors})
    if role == "test":
        full = left_join_project(base, households, ["Npersug"], ["id"])
        return replace_na(full.withColumns(factors), TEST_FILLS)
    raise ValueError(f"role is train or test, not {role}")


def exclude_domain(df: DataFrame, value: str, column: str = "Dominio") -> DataFrame:
    return df.filter(as_character(quoted(column)) != value)


def poverty_label(income: Column, line: Column) -> Column:
    """Poor: income per head strictly below the line."""
    return F.when(income < line, 1).when(income >= line, 0)
