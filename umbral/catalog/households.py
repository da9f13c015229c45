"""Household pipelines, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.catalog.registry import query, rounded
from umbral.operators import sampling as K
from umbral.operators.windows import union_by_name
from umbral.plans import households as H
from umbral.sources.views import CAPITAL, hogares, personas, test_part, train_part, view_sql

P, HH, PH = view_sql("personas"), view_sql("hogares"), view_sql("personas", "hogares")


def survey(spark: SparkSession, sf: str) -> DataFrame:
    people, homes = personas(spark, sf), hogares(spark, sf)
    return H.build_survey(train_part(people), train_part(homes), test_part(people), test_part(homes))


# The joined survey as the checking engine sees it: income is missing on test rows.
_SURVEY = (
    "survey AS (SELECT p.*, h.P5090, h.Nper, h.Npersug, h.Clase AS Clase_y, h.Dominio, CASE WHEN p.train = 1 THEN h.Ingpcug END AS Ingpcug, "
    "CASE WHEN p.train = 1 THEN h.Pobre END AS Pobre FROM personas p LEFT JOIN hogares h ON p.id = h.id)"
)
# Written out for the checking engine, not taken from the plan under test.
_AMOUNT = {"P6545": "P6545s1", "P6580": "P6580s1", "P6585s1": "P6585s1a1", "P6585s2": "P6585s2a1", "P6585s3": "P6585s3a1", "P6585s4": "P6585s4a1"}
_COUNT = {"P6545": "Nprimas", "P6580": "Nbonos", "P6585s1": "NauxAli", "P6585s2": "NauxTra", "P6585s3": "NauxFam", "P6585s4": "NauxEdu"}
_TENURE = (
    "WHEN 1 THEN 'Propia, pagada' WHEN 2 THEN 'Propia, pagando' WHEN 3 THEN 'Arriendo/subarriendo' WHEN 4 THEN 'Usufructo' "
    "WHEN 5 THEN 'Posesión sin título' WHEN 6 THEN 'Otra'"
)
_SCHOOLING = "WHEN 1 THEN 'Ninguno' WHEN 2 THEN 'Preescolar' WHEN 3 THEN 'Primaria' WHEN 4 THEN 'Secundaria' WHEN 5 THEN 'Media' WHEN 6 THEN 'Superior'"
_BONUS = ["P6545", "P6580", "P6585s1", "P6585s2", "P6585s3", "P6585s4"]


def _stated(flag: str) -> str:
    amount = _AMOUNT[flag]
    return f"CASE WHEN train = 0 THEN {flag} WHEN {amount} IS NULL THEN NULL WHEN {amount} = 0 THEN 2 ELSE {flag} END"


_CLEAN = (
    "clean AS (SELECT id, Orden, train, Clase, P6050, P6210, Npersug, Nper - Npersug AS DiffNper, COALESCE(Pet, 0) AS Pet, COALESCE(Oc, 0) AS Oc, "
    + ", ".join(f"CASE WHEN ({_stated(f)}) IN (2, 9) THEN 0 ELSE ({_stated(f)}) END AS {f}" for f in _BONUS)
    + ", CASE WHEN P6210 = 9 THEN 1 ELSE P6210 END AS nivel_educ FROM survey)"
)
_ROLLED = (
    "rolled AS (SELECT id, train, CASE WHEN Clase = 2 THEN 0 ELSE Clase END AS Cabecera, "
    + ", ".join(f"COALESCE(SUM({f}), 0)::BIGINT AS {o}" for f, o in _COUNT.items())
    + ", "
    + ", ".join(f"round(COALESCE(SUM({f}), 0)::DOUBLE / MAX(Npersug), 6) AS {o}PP" for f, o in _COUNT.items())
    + ", round(SUM(nivel_educ)::DOUBLE / MAX(Npersug), 6) AS Educ_avg FROM clean GROUP BY id, train, Clase)"
)


@query(
    f"{PH}, {_SURVEY} SELECT id, Orden, Clase AS \"Clase.x\", Clase_y AS \"Clase.y\", P5090, Nper, Npersug, Ingpcug, Pobre, train FROM survey"
)
def build_survey(spark: SparkSession, sf: str) -> DataFrame:
    names = ["id", "Orden", "Clase.x", "Clase.y", "P5090", "Nper", "Npersug", "Ingpcug", "Pobre", "train"]
    return survey(spark, sf).select(*[f"`{n}`" for n in names])


@query(
    f"{PH}, {_SURVEY} SELECT id, Orden, CASE P5090 "
    + _TENURE
    + " END AS vivienda, CASE P6090 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS tiene_salud, "
    "CASE WHEN P6920 IS NULL THEN NULL WHEN P6920 = 3 THEN 1 ELSE 0 END AS pensionado, CASE P6920 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS cotiza_pension, "
    "CASE WHEN P6210 = 9 THEN 1 ELSE P6210 END AS nivel_educ, CASE CASE WHEN P6210 = 9 THEN 1 ELSE P6210 END "
    + _SCHOOLING
    + " END AS nivel_educ_nombre FROM survey"
)
def person_status(spark: SparkSession, sf: str) -> DataFrame:
    names = ["vivienda", "tiene_salud", "pensionado", "cotiza_pension", "nivel_educ", "nivel_educ_nombre"]
    return H.person_status_vars(survey(spark, sf)).select("id", "Orden", *names)


@query(f"{PH}, {_SURVEY}, {_CLEAN} SELECT id, Orden, Pet, Oc, DiffNper, {', '.join(_BONUS)} FROM clean")
def clean_bonuses(spark: SparkSession, sf: str) -> DataFrame:
    return H.clean_job_bonuses(survey(spark, sf)).select("id", "Orden", "Pet", "Oc", "DiffNper", *_BONUS)


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    answers = personas(spark, sf).withColumn("nivel_educ", H.education_level(F.col("P6210")))
    return H.job_bonus_rollup(H.clean_bonus_answers(answers), hogares(spark, sf))


_RATES = [f"{o}PP" for o in _COUNT.values()]


@query(f"{PH}, {_SURVEY}, {_CLEAN}, {_ROLLED} SELECT * FROM rolled")
def bonus_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rolled(spark, sf), *_RATES, "Educ_avg")


@query(
    f"{PH}, {_SURVEY}, {_CLEAN}, {_ROLLED} SELECT h.id, r.train, r.Nprimas, r.Educ_avg, h.nivel_educ AS Educ_jefe FROM rolled r "
    "RIGHT JOIN (SELECT id, nivel_educ FROM clean WHERE P6050 = 1) h ON r.id = h.id"
)
def head_education(spark: SparkSession, sf: str) -> DataFrame:
    people = personas(spark, sf).select("id", "P6050", H.education_level(F.col("P6210")).alias("Educ_jefe"))
    heads, rolled = H.head_of_household(people, ["id", "Educ_jefe"]), _rolled(spark, sf)
    out = H.attach_head_education(rolled.select("id", "train", "Nprimas", "Educ_avg"), heads)
    return rounded(out, "Educ_avg")


@query(P + "SELECT id, COUNT(*) AS size_unidad_gasto FROM personas WHERE P6050 IS NULL OR P6050 NOT IN (6, 7, 8, 9) GROUP BY id")
def spending_unit(spark: SparkSession, sf: str) -> DataFrame:
    return H.spending_unit(personas(spark, sf))


@query(P + "SELECT id, COUNT(*) FILTER (WHERE P6050 IN (6, 8)) AS servicio_trabajadores FROM personas GROUP BY id")
def service_workers(spark: SparkSession, sf: str) -> DataFrame:
    return H.service_workers(personas(spark, sf))


_ANSWERS = [
    "P7495", "P7500s2", "P7500s3", "P7505", "P7510s1", "P7510s2", "P7510s3", "P7510s5", "P7510s6", "P7510s7", "Pet", "Oc", "Des", "Ina",
]
_CODED = (
    "coded AS (SELECT id, Orden, Clase, P6040, P6050, "
    + ", ".join(f"CASE WHEN {c} IN (2, 9) THEN 0 ELSE {c} END AS {c}" for c in _ANSWERS)
    + " FROM personas), unit AS (SELECT * FROM coded WHERE P6050 IS NULL OR P6050 NOT IN (6, 7, 8, 9))"
)
_TRANSFERS = ", ".join(
    [f"CASE WHEN COALESCE(SUM({c}), 0) > 0 THEN 1 ELSE 0 END AS {o}" for c, o in
     {"P7500s2": "pensiones", "P7500s3": "pension_alimenticia", "P7510s6": "cesantias", "P7510s7": "otros_ingresos"}.items()]
    + [f"round(COALESCE(SUM({c}), 0)::DOUBLE / COUNT(*), 6) AS {o}" for c, o in
       {"P7510s1": "remesas_internas", "P7510s2": "remesas_externas", "P7510s3": "ayuda_instituciones", "P7510s5": "inversiones"}.items()]
)
_LABOUR = (
    "round(AVG(COALESCE(Pet, 0)), 6) AS prop_pet, round(AVG(P6040) FILTER (WHERE Pet = 1), 6) AS edad_pet, "
    "round(AVG(COALESCE(Oc, 0)) FILTER (WHERE Pet = 1), 6) AS tasa_ocupados, round(AVG(COALESCE(Ina, 0)) FILTER (WHERE Pet = 1), 6) AS tasa_inactivos"
)
_SHARES = ["remesas_internas", "remesas_externas", "ayuda_instituciones", "inversiones"]
_WORK = ["prop_pet", "edad_pet", "tasa_ocupados", "tasa_inactivos"]
_PACK = (
    f"pack AS (SELECT u.*, s.servicio_trabajadores FROM (SELECT DISTINCT id, Clase FROM unit) c JOIN (SELECT id, {_TRANSFERS}, {_LABOUR} FROM unit GROUP BY id) u "
    "USING (id) JOIN (SELECT id, COUNT(*) FILTER (WHERE P6050 IN (6, 8)) AS servicio_trabajadores FROM coded GROUP BY id) s USING (id))"
).replace("SELECT u.*,", "SELECT u.*, c.Clase,")


def _members(people: DataFrame) -> DataFrame:
    coded = H.mutate_across(people, _ANSWERS, H.yes_no)
    return coded.filter(H.in_spending_unit())


@query(f"{P}, {_CODED} SELECT id, {_TRANSFERS} FROM unit GROUP BY id")
def transfers_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.transfers_rollup(_members(personas(spark, sf))), *_SHARES)


@query(f"{P}, {_CODED} SELECT id, {_LABOUR} FROM unit GROUP BY id")
def labour_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.labour_rollup(_members(personas(spark, sf))), *_WORK)


@query(f"{P}, {_CODED}, {_PACK} SELECT * FROM pack")
def household_pack(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.household_pack(personas(spark, sf)), *_SHARES, *_WORK)


def packs(spark: SparkSession, sf: str, part) -> tuple[list[DataFrame], DataFrame]:
    """Household table of one file pair with everything its persons give, from one aggregate over them; and its households."""
    people, homes = part(personas(spark, sf)), part(hogares(spark, sf))
    base = homes.select("id", "Clase", "Dominio", "Depto", "P5000", "P5090", "P5130", "Nper", "Li", "Lp", "Fex_c", "Fex_dpto")
    more = {"Educ_avg": F.avg(H.education_level(F.col("P6210"))), "Nprimas": F.count_if(F.col("P6545") == 1)}
    return [H.attach_measures(base, H.household_measures(people, more))], homes


_BASE = (
    f"{PH}, {_CODED}, {_PACK}, base AS (SELECT h.id, h.Clase, h.Dominio, h.Depto, CAST(h.P5090 AS VARCHAR) AS P5090, h.P5000, h.P5130, h.Lp, h.train, h.Npersug, h.Ingpcug, h.Pobre, "
    "round(e.Educ_avg, 6) AS Educ_avg, b.Nprimas, k.pensiones, k.remesas_internas, k.prop_pet, k.edad_pet, k.tasa_ocupados, k.tasa_inactivos, k.servicio_trabajadores "
    "FROM hogares h LEFT JOIN (SELECT id, AVG(CASE WHEN P6210 = 9 THEN 1 ELSE P6210 END) AS Educ_avg FROM personas GROUP BY id) e ON h.id = e.id "
    "LEFT JOIN pack k ON h.id = k.id AND h.Clase IS NOT DISTINCT FROM k.Clase "
    "LEFT JOIN (SELECT id, COUNT(*) FILTER (WHERE P6545 = 1) AS Nprimas FROM personas GROUP BY id) b ON h.id = b.id)"
)
_BASE_COLUMNS = ["id", "Clase", "Dominio", "Depto", "P5090", "P5000", "P5130", "Lp", "Educ_avg", "Nprimas", "pensiones", "remesas_internas",
                 "prop_pet", "edad_pet", "tasa_ocupados", "tasa_inactivos", "servicio_trabajadores", "Npersug"]
_ROUNDED = ["Educ_avg", "remesas_internas", *_WORK]


@query(
    f"{_BASE} SELECT {', '.join(_BASE_COLUMNS)}, Ingpcug, Pobre, round(CASE WHEN Ingpcug > 0 THEN ln(Ingpcug) ELSE 0 END, 6) AS lIngpcug FROM base "
    "WHERE train = 1 AND Educ_avg IS NOT NULL AND Nprimas IS NOT NULL AND pensiones IS NOT NULL AND edad_pet IS NOT NULL"
)
def final_base_train(spark: SparkSession, sf: str) -> DataFrame:
    parts, homes = packs(spark, sf, train_part)
    out = H.final_base(parts, homes, "train").select(*_BASE_COLUMNS, "Ingpcug", "Pobre", "lIngpcug")
    return rounded(out, *_ROUNDED, "lIngpcug")


@query(
    f"{_BASE} SELECT " + ", ".join(f"COALESCE({c}, 0) AS {c}" if c in H.TEST_FILLS else c for c in _BASE_COLUMNS) + " FROM base WHERE train = 0"
)
def final_base_test(spark: SparkSession, sf: str) -> DataFrame:
    parts, homes = packs(spark, sf, test_part)
    return rounded(H.final_base(parts, homes, "test").select(*_BASE_COLUMNS), *_ROUNDED)


@query(HH + f"SELECT id, Dominio FROM hogares WHERE Dominio <> '{CAPITAL}'")
def exclude_domain(spark: SparkSession, sf: str) -> DataFrame:
    return H.exclude_domain(hogares(spark, sf), CAPITAL).select("id", "Dominio")


@query(HH + "SELECT id, CASE WHEN Clase = 2 THEN 0 ELSE Clase END AS Cabecera FROM hogares")
def urban_flag(spark: SparkSession, sf: str) -> DataFrame:
    return hogares(spark, sf).select("id", H.urban_flag(F.col("Clase")).alias("Cabecera"))


@query(HH + "SELECT id, CASE WHEN Ingpcug < Lp THEN 1 ELSE 0 END AS poor FROM hogares")
def poverty_label(spark: SparkSession, sf: str) -> DataFrame:
    return hogares(spark, sf).select("id", H.poverty_label(F.col("Ingpcug"), F.col("Lp")).alias("poor"))


def hash_sql(seed: str, key: str = "id") -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 7))::BIGINT"


@query(HH + f"SELECT id, Dominio FROM hogares WHERE {hash_sql('123')} % 10000 < 1500")
def sample_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return K.sample_fraction(hogares(spark, sf), 0.15, "id", 123).select("id", "Dominio")


@query(HH + f"SELECT id, CASE WHEN {hash_sql('123')} % 10000 < 1500 THEN 'validation' ELSE 'train' END AS part FROM hogares")
def split_validation(spark: SparkSession, sf: str) -> DataFrame:
    train, validation = K.split_validation(hogares(spark, sf).select("id"), 0.15, "id", 123)
    return union_by_name(train.withColumn("part", F.lit("train")), validation.withColumn("part", F.lit("validation")))


@query(
    HH + f"SELECT id, CASE WHEN {hash_sql('123')} % 10000 < 1500 THEN 'validation' WHEN {hash_sql('123/rest')} % 10000 < 1500 THEN 'test' "
    "ELSE 'train' END AS part FROM hogares"
)
def split_three_way(spark: SparkSession, sf: str) -> DataFrame:
    parts = K.split_three_way(hogares(spark, sf).select("id"), 0.15, 0.15, "id", 123)
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "validation", "test"))]
    return union_by_name(union_by_name(*named[:2]), named[2])


@query(HH + f"SELECT id, CAST({hash_sql('fold:123')} % 5 AS INT) AS fold FROM hogares")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return K.kfold(hogares(spark, sf).select("id"), 5, "id", 123)


@query(
    HH + f"SELECT id, Pobre FROM (SELECT id, Pobre, row_number() OVER (PARTITION BY Pobre ORDER BY {hash_sql('123')}, id) AS place FROM hogares) "
    "WHERE place <= CAST(floor(1.5 * (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM hogares GROUP BY Pobre))) AS BIGINT)"
)
def downsample(spark: SparkSession, sf: str) -> DataFrame:
    return K.downsample(hogares(spark, sf).select("id", "Pobre"), "Pobre", "id", 123)


@query(
    HH + "SELECT id, kind FROM (SELECT id, kind, "
    f"row_number() OVER (PARTITION BY kind ORDER BY {hash_sql('123')}, id) AS place FROM (SELECT id, CASE P5090 WHEN 1 THEN NULL WHEN 2 THEN 'a' WHEN 3 THEN 'b' ELSE 'c' END AS kind FROM hogares)) "
    "WHERE kind IS NOT NULL AND place <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM (SELECT CASE P5090 WHEN 1 THEN NULL WHEN 2 THEN 'a' WHEN 3 THEN 'b' ELSE 'c' END AS kind FROM hogares) "
    "WHERE kind IS NOT NULL GROUP BY kind))"
)
def downsample_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a label neither set the limit nor stay."""
    kind = F.when(F.col("P5090") == 2, "a").when(F.col("P5090") == 3, "b").when(F.col("P5090") > 3, "c")
    return K.downsample(hogares(spark, sf).select("id", kind.alias("kind")), "kind", "id", 123, under_ratio=1.0)
