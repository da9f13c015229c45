"""Sources, sinks, schema operators, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.catalog.registry import query, r6, rounded
from umbral.functions.nulls import in_set
from umbral.functions.recode import yes_no
from umbral.learning.evaluate import selected_terms
from umbral.operators import columns as C
from umbral.operators import joins as J
from umbral.operators import windows as W
from umbral.operators.profile import null_profile
from umbral.session import scratch_path
from umbral.sources import tables as S
from umbral.sources.schemas import PERSONS, SUBMISSION
from umbral.sources.views import hogares, personas, test_part, train_part, view_sql

P, H, PH = view_sql("personas"), view_sql("hogares"), view_sql("personas", "hogares")


@query(P + "SELECT CAST(id AS VARCHAR) AS id, Orden, P6040, P6545, P6545s1 FROM personas")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    names = ["id", "Orden", "P6040", "P6545", "P6545s1"]
    path = scratch_path(spark, "persons-csv")
    S.write_table_csv(personas(spark, sf).select(*names), path)
    return S.read_survey(spark, path, T.StructType([PERSONS[n] for n in names]))


@query(
    P + "SELECT 'Orden' AS name, COUNT(*) FILTER (WHERE P6040 % 7 = 0) AS n FROM personas "
    "UNION ALL SELECT 'P6545s1', COUNT(*) FILTER (WHERE P6040 % 5 = 0 AND P6545s1 IS NOT NULL) FROM personas UNION ALL SELECT 'P6040', 0"
)
def survey_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that are not numbers, written into a file and reported by column."""
    people = personas(spark, sf).select("id", "Orden", "P6040", "P6545s1")
    spoiled = people.withColumns({
        "Orden": F.when(F.col("P6040") % 7 == 0, F.concat(F.lit("no "), "Orden")).otherwise(F.col("Orden").cast("string")),
        "P6545s1": F.when(F.col("P6040") % 5 == 0, F.concat("P6545s1", F.lit(" pesos"))).otherwise(F.col("P6545s1").cast("string")),
    })
    path, schema = scratch_path(spark, "spoiled"), T.StructType([PERSONS[n] for n in people.columns])
    S.write_table_csv(spoiled, path)
    return S.reject_counts(S.survey_rejects(spark, path, schema), schema)


@query(H + "SELECT id, Dominio, CAST(dense_rank() OVER (ORDER BY Dominio) AS BIGINT) AS level FROM hogares")
def parquet_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    S.save_snapshot(hogares(spark, sf).select("id", "Dominio"), path, factors=["Dominio"])
    back = S.load_snapshot(spark, path)
    levels = F.array(*[F.lit(v) for v in S.levels_of(back, "Dominio")])
    return back.withColumn("level", F.array_position(levels, F.col("Dominio")))


@query(
    H + "SELECT * FROM (SELECT 'Dominio_' || Dominio AS term, CASE WHEN COUNT(*) % 2 = 0 THEN 0 "
    "ELSE round(AVG(Pobre), 6) END AS estimate FROM hogares GROUP BY Dominio) WHERE estimate <> 0"
)
def coefficient_table(spark: SparkSession, sf: str) -> DataFrame:
    share = F.when(F.count(F.lit(1)) % 2 == 0, 0.0).otherwise(r6(F.avg("Pobre")))
    terms = hogares(spark, sf).groupBy("Dominio").agg(share.alias("estimate"))
    path = scratch_path(spark, "terms")
    S.save_coefficients(terms.select(F.concat(F.lit("Dominio_"), "Dominio").alias("term"), "estimate"), path)
    return selected_terms(S.load_coefficients(spark, path), kept=True)


@query(H + "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN P5130 < 100 THEN 1 ELSE 0 END AS pobre FROM hogares WHERE train = 0")
def submission_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    test = test_part(hogares(spark, sf))
    path = scratch_path(spark, "submission")
    S.write_submission(test.withColumn("pobre", F.when(F.col("P5130") < 100, 1).otherwise(0)), path)
    return S.read_survey(spark, path, SUBMISSION)


@query(H + "SELECT id, P5090, Lp FROM hogares")
def select_all_any(spark: SparkSession, sf: str) -> DataFrame:
    strict = C.select_all_of(hogares(spark, sf), ["id", "P5090", "Lp", "Li"])
    return C.select_any_of(strict, ["id", "P5090", "absent", "Lp"])


@query(H + "SELECT id, P5000 AS rooms, Dominio AS domain FROM hogares")
def drop_rename(spark: SparkSession, sf: str) -> DataFrame:
    few = C.select_all_of(hogares(spark, sf), ["id", "P5000", "Dominio", "Fex_c", "Li"])
    return C.rename(C.drop_cols(few, ["Fex_c", "Li"]), {"P5000": "rooms", "Dominio": "domain"})


@query(H + "SELECT id, Nper - Npersug AS DiffNper, 2 * (Nper - Npersug) AS doubled FROM hogares")
def mutate_sequential(spark: SparkSession, sf: str) -> DataFrame:
    out = C.mutate(hogares(spark, sf), DiffNper=F.col("Nper") - F.col("Npersug"), doubled=2 * F.col("DiffNper"))
    return out.select("id", "DiffNper", "doubled")


_YN = ["P7495", "P7500s2", "P7510s1"]


@query(P + "SELECT id, Orden, " + ", ".join(f"CASE WHEN {c} IN (2, 9) THEN 0 ELSE {c} END AS {c}" for c in _YN) + " FROM personas")
def mutate_across_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    return C.mutate_across(personas(spark, sf).select("id", "Orden", *_YN), _YN, yes_no)


@query(P + "SELECT id, Orden, P6510, P6510s1 FROM personas WHERE P6510 = 2 AND P6510s1 <> 0")
def filter_null_dropping(spark: SparkSession, sf: str) -> DataFrame:
    kept = C.filter_rows(personas(spark, sf), (F.col("P6510") == 2) & (F.col("P6510s1") != 0))
    return kept.select("id", "Orden", "P6510", "P6510s1")


@query(P + "SELECT id, Orden, P6090 FROM personas WHERE P6090 IS NULL OR P6090 NOT IN (2, 9)")
def in_set_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    return personas(spark, sf).filter(~in_set(F.col("P6090"), [2, 9])).select("id", "Orden", "P6090")


@query(
    H + "SELECT id, P5090, CASE WHEN train = 1 THEN Ingpcug END AS Ingpcug, CASE WHEN train = 1 THEN Pobre END AS Pobre, "
    "train AS is_train FROM hogares"
)
def align_and_stack(spark: SparkSession, sf: str) -> DataFrame:
    every = hogares(spark, sf)
    train = C.tag(train_part(every).select("id", "P5090", "Ingpcug", "Pobre"), "is_train", 1)
    test = C.tag(test_part(every).select("id", "P5090"), "is_train", 0)
    return W.union_by_name(train, C.align_columns(test, train))


_PRESENCE = ["P5090", "Ingpcug", "Pobre", "P9999"]


@query(
    H + "SELECT * FROM (SELECT 'P5090' AS name, TRUE AS in_train, TRUE AS in_test, FALSE AS only_train, "
    "(SELECT COUNT(P5090) FROM hogares WHERE train = 1) AS present UNION ALL "
    "SELECT 'Ingpcug', TRUE, FALSE, TRUE, (SELECT COUNT(Ingpcug) FROM hogares WHERE train = 1) UNION ALL "
    "SELECT 'Pobre', TRUE, FALSE, TRUE, (SELECT COUNT(Pobre) FROM hogares WHERE train = 1) UNION ALL "
    "SELECT 'P9999', FALSE, FALSE, FALSE, 0)"
)
def schema_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Presence per table, the set difference of names, and how many training rows hold a value."""
    every = hogares(spark, sf)
    train, test = train_part(every), test_part(every)
    only = C.column_difference(train, test)
    known = [n for n in _PRESENCE if n in train.columns]
    held = train.agg(*[F.count(n).alias(n) for n in known]).unpivot([], known, "name", "present")
    table = C.schema_presence(_PRESENCE, train=train, test=test)
    return (
        table.withColumn("only_train", F.col("name").isin(only))
        .join(held, "name", "left")
        .withColumn("present", F.coalesce("present", F.lit(0).cast("bigint")))
    )


@query(
    PH + 'SELECT p.id, p.Orden, p.Clase AS "Clase.x", h.Clase AS "Clase.y", h.Npersug FROM personas p LEFT JOIN '
    "(SELECT * FROM hogares WHERE P5000 <> 3) h ON p.id = h.id"
)
def left_join_suffix(spark: SparkSession, sf: str) -> DataFrame:
    people = personas(spark, sf).select("id", "Orden", "Clase")
    homes = hogares(spark, sf).filter("P5000 <> 3").select("id", "Clase", "Npersug")
    return J.left_join_key(people, homes, ["id"])


@query(
    PH + "SELECT indicator, COUNT(*) AS n FROM (SELECT CASE WHEN h.id IS NULL THEN 'left_only' ELSE 'both' END AS indicator "
    "FROM personas p LEFT JOIN (SELECT id FROM hogares WHERE P5000 <> 3) h ON p.id = h.id) GROUP BY indicator"
)
def join_indicator(spark: SparkSession, sf: str) -> DataFrame:
    homes = hogares(spark, sf).filter("P5000 <> 3").select("id")
    marked = J.join_indicator(personas(spark, sf).select("id", "Orden"), homes, ["id"])
    return marked.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))


@query(
    P + "SELECT p.id, p.Orden, p.Pet, p.P6040, r.n FROM personas p LEFT JOIN (SELECT id, Orden, Pet, COUNT(*) AS n FROM personas "
    "GROUP BY id, Orden, Pet) r ON p.id = r.id AND p.Orden = r.Orden AND p.Pet IS NOT DISTINCT FROM r.Pet"
)
def left_join_natural_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    people = personas(spark, sf).select("id", "Orden", "Pet", "P6040")
    counts = people.groupBy("id", "Orden", "Pet").agg(F.count(F.lit(1)).alias("n"))
    return J.left_join_natural(people, counts)


@query(PH + "SELECT p.id, p.Orden, h.Npersug, h.Ingpcug FROM personas p LEFT JOIN hogares h ON p.id = h.id")
def left_join_project(spark: SparkSession, sf: str) -> DataFrame:
    return J.left_join_project(personas(spark, sf).select("id", "Orden"), hogares(spark, sf), ["Npersug", "Ingpcug"], ["id"])


@query(
    P + "SELECT h.id, r.n, h.P6210 AS Educ_jefe FROM (SELECT id, COUNT(*) AS n FROM personas WHERE P6040 >= 18 GROUP BY id) r "
    "RIGHT JOIN (SELECT id, P6210 FROM personas WHERE P6050 = 1) h ON r.id = h.id"
)
def right_join_heads(spark: SparkSession, sf: str) -> DataFrame:
    people = personas(spark, sf)
    adults = people.filter("P6040 >= 18").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    heads = people.filter("P6050 = 1").select("id", F.col("P6210").alias("Educ_jefe"))
    return J.right_join(adults, heads, ["id"])


@query(PH + "SELECT id, Dominio FROM hogares h WHERE NOT EXISTS (SELECT 1 FROM personas p WHERE p.id = h.id)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return J.anti_join(hogares(spark, sf).select("id", "Dominio"), personas(spark, sf), ["id"])


@query(
    PH + "SELECT h.id, h.Clase, h.Dominio, e.n_people, b.n_primas FROM hogares h LEFT JOIN (SELECT id, COUNT(*) AS n_people FROM personas "
    "GROUP BY id) e ON h.id = e.id LEFT JOIN (SELECT id, Clase, COUNT(*) FILTER (WHERE P6545 = 1) AS n_primas FROM personas GROUP BY id, Clase) b "
    "ON h.id = b.id AND h.Clase IS NOT DISTINCT FROM b.Clase"
)
def assemble_packs(spark: SparkSession, sf: str) -> DataFrame:
    people = personas(spark, sf)
    sizes = people.groupBy("id").agg(F.count(F.lit(1)).alias("n_people"))
    bonuses = people.groupBy("id", "Clase").agg(F.count_if(F.col("P6545") == 1).alias("n_primas"))
    return J.assemble_packs(hogares(spark, sf).select("id", "Clase", "Dominio"), sizes, bonuses)


@query(
    PH + "SELECT h.id, h.Clase, h.Dominio, s.n_people, b.n_primas FROM hogares h LEFT JOIN (SELECT id, COUNT(*) AS n_people FROM personas GROUP BY id) s ON h.id = s.id "
    "LEFT JOIN (SELECT id, Clase, COUNT(*) FILTER (WHERE P6545 = 1) AS n_primas FROM personas GROUP BY id, Clase) b ON h.id = b.id AND h.Clase = b.Clase"
)
def bucketed_packs(spark: SparkSession, sf: str) -> DataFrame:
    """The same star over snapshots that lie by household, which join without a shuffle."""
    people = personas(spark, sf)
    sizes = people.groupBy("id").agg(F.count(F.lit(1)).alias("n_people"))
    bonuses = people.groupBy("id", "Clase").agg(F.count_if(F.col("P6545") == 1).alias("n_primas"))
    loaded, buckets = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, table in (("base", hogares(spark, sf).select("id", "Clase", "Dominio")), ("sizes", sizes), ("bonuses", bonuses)):
        path = scratch_path(spark, name)
        S.save_bucketed(table, path, "id", buckets)
        loaded.append(S.load_bucketed(spark, path, "id", buckets))
    return J.assemble_packs(*loaded)


@query(
    P + "SELECT id, Orden, P6040, SUM(P6040) OVER (PARTITION BY id)::BIGINT AS age_sum, round(AVG(P6040) OVER (PARTITION BY id), 6) AS age_mean, "
    "COUNT(*) OVER (PARTITION BY id) AS members FROM personas"
)
def group_mutate(spark: SparkSession, sf: str) -> DataFrame:
    people = personas(spark, sf).select("id", "Orden", "P6040")
    wanted = {"age_sum": F.sum("P6040"), "age_mean": F.avg("P6040"), "members": F.count(F.lit(1))}
    return rounded(W.group_mutate(people, "id", wanted), "age_mean")


@query(
    P + "SELECT DISTINCT id, Clase, P6020, SUM(P6040) OVER (PARTITION BY id)::BIGINT AS age_sum, round(AVG(P6040) OVER (PARTITION BY id), 6) AS age_mean "
    "FROM personas"
)
def rollup_distinct(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"age_sum": F.sum("P6040"), "age_mean": F.avg("P6040")}
    return rounded(W.rollup_distinct(personas(spark, sf), "id", wanted, codes=["Clase", "P6020"]), "age_mean")


@query(
    P + "SELECT DISTINCT id, P6020, P6090, SUM(P6040) OVER (PARTITION BY id)::BIGINT AS age_sum FROM personas"
)
def rollup_distinct_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Two codes that vary inside a group, one of them missing at times: a row per combination that occurs."""
    return W.rollup_distinct(personas(spark, sf), "id", {"age_sum": F.sum("P6040")}, codes=["P6020", "P6090"])


@query(
    H + "SELECT Dominio, round(AVG(P5130), 6) AS rent FROM hogares GROUP BY Dominio ORDER BY round(AVG(P5130), 6) DESC, Dominio LIMIT 10"
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    means = hogares(spark, sf).groupBy("Dominio").agg(r6(F.avg("P5130")).alias("rent"))
    return W.top_k(means, "rent", 10, ties=["Dominio"])


@query(P + "SELECT DISTINCT Clase, P6020, Pet, P6090 FROM personas")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return W.distinct_rows(personas(spark, sf).select("Clase", "P6020", "Pet", "P6090"))


@query(
    P + "SELECT name, missing, round(100.0 * missing / n, 6)::DOUBLE AS percent FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, COUNT(*) AS n FROM personas" for c in ("P6090", "P6545", "Oc")
    )
    + ")"
)
def bind_stats(spark: SparkSession, sf: str) -> DataFrame:
    profile = null_profile(personas(spark, sf).select("P6090", "P6545", "Oc"))
    both = W.bind_stats(profile.select("name", "missing"), profile.select("name", "percent"))
    return rounded(both, "percent")
