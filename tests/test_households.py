"""Household roll-ups on hand-made persons, against a plain reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from umbral.operators.windows import group_mutate, rollup_distinct
from umbral.plans import households as H

ANSWERS = [*H.OTHER_INCOME, *H.ACTIVITY]
SCHEMA = "id string, Orden int, Clase int, P6040 int, P6050 int, " + ", ".join(f"{c} int" for c in ANSWERS)


def people(seed, households=40, hot=300):
    rng = random.Random(seed)
    rows = []
    for h in range(households):
        size = hot if h == 0 else rng.randint(1, 6)
        for k in range(size):
            answers = [rng.choice([1, 2, 9, None]) for _ in H.OTHER_INCOME]
            activity = [rng.choice([1, None]) for _ in H.ACTIVITY]
            clase = rng.choice([1, 2, None]) if h == 1 else 1 + h % 2
            rows.append((f"h{h}", k + 1, clase, rng.randint(0, 90), rng.choice([1, 2, 3, 6, 7, 8, 9, None]), *answers, *activity))
    return rows


def expected(rows):
    """The rules one household at a time."""
    names = ["id", "Orden", "Clase", "P6040", "P6050", *ANSWERS]
    out = {}
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(dict(zip(names, r)))
    zero = lambda v: 0 if v in (2, 9) else v
    for key, group in by_id.items():
        group = [{**p, **{c: zero(p[c]) for c in ANSWERS}} for p in group]
        unit = [p for p in group if p["P6050"] not in (6, 7, 8, 9)]
        if not unit:
            continue
        total = lambda c: sum(p[c] or 0 for p in unit)
        aged = [p for p in unit if (p["Pet"] or 0) == 1]
        mean = lambda xs: sum(xs) / len(xs) if xs else None
        row = {
            "pensiones": int(total("P7500s2") > 0),
            "pension_alimenticia": int(total("P7500s3") > 0),
            "remesas_internas": total("P7510s1") / len(unit),
            "remesas_externas": total("P7510s2") / len(unit),
            "ayuda_instituciones": total("P7510s3") / len(unit),
            "inversiones": total("P7510s5") / len(unit),
            "cesantias": int(total("P7510s6") > 0),
            "otros_ingresos": int(total("P7510s7") > 0),
            "prop_pet": mean([p["Pet"] or 0 for p in unit]),
            "edad_pet": mean([p["P6040"] for p in aged]),
            "tasa_ocupados": mean([p["Oc"] or 0 for p in aged]),
            "tasa_inactivos": mean([p["Ina"] or 0 for p in aged]),
            "servicio_trabajadores": sum(p["P6050"] in (6, 8) for p in group),
        }
        for clase in {p["Clase"] for p in unit}:
            out[key, clase] = row
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_household_pack(spark, parts):
    rows = people(5)
    got = H.household_pack(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        for name, value in want[r["id"], r["Clase"]].items():
            assert r[name] == (None if value is None else pytest.approx(value)), (r["id"], name)


def test_household_pack_is_one_shuffle(spark):
    plan = H.household_pack(spark.createDataFrame(people(1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_heads_lost_and_doubled(spark):
    roll = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    persons = spark.createDataFrame([("a", 1, 4), ("a", 1, 5), ("b", 2, 3), ("c", 1, 6)], "id string, P6050 int, nivel_educ int")
    heads = H.head_of_household(persons, ["id", "nivel_educ"])
    got = sorted(tuple(r) for r in H.attach_head_education(roll, heads).collect())
    assert got == [("a", 1, 4), ("a", 1, 5), ("c", 3, 6)]


@pytest.mark.parametrize("hot_rows", [50, 10_000_000])
def test_group_mutate_with_a_hot_group(spark, hot_rows):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 20}", i) for i in range(100)] + [(None, 1)], "k string, x int")
    out = group_mutate(df, "k", {"s": F.sum("x"), "n": F.count(F.lit(1))}, rows_per_salt=hot_rows).collect()
    assert len(out) == 601
    sums = {}
    for r in df.collect():
        sums[r.k] = sums.get(r.k, 0) + r.x
    assert all(r.s == sums[r.k] for r in out)


def test_rollup_keeps_every_code(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", None, 7), ("b", 62, 1)], "id string, c int, x int")
    got = sorted(((r.id, r.c, r.s) for r in rollup_distinct(df, "id", {"s": F.sum("x")}, codes=["c"]).collect()), key=str)
    assert got == sorted([("a", 1, 18), ("a", 2, 18), ("a", None, 18), ("b", 62, 1)], key=str)


def test_rollup_keeps_combinations_not_their_product(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 1, 1), ("b", 0, None)], "id string, c int, d int")
    got = [tuple(r) for r in rollup_distinct(df, "id", {"n": F.count(F.lit(1))}, codes=["c", "d"]).collect()]
    assert sorted(got, key=str) == sorted([("a", 0, 0, 3), ("a", 1, 1, 3), ("b", 0, None, 1)], key=str)


def test_final_base_roles(spark):
    base = spark.createDataFrame([("a", "X", 1.0, 2.0), ("b", "Y", None, 3.0)], "id string, Dominio string, edad_pet double, Li double")
    rates = spark.createDataFrame([("a", 0.5, 0.5), ("b", None, 0.1)], "id string, tasa_ocupados double, tasa_inactivos double")
    homes = spark.createDataFrame([("a", 3, 100.0, 1), ("b", 4, 0.0, 0)], "id string, Npersug int, Ingpcug double, Pobre int")
    train = H.final_base([base, rates], homes, "train").collect()
    assert [r.id for r in train] == ["a"] and "Li" not in train[0].asDict() and train[0].lIngpcug == pytest.approx(4.605170)
    test = {r.id: r for r in H.final_base([base, rates], homes.drop("Ingpcug", "Pobre"), "test").collect()}
    assert test["b"].edad_pet == 0 and test["b"].tasa_ocupados == 0 and test["b"].tasa_inactivos == 0.1
    with pytest.raises(ValueError):
        H.final_base([base], homes, "other")
