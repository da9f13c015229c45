"""Files: missing codes, column order, factor levels, submissions."""

import pytest
from pyspark.sql import types as T

from umbral.sources import tables as S
from umbral.sources.schemas import HOUSEHOLDS, PERSONS, SUBMISSION
from umbral.session import scratch_path

SMALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])


def test_csv_missing_codes_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,other,id,n\n1.5,z,a,1\nNA,z,"b",NA\n,z,NA,\n2,z,,3\n')
    got = [tuple(r) for r in S.read_survey(spark, str(tmp_path / "a.csv"), SMALL).collect()]
    assert got == [("a", 1, 1.5), ("b", None, None), (None, None, None), (None, 3, 2.0)]
    with pytest.raises(ValueError):
        S.read_survey(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("zz", T.StringType())]))


def test_survey_schemas_have_unique_names():
    for schema in (PERSONS, HOUSEHOLDS):
        assert len(set(schema.names)) == len(schema.names)


def test_snapshot_keeps_levels(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "f string, n int")
    path = scratch_path(spark, "levels")
    S.save_snapshot(df, path, factors=["f"])
    back = S.load_snapshot(spark, path)
    assert S.levels_of(back, "f") == ["a", "b"] and S.levels_of(back, "n") == []
    with pytest.raises(ValueError):
        S.learn_levels(df, ["f"], at_most=1)


def test_submission_is_id_and_flag(spark):
    path = scratch_path(spark, "submission")
    S.write_submission(spark.createDataFrame([("a", 1.0, 9), ("b", None, 9)], "id string, pobre double, x int"), path)
    assert sorted(tuple(r) for r in S.read_survey(spark, path, SUBMISSION).collect()) == [("a", 1), ("b", None)]


def test_unreadable_entries_are_reported_by_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,other,n,x\na,1,5,1.5\nb,2,abc,NA\nc,3, ,"1,5"\nd,4,7.5,x\ne,5,8\n')
    path = str(tmp_path / "a.csv")
    rejects = S.survey_rejects(spark, path, SMALL)
    assert sorted(tuple(r) for r in rejects.collect()) == [("b,2,abc,NA", "n", "abc"), ('c,3, ,"1,5"', "x", "1,5"), ("d,4,7.5,x", "n", "7.5"), ("d,4,7.5,x", "x", "x")]
    assert {tuple(r) for r in S.reject_counts(rejects, SMALL).collect()} == {("n", 2), ("x", 2)}
    (tmp_path / "b.csv").write_text("id,n,x\na,1,2.0\n")
    clean = S.survey_rejects(spark, str(tmp_path / "b.csv"), SMALL)
    assert clean.collect() == [] and {r.n for r in S.reject_counts(clean, SMALL).collect()} == {0}


def test_bucketed_snapshots_join_where_they_lie(spark):
    from umbral.operators.joins import assemble_packs

    tables = {
        "base": spark.range(300).selectExpr("id", "CAST(IF(id % 9 = 0, NULL, id % 2) AS INT) AS Clase", "CAST(id % 3 AS STRING) AS f"),
        "size": spark.range(0, 300, 2).selectExpr("id", "id * 2 AS n"),
        "pack": spark.range(300).selectExpr("id", "CAST(IF(id % 9 = 0, NULL, id % 4) AS INT) AS Clase", "id + 1 AS m"),
        "rate": spark.range(0, 300, 3).selectExpr("id", "id / 7 AS r"),
    }
    loaded = []
    for name, df in tables.items():
        path = scratch_path(spark, name)
        S.save_bucketed(df, path, "id", 4, factors=["f"] if name == "base" else [])
        loaded.append(S.load_bucketed(spark, path, "id", 4))
    assert S.levels_of(loaded[0], "f") == ["0", "1", "2"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = assemble_packs(*loaded)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        key = lambda r: r.id
        assert sorted(joined.collect(), key=key) == sorted(assemble_packs(*tables.values()).collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
