"""Sources and sinks: CSV tables, typed snapshots, term tables, submissions and models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.operators.columns import quoted, select_all_of
from umbral.sources.schemas import TERMS

LEVELS = "levels"
MOST_LEVELS = 10_000


REJECTED = "__rejected"


def _reader(spark: SparkSession, path: str, schema: T.StructType):
    """A reader for the file's own columns in its own order, and their names."""
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in schema}
    absent = [n for n in types if n not in header]
    if absent:
        raise ValueError(f"columns not found in {path}: {absent}")
    in_file = [T.StructField(c, types.get(c, T.StringType())) for c in header]
    reader = spark.read.option("header", True).option("nullValue", "NA").option("emptyValue", "").option("enforceSchema", False)
    return reader, in_file


def _named(df: DataFrame, schema: T.StructType) -> DataFrame:
    df = df.select(*[quoted(f.name) for f in schema])
    blank = {f.name: F.nullif(F.nullif(F.trim(quoted(f.name)), F.lit("")), F.lit("NA")) for f in schema if f.dataType == T.StringType()}
    return df.withColumns(blank) if blank else df


def read_survey(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, matched to ``schema`` by name; ``NA`` and blank are missing.

    The file may hold more columns, in any order. Only its first line is read up front. An entry that cannot be read as its type is missing as well:
    ``survey_rejects`` lists these.
    """
    reader, in_file = _reader(spark, path, schema)
    return _named(reader.schema(T.StructType(in_file)).csv(path), schema)


def survey_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(record, name, value)``: every entry of the file that ``read_survey`` could not read as its type, with its whole line.

    The reader itself marks such lines; only these are looked at again, field by field. Fields a short line lacks are missing, not unreadable.
    """
    reader, in_file = _reader(spark, path, schema)
    marked = T.StructType([*in_file, T.StructField(REJECTED, T.StringType())])
    bad = reader.schema(marked).option("columnNameOfCorruptRecord", REJECTED).csv(path).filter(F.col(REJECTED).isNotNull())
    texts = T.StructType([T.StructField(f"t{i}", T.StringType()) for i in range(len(in_file))])
    bad = bad.withColumn("__texts", F.from_csv(REJECTED, texts.simpleString()[7:-1].replace(":", " ")))
    entries = [F.lit(None).cast("struct<name:string,value:string>")]
    for i, f in enumerate(in_file):
        if f.dataType != T.StringType():
            text = F.trim(F.col("__texts")[f"t{i}"])
            given = text.isNotNull() & ~text.isin("", "NA") & quoted(f.name).isNull()
            entries.append(F.when(given, F.struct(F.lit(f.name).alias("name"), text.alias("value"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return bad.select(F.col(REJECTED).alias("record"), F.inline(found))


def reject_counts(rejects: DataFrame, schema: T.StructType) -> DataFrame:
    """``(name, n)`` of unreadable entries for every column that is not text, those without any included."""
    names = [f.name for f in schema if f.dataType != T.StringType()]
    counts = rejects.agg(*[F.count_if(F.col("name") == n).alias(f"c{i}") for i, n in enumerate(names)])
    entries = [F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)]
    return counts.select(F.inline(F.array(*entries)))


def write_table_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV parts with a header, missing written as ``NA``."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def learn_levels(df: DataFrame, names: list[str], at_most: int = MOST_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of each factor, in one pass. A longer factor is an error."""
    if not names:
        return {}
    entries = [F.struct(F.lit(n).alias("name"), quoted(n).cast("string").alias("level")) for n in names]
    found = df.select(F.inline(F.array(*entries))).filter(F.col("level").isNotNull()).distinct()
    rows = found.limit(len(names) * at_most + 1).collect()
    levels = {n: sorted(r.level for r in rows if r.name == n) for n in names}
    long = [n for n, values in levels.items() if len(values) > at_most]
    if long or len(rows) > len(names) * at_most:
        raise ValueError(f"more than {at_most} levels: {long or names}")
    return levels


def save_snapshot(df: DataFrame, path: str, factors: list[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; the level list of each factor travels in the column's metadata."""
    for name, values in learn_levels(df, list(factors)).items():
        df = df.withMetadata(name, {**df.schema[name].metadata, LEVELS: values})
    df.write.mode(mode).parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int, factors: list[str] = ()) -> None:
    """A snapshot whose rows lie by ``key``: one sorted file for each of ``buckets``, so that tables with as many buckets join without a shuffle.

    A key that holds very many rows fills its bucket's file; household tables have one row per key.
    """
    for name, values in learn_levels(df, list(factors)).items():
        df = df.withMetadata(name, {**df.schema[name].metadata, LEVELS: values})
    table = f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, quoted(key)).write.bucketBy(buckets, key).sortBy(key)
    placed.option("path", path).saveAsTable(table)
    df.sparkSession.sql(f"DROP TABLE {table}")  # the files stay: a table with a path of its own


def load_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The snapshot with its layout, which a session has to be told."""
    plain = spark.read.parquet(path)
    table = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    df = spark.table(table)
    for f in plain.schema:
        if f.metadata:
            df = df.withMetadata(f.name, f.metadata)
    return df


def levels_of(df: DataFrame, name: str) -> list[str]:
    """Levels stored with a factor, in order; empty for a plain column."""
    return list(df.schema[name].metadata.get(LEVELS, []))


def save_coefficients(terms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    select_all_of(terms, ["term", "estimate"]).write.mode(mode).option("header", True).csv(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TERMS).option("header", True).csv(path)


def write_submission(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Exactly ``(id, pobre)`` with ``pobre`` as a whole number."""
    out = select_all_of(df, ["id", "pobre"]).withColumn("pobre", F.col("pobre").cast("int"))
    out.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_importance(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("Variable", "Importance").write.mode(mode).option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
