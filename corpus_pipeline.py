"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept and applies one operator of ``umbral.llm`` with production settings;
its decisions take effect. All but the last return the columns of ``documents``; packing returns pieces of sequences.
No SQL states these stages (hashes, learned weights, components, a tokenizer), so ``ORACLE_SQL`` is None and the tests compare
every stage with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbral.llm.alike import one_of_each
from umbral.llm.decontaminate import without_contaminated
from umbral.llm.importance import keep_sampled
from umbral.llm.packing import pack_documents, public_packing
from umbral.llm.repetition import keep_unrepeated
from umbral.llm.text import small_batches
from umbral.session import apply_settings, drop_shuffles, scratch_path
from umbral.sources.views import read_table

ORACLE_SQL = None


def ready(spark: SparkSession) -> None:
    """Settings of every stage: texts go to Python in few rows, joins split hot keys, and shuffled rows leave the disk when their query ends."""
    small_batches(drop_shuffles(apply_settings(spark)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition rules."""
    ready(spark)
    return keep_unrepeated(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the importance sample takes; the target is what ``labels`` calls good."""
    ready(spark)
    return keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least number of every group of near copies, by fingerprints or by five-word shingles."""
    ready(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ready(spark)
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of sequences of 2,048 tokens."""
    ready(spark)
    return pack_documents(docs, public_packing())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass; tables between stages lie in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
