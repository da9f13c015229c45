"""Registered queries of this subpackage: each operator over its whole table, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.catalog.registry import query as register
from umbral.llm import oracles
from umbral.llm.brown import fit_brown, score
from umbral.llm.collocations import mine_phrases
from umbral.llm.decontaminate import decontaminate
from umbral.llm.html_tree import extract
from umbral.llm.importance import resample
from umbral.llm.language import fit_languages, identify
from umbral.llm.packing import pack_documents, public_packing
from umbral.llm.repetition import with_repetition
from umbral.llm.simhash import near_copies
from umbral.llm.spelling import Spelling, spelling_groups
from umbral.llm.text import small_batches
from umbral.llm.token_files import public_token_files, read_token_files, write_token_files
from umbral.llm.toxicity import fit_toxicity, with_toxicity
from umbral.llm.url_rules import ALLOW, BLOCK, ListedRule, judge, mine, with_listed_verdict
from umbral.session import drop_shuffles, scratch_path
from umbral.sources.views import read_table


def query(sql: str | None = None):
    """As the catalog's ``query``; texts go to Python in batches of few rows."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        register(sql)(run)
        return fn

    return add


@query(oracles.REPETITION)
def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules and the verdict by repetition coverage, for every document."""
    found = with_repetition(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of sequences of 2,048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), public_packing())


@query(oracles.DECONTAMINATION)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the least document its fingerprint reaches."""
    return near_copies(read_table(spark, sf_dir, "documents"))


def fold(parts: int):
    """Remainder of the CRC-32 of the document's number as text; -1 without a number."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(-1))


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(4) == 2)
    model = fit_languages(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by word classes, next to that by single words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (fold(10) == 0).alias("held_out"))
    drop_shuffles(spark)
    model, rare = fit_brown(docs.filter(~F.col("held_out")))
    return score(docs, model, rare, also=["held_out"])


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (fold(3) == 1).alias("held_out"))
    labels = read_table(spark, sf_dir, "labels").filter(fold(3) != 1)
    return with_toxicity(docs, fit_toxicity(docs, labels)).select("doc_id", "held_out", "score", "predicted")


@query()
def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether the sample takes it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample(docs, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "sample_value", "kept")


#: The listed rules of the URL query.
LISTED = [
    ListedRule("org", "/", ALLOW),
    ListedRule("example.org", "/es/", BLOCK),
    ListedRule("example.org", "/en/1", BLOCK),
    ListedRule("com", "/fr/", ALLOW),
    ListedRule("com", "/de/", BLOCK),
]


@query()
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page: listed rules, and rules mined from the pages these decide."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine(with_listed_verdict(pages, LISTED), "url", "label")
    return judge(pages, mined, LISTED).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")


@query()
def op1_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files of zstandard frames in order of its number, and read back from them."""
    folder = scratch_path(spark, "token-ids")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, public_token_files())
    return read_token_files(spark, folder)


@query(oracles.SPELLING)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words counted, its more frequent form and the root of its group."""
    return spelling_groups(read_table(spark, sf_dir, "documents"), Spelling(drop=199))


@query(oracles.PHRASES)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose words keep together most."""
    return mine_phrases(read_table(spark, sf_dir, "documents"))
