"""Registered queries: SQL where there is one, odd and empty tables, and the pipeline stage by stage."""

import os

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
import corpus_pipeline
from umbral.session import scratch_path

NAMES = [n for n in entry.queries() if n[:2] == "op" and n[2].isdigit()]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_same_rows_as_sql(llm, name):
    sf = "/root/testdata/sf0.01"
    assert differences(entry.queries()[name](llm, sf), connect(sf), entry.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def empty_folder(llm, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        llm.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(os.path.join(folder, f"{name}.parquet"))
    return folder


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_empty_tables(llm, empty_folder, name):
    assert entry.queries()[name](llm, empty_folder).collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op1_html_tree", "op5_url_rules", "op9_packing", "op12_spelling", "op13_collocations")])
def test_odd_tables_give_a_row_for_each_row(llm, odd, odd_folder, name):
    assert entry.queries()[name](llm, odd_folder).count() == odd.count()


def test_pipeline_stages(llm, odd_folder):
    """Each stage takes what its predecessor wrote, returns its columns, and adds no row."""
    docs = llm.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, n = docs.dtypes, docs.count()
        path = scratch_path(llm, name)
        stage(llm, docs, odd_folder).write.parquet(path)
        docs = llm.read.parquet(path)
        if name != "packing":
            assert docs.dtypes == before and docs.count() <= n
    assert "sequence_id" in docs.columns


def test_pipeline_drops_by_each_operator(llm):
    sf = "/root/testdata/sf0.01"
    docs = llm.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas().doc_id
    q = entry.queries()
    rules = q["op10_repetition"](llm, sf).toPandas().set_index("doc_id").kept
    hits = q["op7_decontamination"](llm, sf).toPandas().set_index("doc_id").contaminated
    left = set(corpus_pipeline.run(llm, sf).select("doc_id").distinct().toPandas().doc_id)
    assert left and all(rules[d] and not hits[d] for d in left) and len(left) < len(docs)
