"""Token ids in framed files: ids as the tokenizers library gives them, exact round trips, damage noticed."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ODD_TEXTS
from tokenizers import Tokenizer

from umbral.llm.frames import DamagedFile, FrameReader, FrameWriter
from umbral.llm.token_files import manifest, public_token_files, read_requested, read_token_files, write_token_files
from umbral.llm.word_ids import WordIds
from umbral.session import scratch_path

HOW = public_token_files()
PLAIN = Tokenizer.from_file(HOW.tokenizer)
WORDS = WordIds(HOW.tokenizer, most=50)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


SIGNS = ["<|endoftext|>", "</w>", "'s", "I'LL", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "̈", "Σ", "İ", "ß", "中", "½", "Ⅷ", "\x00", "9", "10", "a", "B", "word", "…", ".,", "<", "|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(SIGNS), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join), max_size=6))
def test_ids_are_those_of_the_library(texts):
    ids, edges = WORDS.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [plain(t) for t in texts]


def test_ids_of_whole_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ids, edges = WordIds(HOW.tokenizer).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [plain(t) for t in texts]


def written(documents, **options):
    out = io.BytesIO()
    writer = FrameWriter(out, **options)
    for key, ids in documents:
        writer.add(key, np.array(ids, np.uint32))
    writer.close()
    return out.getvalue()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 65535), max_size=40)), max_size=12), st.integers(1, 30), st.sampled_from([2, 4]))
def test_frames_give_back_what_went_in(documents, frame_ids, width):
    data = written(documents, width=width, frame_ids=frame_ids)
    assert [(k, ids.tolist()) for k, _, ids in FrameReader(io.BytesIO(data))] == documents
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(stream, f"<u{width}").tolist() == [i for _, ids in documents for i in ids]


def test_only_the_frames_of_a_document_are_read():
    reader = FrameReader(io.BytesIO(written([(k, [k] * 25) for k in range(40)], frame_ids=10)))
    assert reader.ids(16).tolist() == [16] * 25 and reader.frames_read == 3
    assert reader.ids(17).tolist() == [17] * 25 and reader.frames_read == 5


@pytest.mark.parametrize("at", [0, 5, 30, -1, -5, -12, -20, -60])
def test_damage_is_noticed(at):
    data = bytearray(written([(k, list(range(k, k + 50))) for k in range(10)], frame_ids=64))
    data[at] ^= 0x55
    with pytest.raises(DamagedFile):
        list(FrameReader(io.BytesIO(bytes(data))))
    with pytest.raises(DamagedFile):
        list(FrameReader(io.BytesIO(bytes(data[:-3]))))


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        written([(1, [70000])], width=2)


def test_odd_documents_in_order(llm, odd):
    folder = scratch_path(llm, "odd-ids")
    write_token_files(odd.repartition(3), folder, public_token_files(frame_ids=1000, batch_bytes=1))
    rows = sorted(read_token_files(llm, folder, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted([(i is None, i or 0, plain(t) + [2]) for i, t in ODD_TEXTS], key=lambda r: r[:2])
    assert [r.doc_id for r in rows] == [None if none else i for none, i, _ in want]
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((i, ids) for _, i, ids in want)
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])][:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in rows)
    asked = llm.createDataFrame([(11,), (11,), (12,), (999,), (None,)], "doc_id bigint")
    found = read_requested(llm, folder, asked).collect()
    assert sorted((r.doc_id or 0, r.start, r.ids) for r in found) == sorted((r.doc_id or 0, r.start, r.ids) for r in rows if r.doc_id in (11, 12, None))


def test_one_key_in_half_of_the_rows_goes_to_several_files(llm):
    df = llm.range(4000).selectExpr("if(id % 2 = 0, 7, id) AS doc_id", "repeat(concat('text ', id, ' '), 20) AS text").repartition(8)
    folder = scratch_path(llm, "hot-ids")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = write_token_files(df, folder, HOW).collect()
    finally:
        llm.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(line.n_docs for line in lines) == 4000 and max(line.n_docs for line in lines) < 1200
    keys = [r.doc_id for r in sorted(read_token_files(llm, folder).collect(), key=lambda r: r.start)]
    assert keys == sorted(keys) and len(keys) == 4000


def test_a_repeated_task_leaves_no_second_copy(llm):
    """Files are known by the manifest alone."""
    folder = scratch_path(llm, "twice")
    df = llm.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id bigint, text string")
    write_token_files(df, folder, HOW)
    stray = manifest(llm, folder).first().path.replace("ids-", "ids-stray-").removeprefix("file:")
    with open(stray, "wb") as out:
        out.write(b"what a lost task left")
    assert read_token_files(llm, folder).count() == 50
