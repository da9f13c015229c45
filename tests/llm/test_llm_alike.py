"""The pipeline's near copies and row decisions, by brute force."""

import os
import time

import numpy as np

import corpus_pipeline
from umbral.llm import alike, simhash
from umbral.llm.alike import Alike, one_of_each, parity_sketch
from umbral.llm.decontaminate import without_contaminated
from umbral.llm.simhash import Near, near_copies
from umbral.session import scratch_folder


def shingles(text, size=5):
    words = text.split()
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def changed(rng, words, times):
    out = list(words)
    for k in rng.integers(0, len(out), times):
        out[k] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def groups(texts, prints):
    """Of each text, the least place it is linked with by five-word similarity 0.8 or two bits of its fingerprint."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return group


def test_near_copies_stage_finds_five_word_copies(llm):
    rng = np.random.default_rng(3)
    hot = [f"hot{k}" for k in range(30)]
    texts = []
    for k in range(30):
        words = [f"w{rng.integers(5000)}" for _ in range(120)]
        texts += [" ".join(words), changed(rng, words, 2), changed(rng, words, 4), changed(rng, words, 9)]
        texts.append(" ".join([*hot, *[f"own{k}x{i}" for i in range(6)]]))  # share almost all of a prefix, some without being copies
    crowd = [f"c{k}" for k in range(200)]
    texts += [changed(rng, crowd, int(rng.integers(1, 5))) for _ in range(60)]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    prints = {r.doc_id: int(r.fingerprint, 16) for r in near_copies(df).collect()}
    want = {k for k, g in enumerate(groups(texts, prints)) if g == k}
    assert len(want) < len(texts) - 80
    assert {r.doc_id for r in corpus_pipeline.near_copies(llm, df, "").collect()} == want
    assert {r.doc_id for r in one_of_each(df, how=Alike(slots=2)).collect()} == want


def test_rows_are_decided_by_row_and_not_by_key(llm):
    item = "the quick brown fox jumps over the lazy dog while seven silent owls watch"
    rows = [(None, f"before {item} after"), (None, "a clean text without a number"), (7, f"{item} again"), (7, "a clean text under the same number"), (8, item)]
    bench = llm.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = llm.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.text for r in without_contaminated(docs, bench).collect()} == {rows[1][1], rows[3][1]}


def test_one_row_of_each_group_stays_whatever_the_keys(llm):
    rows = [(1, "same text here"), (1, "another text altogether"), (2, "another text altogether"), (3, "twice the same row"), (3, "twice the same row")]
    rows += [(None, "no number at all"), (None, "no number at all"), (None, "same text here"), (1, "")]
    kept = corpus_pipeline.near_copies(llm, llm.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, "same text here"), (1, "another text altogether"), (3, "twice the same row"), (0, "no number at all"), (1, "")])


def test_crowded_buckets_with_a_radius_of_one(llm):
    """4 - 6 - 7 - 3 is a chain of single bits, but 6 and 7 share no neighbour whose least value is one bit from both."""
    df = llm.createDataFrame([(v,) for v in (3, 4, 6, 7)], "value bigint")
    rows = simhash.components(simhash.links(df, Near(radius=1, bucket=3))).collect()
    assert {tuple(r) for r in rows} == {(3, 3), (4, 3), (6, 3), (7, 3)}


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, int(rng.integers(0, 300))).astype(np.uint64)
        y = np.unique(np.r_[x[: int(rng.integers(0, len(x) + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 40))).astype(np.uint64)])
        x = np.unique(x)
        apart = np.bitwise_xor(parity_sketch(x, 128), parity_sketch(y, 128)).view(np.uint64)
        assert int(np.bitwise_count(apart).sum()) <= len(np.setxor1d(x, y))


def test_texts_of_one_template_meet_no_more_than_their_number_grows(llm, monkeypatch):
    """Own words in a common frame, less alike than the bound: no pair is compared."""
    seen = []
    plain = alike.alike_pairs
    monkeypatch.setattr(alike, "alike_pairs", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    frame = [f"frame{k}" for k in range(100)]
    counts = []
    for n in (150, 300):
        texts = [" ".join([*frame[:30], f"a{i}", *frame[30:60], f"b{i}", *frame[60:90], f"c{i}", *frame[90:]]) for i in range(n)]
        df = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        seen.clear()
        assert one_of_each(df, how=Alike(near=Near(radius=0))).count() == n
        counts.append(sum(seen))
    assert counts[1] <= 2 * counts[0] + 50


def test_stages_take_clashing_names_and_files(llm, tmp_path):
    rows = [(k % 5, "a clean text of its own " + str(k % 4) * 9, k, "x", "y") for k in range(12)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, __row int, `__file` string, `a.b` string")
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    bench = llm.createDataFrame([(1, "of its own 222222222")], "item_id bigint, text string")
    for docs in (df, llm.read.parquet(str(tmp_path / "docs"))):
        kept = one_of_each(docs)
        assert kept.columns == docs.columns and kept.count() == 4
        clean = without_contaminated(docs, bench)
        assert clean.columns == docs.columns and {r.text[-9] for r in clean.collect()} == {"0", "1", "3"}
        assert one_of_each(docs.limit(0)).collect() == []


def test_components_keep_their_last_stars_only(llm):
    def stars():
        return {name for name in os.listdir(scratch_folder(llm).removeprefix("file:")) if name.startswith("stars-")}

    before = stars()
    chain = [(k, k + 1) for k in range(40)]
    found = simhash.components(llm.createDataFrame(chain, "a bigint, b bigint"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, 0) for k in range(41)}
    assert len(stars() - before) == 1


def test_shuffled_rows_of_a_stage_leave_the_disk(llm):
    files = llm._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    texts = [" ".join(f"w{(k // 3) * 50 + i}" for i in range(40 + k % 3)) for k in range(30)]
    before = shuffles()
    assert corpus_pipeline.near_copies(llm, llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "").count() == 10
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left
