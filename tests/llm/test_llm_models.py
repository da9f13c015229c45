"""Trained operators: contracts by brute force, quality on rows that were not learned from."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from odd_tables import LOWER, ODD_TEXTS, SPACED

import __spark_entry__ as entry
from pyspark.sql import functions as F
from umbral.llm.brown import Brown, Gains, fit_brown, likelihood, score
from umbral.llm.html_tree import Tree, main_texts, marginals, trained
from umbral.llm.importance import Importance, keep_sampled, kth_largest, resample, value_step
from umbral.llm.labelled_pages import labelled_pages, labels
from umbral.llm.language import LanguageFit, fit_languages, identify
from umbral.llm.toxicity import ToxicityFit, fit_label_model, fit_toxicity, with_toxicity


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def tables():
    sf = "/root/testdata/sf0.01"
    return sf, *[pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]


def base_score(texts, train):
    rows = [[*SPACED.findall((t or "").translate(LOWER)), None] for t in texts]
    counts = Counter(w for r, own in zip(rows, train, strict=True) if own for w in r)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(r), sum(counts[w] > 0 for w in r), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in r)) for r in rows]


@pytest.mark.parametrize("words", [3, 1 << 18])
def test_base_score_with_and_without_joined_counts(llm, odd, words):
    how = Brown(clustered=20, classes=4, rounds=2, broadcast_words=words)
    train = odd.filter("doc_id <> 4 or doc_id is null")
    model, rare = fit_brown(train, how=how)
    assert (rare.count() > 0) == (words == 3)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in score(odd, model, rare).collect())
    n, rows = base_score([t for _, t in ODD_TEXTS], [d != 4 for d, _ in ODD_TEXTS])
    want = sorted((d or 0, a, b, round(c, 6)) for (d, _), (a, b, c) in zip(ODD_TEXTS, rows, strict=True))
    assert np.allclose(got, want, atol=1e-5) and model.train_tokens == n


def test_scores_are_probabilities(llm):
    """Over all words and the unseen ones, what may follow any class sums to one; scores are products of these."""
    train = llm.createDataFrame([("a b a c",), ("b a d e",), ("a a b",)], "text string")
    how = Brown(clustered=3, classes=2, endings=4, rounds=2)
    model, rare = fit_brown(train, how=how)
    one = {w: llm.createDataFrame([(1, w)], "doc_id int, text string") for w in ["a", "b", "c", "d", "e", "zzz", ""]}
    assert rare.count() == 0 and score(one["d"], model, rare).first().n_known == 2
    f, end = 10**model.factor, how.all_classes - 1
    total = f[:, end] * model.texts
    for count, symbol, word in zip(model.frequent.counts, model.frequent.symbols, model.frequent.words, strict=True):
        assert symbol < 0 or count > 0
        if symbol >= 0:
            total += count * f[:, model.classes[symbol]]
    for e in range(how.endings):
        total += model.unseen[e] * f[:, how.classes + e]
    tails = 0.0
    for w in ("a", "b", "c", "d", "e"):
        found = score(one[w], model, rare).first().score
        if 10**found < 1:
            tails += 1
    seen = [c for c, s in zip(model.frequent.counts, model.frequent.symbols, strict=True) if s < 0]
    by_ending = {}
    for w in ("c", "d", "e", "b", "a"):
        from umbral.llm.brown import endings
        from umbral.llm.text import SPACED as BYTES
        from umbral.llm.text import tokens

        t = tokens(__import__("pyarrow").array([w]), BYTES, lower=True)
        place = {int(h): s for h, s in zip(model.frequent.words, model.frequent.symbols, strict=True)}
        if place[int(t.hashes().view(np.int64)[0])] < 0:
            by_ending.setdefault(int(endings(t, how)[0]), []).append(1 - how.discount)
    assert len(seen) == 2 and tails == 5
    for e, values in by_ending.items():
        total += sum(values) * f[:, how.classes + e]
    assert np.allclose(total, 1)


def test_exchange_raises_the_likelihood(llm):
    """Words that follow one another by kind end up in classes that say so."""
    rng = np.random.default_rng(0)
    kinds = [[f"{c}{k}" for k in range(6)] for c in "abc"]
    texts = [(" ".join(kinds[k % 3][rng.integers(6)] for k in range(60)),) for _ in range(30)]
    train = llm.createDataFrame(texts, "text string")
    frame = llm.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id int, text string")
    sums = []
    for rounds in (0, 3):
        model, rare = fit_brown(train, how=Brown(clustered=18, classes=3, rounds=rounds))
        sums.append(score(frame, model, rare).agg({"score": "sum"}).first()[0])
    assert sums[1] > sums[0] + 100


def test_brown_beats_single_words_on_held_out_texts(llm, tables):
    sf, docs, _ = tables
    frame = llm.read.parquet(f"{sf}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    model, rare = fit_brown(frame.filter(~held_out), how=Brown(clustered=1000, classes=16, rounds=2))
    got = score(frame.withColumn("held_out", held_out), model, rare, also=["held_out"]).toPandas()
    n, rows = base_score(docs.text, [remainder(d, 10) != 0 for d in docs.doc_id])
    want = {d: r for d, r in zip(docs.doc_id, rows, strict=True)}
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and abs(r.base_score - want[r.doc_id][2]) < 1e-6 * r.n_tokens
        assert r.held_out == (remainder(r.doc_id, 10) == 0) and r.train_tokens == n
    held = got[got.held_out]
    assert (held.score > held.base_score).mean() > 0.9


def test_gains_are_differences_of_the_likelihood():
    """Words in a class or still in that of their ending, also those that follow themselves or are frequent."""
    rng = np.random.default_rng(1)
    words, classes, extra = 12, 3, 2
    n = rng.integers(0, 4, (words, words)) + 30 * (rng.random((words, words)) < 0.1)
    now = rng.integers(0, classes + extra, words)

    def matrix(of):
        out = np.zeros((classes + extra,) * 2)
        np.add.at(out, (of[:, None], of[None, :]), n)
        return out

    m = matrix(now)
    own = np.diag(n).astype(float)
    apart = n - np.diag(np.diag(n))
    before, after = np.zeros((words, classes + extra)), np.zeros((words, classes + extra))
    for w in range(words):
        np.add.at(before[w], now, apart[:, w])
        np.add.at(after[w], now, apart[w])
    to, gain = Gains(m, classes).best(before, after, own, now)
    for w in range(words):
        found = [likelihood(matrix(np.where(np.arange(words) == w, k, now))) - likelihood(m) for k in range(classes)]
        assert gain[w] == pytest.approx(max(found), abs=1e-8) and found[to[w]] == pytest.approx(max(found), abs=1e-8)


def all_word_texts():
    rng = np.random.default_rng(5)
    return [" ".join(f"{'abc'[(k + j) % 3]}{int(60 * rng.random() ** 2)}" for j in range(40)) for k in range(40)]


@pytest.mark.parametrize("sent", [9, 1 << 18])
def test_every_training_word_is_clustered(llm, sent):
    """Rare words too, whether sent to tasks or joined; scores as written down word by word."""
    texts = all_word_texts()
    how = Brown(classes=3, endings=8, rounds=3, broadcast_words=sent, first_words=16, more_words=2, hot=5)
    model, rare = fit_brown(llm.createDataFrame([(t,) for t in texts], "text string"), how=how)
    counts = Counter(w for t in texts for w in t.split())
    assert len(model.frequent.words) + rare.count() == len(counts) and (rare.count() > 0) == (sent == 9)
    assert (model.classes[: len(counts)] < 3).all() and rare.filter("class >= 3").count() == 0
    ending = lambda w: (ord(w[-1]) + 31 * ord(w[-2])) % 8
    one = [*counts, "zz9", ""]
    scored = {r.doc_id: r for r in score(llm.createDataFrame(list(enumerate(one)), "doc_id int, text string"), model, rare).collect()}
    kind = {}
    f, end = 10**model.factor, how.classes + how.endings
    for k, w in enumerate(one[:-2]):  # the class of a word is the one its own text shows
        value, own = counts[w] - how.discount, 10 ** scored[k].score
        fits = [c for c in range(3) if math.isclose(own, f[end, c] * value * f[c, end] * model.texts, rel_tol=1e-9)]
        assert fits
        kind[w] = fits[0]
    total = sum((counts[w] - how.discount) * f[:, c] for w, c in kind.items()) + f[:, end] * model.texts
    total += sum(model.unseen[e] * f[:, how.classes + e] for e in range(8))
    assert np.allclose(total, 1)
    rng = np.random.default_rng(7)
    odd = [*texts[:5], "zz9 a1 a1 zz9 zz8", *(" ".join(rng.choice([*counts, "zz9"], 30)) for _ in range(5)), "", None]
    got = {r.doc_id: r.score for r in score(llm.createDataFrame(list(enumerate(odd)), "doc_id int, text string"), model, rare).collect()}
    for k, text in enumerate(odd):
        at, want = end, 0.0
        for w in (text or "").split():
            to = kind.get(w, how.classes + ending(w))
            want += math.log10(f[at, to] * (counts[w] - how.discount if w in counts else model.unseen[ending(w)]))
            at = to
        assert got[k] == pytest.approx(want + math.log10(f[at, end] * model.texts), rel=1e-9)
    # Words of one kind follow one another, so they share a class, rare ones too.
    share = sum(Counter(kind[w] for w in counts if w[0] == c).most_common(1)[0][1] for c in "abc") / len(counts)
    assert share > 0.9


def test_language_on_held_out_texts(llm, tables):
    sf, docs, _ = tables
    got = entry.queries()["op6_language"](llm, sf).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in docs.doc_id if remainder(d, 4) == 2}
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_of_odd_texts(llm, odd):
    pairs = [("the cat and the dog " * 3, "en"), ("le chat et le chien " * 3, "fr"), (None, "fr"), ("mots", None)]
    train = llm.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "doc_id bigint, text string, lang string")
    model = fit_languages(train, how=LanguageFit(words_per_language=50))
    rows = identify(odd, model).select("doc_id", "text", "lang_pred", "score", "kept").collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0) and r.kept == "text of kept"
    assert model.judge("le chien")[0] == "fr" and model.judge("dogs")[0] == "en" and model.judge("чч")[0] in ("en", "fr")
    assert fit_languages(train.limit(0)).judge("text") == ("und", 0.0)


def test_toxicity_on_held_out_texts(llm, tables):
    sf, docs, labelled = tables
    got = entry.queries()["op8_toxicity"](llm, sf).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labelled, on="doc_id")
    assert set(got[got.held_out].doc_id) == {d for d in docs.doc_id if remainder(d, 3) == 1}
    assert held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.75


def test_toxicity_of_odd_texts(llm, odd, odd_labels):
    for marks in (odd_labels, odd_labels.limit(0)):
        rows = with_toxicity(odd, fit_toxicity(odd, marks, how=ToxicityFit(least_texts=1))).select("doc_id", "score", "predicted", "kept").collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda hit, noise: np.where(y, rng.random(4000) < hit, rng.random(4000) < noise).astype(np.int8)
    good, weak = vote(0.8, 0.02), vote(0.4, 0.2)
    votes = np.stack([good, weak, weak, weak], axis=1)
    model, post = fit_label_model(votes, np.where(rng.random(4000) < 0.2, y, -1).astype(int), 25, 0.97)
    assert model.chances[1, 0, 2] > 0.55 and model.chances[0, 0, 2] < 0.1
    assert model.weights[1] < 0.5 < model.weights[0]
    assert ((post > 0.5) == y).mean() > 0.85


def test_importance_parts_good_from_bad(llm, tables):
    sf, docs, labelled = tables
    got = entry.queries()["op3_importance"](llm, sf).toPandas()
    assert len(got) == len(docs)
    both = got.merge(labelled, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.97 and both[both.quality == 0].kept.mean() < 0.1
    kept = got[got.kept]
    assert kept.sample_value.min() > got[~got.kept].sample_value.max()


def test_importance_of_odd_texts(llm, odd, odd_labels):
    for marks in (odd_labels, odd_labels.limit(0)):
        rows = resample(odd, marks, how=Importance(buckets=64)).collect()
        assert len(rows) == len(ODD_TEXTS) and all(math.isfinite(r.sample_value) for r in rows)
        assert keep_sampled(odd, marks).dtypes == odd.dtypes
    assert all(r.kept is True for r in rows)


def test_kth_largest(llm):
    values = [*np.random.default_rng(2).normal(0, 300, 500).tolist(), 5.0, 5.0, 5.0, -700.25]
    df = llm.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, len(values)):
        want = sorted(values)[-k]
        step = kth_largest(df, "v", k)
        assert df.filter(value_step(F.col("v")) >= step).count() == sum(v >= want for v in values)
    assert kth_largest(df, "v", 0) is None and kth_largest(df.limit(0), "v", 1) is None


def test_pages_the_model_has_not_seen():
    model, exact = trained(), 0
    pages = list(labelled_pages(100, seed=77))
    for html, _ in pages:
        tree = Tree(html)
        states = [labels(n, t) for n, t in zip(tree.names, tree.tags, strict=True)]
        for k in range(len(states)):
            states[k] = states[tree.parents[k]] if states[k] is None else states[k]
        want = "\n".join(text for node, text, _ in tree.blocks() if states[node] == 1)
        exact += main_texts([re.sub(r"\s?__[bcf]", "", html)], model) == [want]
    assert exact >= 95


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one<p>two", "one\ntwo"),
        ("<article><p>x</article><aside>no</aside><form>Name <input><p>y</p></form><footer>f</footer>", "x"),
        ("<article><h1>A&lt;b&gt;</h1><p>c \n d<br>e</p><script>x('<p>no</p>')</script><style>p{}</style><!-- no --></article>", "A<b>\nc d e"),
        ("<body><nav><a href=/>m</a></nav><main><h1>T</h1><ul><li>i<li>j</ul><div class='comments'><p>no</p></div></main><div id='cookie-notice'>no</div>", "T\ni\nj"),
    ],
)
def test_main_text_of_small_pages(html, text):
    assert main_texts([html], trained()) == [text]


def test_marginals_are_those_of_all_labellings():
    """Sum-product against summing over every labelling of a small tree."""
    from itertools import product

    from umbral.llm.html_tree import FRAME, forest

    tree = Tree("<div class='ad'><p>a</p></div><article>b<p>c</p></article>")
    f, _ = forest([(tree, tree.blocks())])
    model = trained()
    unary = f.x @ model.unary
    unary[f.spoken, FRAME] -= 30
    n, total = len(unary), np.zeros((len(unary), 3))
    for states in product(range(3), repeat=n):
        weight = sum(unary[k, s] for k, s in enumerate(states))
        weight += sum(model.move[f.groups[k], states[f.parents[k]], states[k]] for k in range(1, n))
        for k, s in enumerate(states):
            total[k, s] += math.exp(weight)
    assert np.allclose(marginals(f, model)[0], total / total.sum(axis=1, keepdims=True))


def test_likelihood_of_a_class_matrix():
    matrix = np.array([[3.0, 1.0], [0.0, 4.0]])
    want = sum(n * math.log(n / (matrix[i].sum() * matrix[:, j].sum())) for (i, j), n in np.ndenumerate(matrix) if n)
    assert likelihood(matrix) == pytest.approx(want)
