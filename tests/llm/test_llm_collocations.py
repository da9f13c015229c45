"""Phrases by brute force: counts, weakest cuts, dropped phrases, ranks; rounds that settle early."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import LOWER, ODD_TEXTS

from umbral.llm import collocations
from umbral.llm.collocations import Collocations, exact_score, folded, mine_phrases
from umbral.llm.text import rolling

PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^ \t]+")


def mined(rows, how):
    """``(lang, rank, phrase, a, l, r, n, score)`` from whole counts of all runs."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= how.least}
        longest = Counter()
        for p, a in phrases.items():
            for part in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longest[part] = max(longest[part], a)
        found = []
        for p, a in phrases.items():
            if 100 * longest[p] < how.inside_percent * a:
                score, k = min((how.scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[: how.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, n, words=14):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "ä", "x.y", "A\x1cB"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(0, 30)), p=weights / weights.sum()))
        if k % 3 == 0:
            text += " one fixed phrase of seven equal words\tand, one more"
        if k % 4 == 0:
            text += "\nOnce in a while; a a a a a"
        rows.append((text, [None, "en", "en", "en", "de", "und"][k % 6]))
    return rows


@pytest.mark.parametrize("how", [Collocations(top=6, least=2, widen=2), Collocations(top=3, least=3, inside_percent=30), Collocations(top=10_000, least=2)])
def test_phrases_by_brute_force(llm, how):
    rows = corpus(1, 120)
    found = mine_phrases(llm.createDataFrame(rows, "text string, lang string").repartition(3), how).collect()
    assert sorted(tuple(r) for r in found) == mined(rows, how)


def test_a_frontier_is_left_unexpanded(llm, monkeypatch):
    """A few best phrases settle without counting every run, and in few scans."""
    asked = []
    count = collocations.count_runs
    monkeypatch.setattr(collocations, "count_runs", lambda *a: asked.append(a) or count(*a))
    rows = corpus(2, 400, words=40)
    rows += [(f"rare{k % 9} pair{k % 9} w{k % 7}", "en") for k in range(360)]
    how = Collocations(top=4, least=5)
    df = llm.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in mine_phrases(df, how).collect()) == mined(rows, how)
    assert 2 <= len(asked) <= 6
    texts, _, frequent = asked[0][:3]
    every = count(texts, how, frequent).count()
    grown = sum(int(np.unpackbits(a[3].value.words.view(np.uint8)).sum()) for a in asked[1:] if len(a) > 3 and a[3] is not None)
    assert grown < every  # two bits for each pair that was expanded


def test_ties_beyond_the_top_are_ranked_by_their_bytes(llm):
    rows = [(f"{a}x {a}y", "en") for a in "zéaßbÿ中c" for _ in range(3)]
    how = Collocations(top=5, least=3)
    found = sorted(tuple(r) for r in mine_phrases(llm.createDataFrame(rows, "text string, lang string"), how).collect())
    assert found == mined(rows, how) and [r[2][0] for r in found] == ["a", "b", "c", "z", "ß"]


def test_odd_tables(llm, odd):
    how = Collocations(top=50, least=2)
    langs = [r.lang for r in odd.select("lang").collect()]
    rows = [(t, lang) for (_, t), lang in zip(ODD_TEXTS, langs, strict=True)]
    assert sorted(tuple(r) for r in mine_phrases(odd, how).collect()) == mined(rows, how)
    assert mine_phrases(odd.limit(0), how).collect() == []


def test_scores_beyond_64_bits_are_exact(llm):
    big = 9_000_000_000_000_000_000
    rows = [(big, big, big), (big - 1, big, big), (123_456_789_012_345_678, big, 7), (1, 1, 1), (2, 3, 4)]
    df = llm.createDataFrame(rows, "a bigint, l bigint, r bigint")
    total = "CAST(l AS DECIMAL(20, 0)) + r"
    assert [r[0] for r in df.select(exact_score("a", total, 2_000_000)).collect()] == [2_000_000 * a // (x + y) for a, x, y in rows]


def test_runs_have_one_hash_however_they_are_put_together():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    for size in (2, 3):
        assert (folded([h[k : len(h) - size + 1 + k] for k in range(size)]) == rolling(h, size)).all()
