"""Spelling variants by brute force: counts with dropped letters, pivots, near words, forms and roots."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_tables import LOWER, ODD_TEXTS

from umbral.llm.spelling import Spelling, count_words, crc32_on, near_words, pivotal, roots, spelling_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, how):
    out = Counter()
    for key, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if how.drop and h % how.drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= how.least_size:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= how.least_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words, ratio):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def variants(rng, n):
    """Words over few letters, so that prefixes, ties and repeated bigrams are common, and words one and two edits from them."""
    out = set()
    for _ in range(n):
        word = [rng.choice(list("abcéÿ")) for _ in range(rng.integers(6, 11))]
        out.add("".join(word))
        for _ in range(3):
            k = int(rng.integers(len(word)))
            word = word[:k] + ([], [rng.choice(list("abé"))], [word[k], rng.choice(list("ab"))])[int(rng.integers(3))] + word[k + 1 :]
            if len(word) >= 6:
                out.add("".join(word))
    return sorted(out)


def test_crc_of_spans():
    data = np.frombuffer("7:thé quick ".encode(), np.uint8)
    start, end = np.array([2, 2, 7]), np.array([6, 2, 12])
    seeds = np.array([zlib.crc32(b"7:"), zlib.crc32(b"x"), 0], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seeds, strict=True)]
    assert crc32_on(seeds, data, start, np.array([6, 3, 12])).tolist()[::2] == want[::2]


def test_pivots_are_the_cheapest_disjoint_pair_of_the_prefix():
    rng = np.random.default_rng(0)
    ranks = rng.integers(0, 6, (300, 7))
    cost = (ranks + 1) ** 2
    last, prefix, pivots = pivotal(ranks, cost)
    for r, c, end, inside, (a, b) in zip(ranks, cost, last, prefix, pivots, strict=True):
        assert end == sorted(r)[2] and inside.tolist() == [x <= end for x in r]
        pairs = [c[i] + c[j] for i, j in itertools.combinations(np.flatnonzero(inside), 2) if j - i >= 2]
        assert b - a >= 2 and inside[a] and inside[b] and c[a] + c[b] == min(pairs)


def test_near_words_by_brute_force(llm):
    words = variants(np.random.default_rng(1), 120)
    df = llm.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n bigint")
    found = [(r.a, r.n_a, r.b, r.n_b) for r in near_words(df).collect()]
    want = {(a, i, b, j) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if one_apart(a, b)}
    assert len(want) > 300 and len(found) == len(set(found)) and set(found) == want


def test_pairs_grow_with_the_near_words_only(llm):
    """Many words with the same begin and end, none of them near another."""
    words = [f"the{a}{b}{c}ing" for a, b, c in itertools.product("abcdefgh", "ijklmnop", "qrstuvwx")]
    words = [w for w in words if (ord(w[3]) + ord(w[4]) + ord(w[5])) % 8 == 0]
    df = llm.createDataFrame([(w, 9) for w in words], "word string, n bigint")
    assert near_words(df).collect() == []


@pytest.mark.parametrize("drop", [0, 3])
def test_groups_by_brute_force(llm, drop):
    how = Spelling(drop=drop, least_count=2, ratio=2)
    rng = np.random.default_rng(2)
    words = variants(rng, 25)
    weights = rng.pareto(0.7, len(words)) + 0.1
    rows = [(k if k % 9 else None, " ".join(rng.choice(words, 60, p=weights / weights.sum())).title() + " 12é") for k in range(40)] + ODD_TEXTS[:9] + ODD_TEXTS[11:]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    words = counted(rows, how)
    found = spelling_groups(df, how).collect()
    want = grouped(words, how.ratio)
    assert len(found) == len(want) and {tuple(r) for r in found} == want and len({r.root for r in found}) < len(words)
    assert any(r.form is not None and r.form != r.root for r in found)


def test_odd_tables(llm, odd):
    how = Spelling(least_count=1, least_size=4)
    assert {(r.word, r.n) for r in count_words(odd, how).collect()} == set(counted(ODD_TEXTS, how).items())
    assert spelling_groups(odd.limit(0)).collect() == []


def test_long_chains_end_at_their_root(llm):
    chain = [f"w{k:02d}" for k in range(40)]
    df = llm.createDataFrame(list(zip(chain[:-1], chain[1:], strict=True)), "word string, form string")
    assert {tuple(r) for r in roots(df).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_options_are_checked():
    for wrong in ({"least_size": 3}, {"ratio": 1}, {"least_count": 0}):
        with pytest.raises(ValueError):
            Spelling(**wrong)
