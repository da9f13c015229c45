"""Repetition rules, fingerprints, windows, pieces and URLs against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from odd_tables import LOWER, ODD_TEXTS, SPACED

from umbral.llm import simhash
from umbral.llm.decontaminate import Containment, decontaminate, without_contaminated
from umbral.llm.packing import assign, encode, pack_documents, public_packing
from umbral.llm.repetition import keep_unrepeated, with_repetition
from umbral.llm.simhash import Near, first_of_each, near_copies
from umbral.llm.url_rules import ALLOW, BLOCK, Index, ListedRule, MinedRule, Mining, judge, mine, url_tokens, with_listed_verdict


def base_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def dropped_by_coverage(text):
    words = SPACED.findall(text or "")
    total = sum(map(len, words))
    for n, limit in ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)):
        seen, inside = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k : k + n])
            inside.update(range(k, k + n) if gram in seen else ())
            seen.add(gram)
        if sum(len(words[k]) for k in inside) > limit * total:
            return True
    seen, chars = set(), 0
    for line in (text or "").split("\n"):
        own = SPACED.findall(line)
        chars += sum(map(len, own)) if own and line in seen else 0
        seen.add(line)
    return chars > 0.2 * total


def test_repetition_counts_and_verdict(odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = with_repetition(odd).select("text", *names, "base_failed", "kept").collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        want = base_counts(r.text)
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed and not dropped_by_coverage(r.text))


def test_repetition_verdict_on_documents(llm, sf):
    rows = with_repetition(llm.read.parquet(f"{sf}/documents.parquet")).select("text", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    for r in rows:
        want = base_counts(r.text)
        assert (r.n_dup_lines, r.n_repeat_words) == want[3:]
        assert r.kept == (not r.base_failed and not dropped_by_coverage(r.text))
    assert 0.6 < np.mean([r.kept for r in rows]) < 1


def test_keep_unrepeated_keeps_columns(odd):
    kept = keep_unrepeated(odd)
    assert kept.dtypes == odd.dtypes and {r.kept for r in kept.collect()} <= {"text of kept"}


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def test_fingerprints_and_components(odd):
    rows = near_copies(odd).collect()
    texts = ODD_TEXTS
    prints = [fingerprint(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((d for (d, _), h in zip(texts, group) if h == g and d is not None), default=None) for g in group}
    want = Counter((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(texts, prints, group))
    assert Counter(map(tuple, rows)) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes_find_every_close_pair(radius):
    rng = np.random.default_rng(radius)
    sizes = [1, 2, 63, 64, 65, 200]
    values = np.concatenate([near(rng, n) for n in sizes])
    edges = np.r_[0, np.cumsum(sizes)]
    a, b = simhash.close_pairs(values, edges, radius)
    want = {
        (i, j)
        for k in range(len(sizes))
        for i in range(edges[k], edges[k + 1])
        for j in range(i + 1, edges[k + 1])
        if int(values[i] ^ values[j]).bit_count() <= radius
    }
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def near(rng, n):
    """Values within a few bits of one another."""
    out = np.full(n, rng.integers(0, 1 << 63, dtype=np.uint64))
    for _ in range(3):
        out ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return out


@pytest.mark.parametrize("bucket", [3, 1024])
def test_components_do_not_depend_on_the_bucket_bound(llm, bucket):
    rng = np.random.default_rng(5)
    values = np.unique(np.concatenate([near(rng, 150), near(rng, 40), rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
    signed = values.view(np.int64)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2]
    label = simhash.spanning(len(values), *(np.array(x) for x in zip(*pairs, strict=True)))
    groups = defaultdict(set)
    for k, g in enumerate(label):
        groups[g].add(int(signed[k]))
    df = llm.createDataFrame([(int(x),) for x in signed], "value bigint")
    found = defaultdict(set)
    for node, root in simhash.components(simhash.links(df, Near(bucket=bucket))).collect():
        found[root].add(node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_first_of_each_keeps_columns_and_one_of_a_group(odd):
    kept = first_of_each(odd)
    assert kept.dtypes == odd.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert 8 in ids and 9 not in ids and ids.count(12) == 2 and None in ids


WORD7 = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hit_counts(text, items):
    words = WORD7.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for i, t in items:
        own = WORD7.findall((t or "").translate(LOWER))
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else ()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                ids.add(i)
    ids = sorted(str(i) for i in ids if i is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_decontamination(odd, odd_benchmark):
    items = [tuple(r) for r in odd_benchmark.collect()]
    want = Counter((d, *hit_counts(t, items)) for d, t in ODD_TEXTS)
    assert Counter(map(tuple, decontaminate(odd, odd_benchmark).collect())) == want
    # Few bits let almost every shingle through; the join still compares words.
    loose = Containment(bits_per_shingle=1, most_bits=1 << 16)
    assert Counter(map(tuple, decontaminate(odd, odd_benchmark, how=loose).collect())) == want
    kept = without_contaminated(odd, odd_benchmark)
    gone = {r[0] for r in want if r[-1]}
    assert kept.dtypes == odd.dtypes and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in ODD_TEXTS if d not in gone)


def test_packing_round_trip(odd):
    how = public_packing()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(how.tokenizer)
    rows = pack_documents(odd.filter("doc_id is null or doc_id not in (11, 12)"), how, with_ids=True).collect()
    texts = {d: t for d, t in ODD_TEXTS if d not in (11, 12)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = [x for r in pieces for x in r.ids]
        assert ids == [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    repeated = pack_documents(odd.filter("doc_id in (12)"), how).collect()
    assert [r.doc_tokens for r in repeated] == [repeated[0].doc_tokens] * len(repeated) and sum(r.length for r in repeated) == 2 * repeated[0].doc_tokens


def test_assign_fills_and_balances():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 900).tolist()
    rooms = [2048] * (sum(lengths) // 2048)
    placed, rest = assign(lengths, rooms, 1.0, 1 / 2048)
    assert all(sum(n for _, _, n in p) == 2048 for p in placed)
    assert sum(n for _, _, n in rest) == sum(lengths) - sum(rooms)
    cost = [sum(n + n * n / 2048 for _, _, n in p) for p in placed]
    in_order = np.array_split(np.arange(900), len(rooms))
    plain = [sum(lengths[k] + lengths[k] ** 2 / 2048 for k in part) for part in in_order]
    assert np.std(cost) < 0.5 * np.std(plain)


def test_encoders_agree():
    how = public_packing()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(how.tokenizer)
    rng = np.random.default_rng(3)
    signs = list(" \n\t'sreéß²½１٣中　\x85\x1c​😀_-.<>#09aZ")
    for _ in range(500):
        text = "".join(rng.choice(signs, rng.integers(0, 40)))
        assert encode(text, how).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


LISTED = [ListedRule("org", "/", ALLOW), ListedRule("example.org", "/es/", BLOCK), ListedRule("example.org", "/en/1", BLOCK), ListedRule("com", "/fr/", ALLOW), ListedRule("com", "/de/", BLOCK)]
URLS = {
    "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", BLOCK),
    "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", BLOCK),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", ALLOW),
    "https://example.org": ("example.org", "", None, None),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", ALLOW),
    "https://x.com/de/1": ("x.com", "/de/1", "com/de/", BLOCK),
    "https://x.com?u=http://y.org/": ("x.com", "", None, None),
    "HTTP://X.com:80/de/": ("x.com:80", "/de/", None, None),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    "://h#x": ("h", "", None, None),
    None: ("", "", None, None),
}


def test_listed_rules_and_default(llm):
    df = llm.createDataFrame([(k, u, "old") for k, u in enumerate(URLS)], "page_id bigint, url string, host string")
    rows = {r.url: r for r in judge(df, [], LISTED).collect()}
    for u, (host, path, rule, verdict) in URLS.items():
        assert (rows[u].host, rows[u].path, rows[u].rule, rows[u].verdict) == (host, path, rule, verdict or ALLOW)
    assert mine(with_listed_verdict(df.limit(0), LISTED), "url", "label") == []


def test_mined_rules_are_those_of_all_combinations(llm):
    """Every small combination of tokens, counted by hand, against what is mined."""
    from itertools import combinations

    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        bad = rng.random() < 0.3
        rows.append((f"http://{'win' if bad and rng.random() < 0.9 else 'abc'}.com/{'bet' if bad else rng.choice(['news', 'bet'])}", BLOCK if bad else ALLOW))
    how = Mining(support=0.05, confidence=0.9)
    rules = mine(llm.createDataFrame(rows, "url string, verdict string"), "url", "verdict", how)
    sets = [(url_tokens(u), v) for u, v in rows]
    found = {}
    for size in (1, 2, 3):
        for c in {c for t, _ in sets for c in combinations(sorted(t), size)}:
            n = Counter(v for t, v in sets if set(c) <= t)
            for v, m in n.items():
                if m >= how.support * len(rows) and m >= how.confidence * sum(n.values()):
                    found[frozenset(c), v] = m / sum(n.values())
    assert rules and all(abs(found[r.tokens, r.verdict] - r.confidence) < 1e-9 for r in rules if len(r.tokens) <= 3)
    # Every combination found by hand is said at least as surely by a kept rule.
    assert all(any(r.verdict == v and r.tokens <= c and r.confidence >= f - 1e-9 for r in rules) for (c, v), f in found.items())
    index = Index(rules)
    for u, _ in rows:
        fits = [r for r in rules if r.tokens <= url_tokens(u)]
        assert index.decide(u) == (min(fits, key=MinedRule.order) if fits else None)
