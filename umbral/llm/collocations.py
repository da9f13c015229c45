"""Phrases whose words keep together, mined best first.

A phrase of 2 to 4 words is scored by its weakest cut, ``floor(scale * a / (l + r))`` with ``a`` occurrences of the phrase, ``l`` of the part before the cut and
``r`` of the part behind it. It is dropped if a longer phrase of its words and others occurs ``inside_percent`` as often. Everything is per language.

Counting every run of up to four words would shuffle most of the corpus, so phrases grow. With ``a`` occurrences of a prefix and ``l`` of its first word, whatever continues
the prefix occurs at most ``a`` times and is cut after that first word too, so it scores at most ``scale * a / (l + a)``: the bound of the prefix. A round takes the
prefixes of the highest bounds from the frontier, and one scan of the texts counts all their continuations by one word on the right, which are
new prefixes, and on the left, which only say whether a phrase is dropped. What the cuts of a four-word phrase need and nobody has counted is asked for in the same
scan. A language is settled when no prefix left in its frontier has a bound that reaches the score of its ``top``-th phrase that stays, ties included. Words
that occur fewer than ``least`` times begin no prefix and are in no phrase.

Tasks send counts, added up before the shuffle. What they are sent are bit maps of fixed size (frequent words, prefixes to continue); what these let through by chance is counted
in whole as well and does no harm. Counts are known by the 64-bit hashes of their words; two frequent words with one hash are noticed and raise an error (take another ``seed``).

Defined cases: a missing text is empty; a missing language is ``und``; rows that repeat count again; keys and other columns are not read; an empty table, or one without
phrases, gives no rows; of ties the phrase that sorts first by its UTF-8 bytes has the better rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbral.llm.decontaminate import BitMap, Containment
from umbral.llm.text import U64, Tokens, byte_class, gathered, mix, rolling, slices, tokens
from umbral.session import scratch_path

#: Bytes that end a piece, and those that part its words: . , ; : ! ? and four line ends; space and tab.
SPLITTERS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_SPLITS = byte_class(lambda b: b in SPLITTERS)
_WORDS = byte_class(lambda b: b not in SPLITTERS and b not in BLANKS)
_STEP = U64(0x9E3779B97F4A7C15)
NO_LANGUAGE = "und"
W = ["w1", "w2", "w3", "w4"]


@dataclass(frozen=True)
class Collocations:
    """``top`` phrases of each language that occur ``least`` times; ``bits`` per prefix in the bit maps, up to ``most_bits``."""

    top: int = 2000
    least: int = 30
    inside_percent: int = 80
    scale: int = 2_000_000
    seed: int = 0
    bits: int = 64
    most_bits: int = 1 << 27
    widen: int = 8

    def bit_map(self, df: DataFrame, name: str) -> BitMap:
        return BitMap.of(df, name, Containment(bits_per_shingle=self.bits, most_bits=self.most_bits))


def folded(words: list[np.ndarray]) -> np.ndarray:
    """The hash ``rolling`` gives to these words in a row."""
    return mix(reduce(lambda out, w: out * _STEP + w, words, np.zeros(len(words[0]), U64)))


def gram_hash(names: list[str]) -> Column:
    """``folded`` as a column."""

    @F.arrow_udf("bigint")
    def run(*words: pa.Array) -> pa.Array:
        return pa.array(folded([w.to_numpy().view(U64) for w in words]).view(np.int64))

    return run(*names)


@dataclass
class _Words:
    """All words of a batch: hash (with the language), the piece each lies in, its text."""

    t: Tokens
    hashes: np.ndarray
    piece: np.ndarray
    owner: np.ndarray

    def runs(self, size: int) -> np.ndarray:
        """Which runs of ``size`` words, by first word, lie in one piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[len(self.piece) - n :]


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[_Words, list[str]]]:
    for batch in gathered(batches):
        for low, high in slices(batch.column(1)):
            langs = [NO_LANGUAGE if x is None else x for x in batch.column(0)[low:high].to_pylist()]
            code = {x: xxhash.xxh64_intdigest(x.encode(), seed) for x in set(langs)}
            t = tokens(batch.column(1)[low:high], _WORDS, lower=True)
            owner = t.owner()
            piece = np.cumsum(_SPLITS[t.data])[t.start] + owner if len(t.start) else owner
            yield _Words(t, mix(t.hashes() + np.array([code[x] for x in langs], U64)[owner]), piece, owner), langs


def count_words(texts: DataFrame, how: Collocations) -> DataFrame:
    """``(lang, u, word, n)`` of all words and their hashes; without a word, the number of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _words(batches, how.seed):
            different, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            spelled = [words.t.data[a:b].tobytes() for a, b in zip(words.t.start[first].tolist(), words.t.end[first].tolist(), strict=True)]
            totals = dict.fromkeys(langs, 0)
            for lang, k in zip(langs, words.t.counts().tolist(), strict=True):
                totals[lang] += k
            lang = [langs[d] for d in words.owner[first].tolist()] + list(totals)
            u = pa.concat_arrays([pa.array(different.view(np.int64)), pa.nulls(len(totals), pa.int64())])
            word = pa.concat_arrays([pa.array(spelled, pa.binary()).cast(pa.string()), pa.nulls(len(totals), pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), u, word, pa.array([*n.tolist(), *totals.values()], pa.int64())], names=["lang", "u", "word", "n"])

    return texts.mapInArrow(run, "lang string, u bigint, word string, n bigint").groupBy("lang", "u", "word").agg(F.sum("n").alias("n"))


def _counted(hashes: np.ndarray, at: np.ndarray, size: int) -> pa.RecordBatch:
    """How often each run of ``size`` words begins at the places ``at``."""
    table = pa.table([hashes[at + k].view(np.int64) for k in range(size)], names=W[:size])
    table = table.group_by(W[:size], use_threads=False).aggregate([([], "count_all")])
    rows = len(table)
    arrays = [table[w].combine_chunks() if w in W[:size] else pa.nulls(rows, pa.int64()) for w in W]
    return pa.RecordBatch.from_arrays([*arrays, table["count_all"].combine_chunks()], names=[*W, "n"])


def _both_sides(inside: np.ndarray, longer: int) -> np.ndarray:
    """Which of the runs one word longer begin or end with such a run."""
    return inside[:longer] | inside[1 : longer + 1]


def count_runs(texts: DataFrame, how: Collocations, frequent: Broadcast, two: Broadcast | None = None, three: Broadcast | None = None, asked: Broadcast | None = None) -> DataFrame:
    """``(w1, w2, w3, w4, n)`` of runs of frequent words that occur ``least`` times, each with its whole count.

    Without bit maps all pairs; else runs of three that begin or end with one of ``two`` or are ``asked`` for, and of four that begin or end with one of ``three``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def among(members: Broadcast | None, h: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), bool)
            if members is not None:
                places = np.flatnonzero(at)
                out[places] = members.value.holds(folded([h[places + k] for k in range(size)]))
            return out

        for words, _ in _words(batches, how.seed):
            h = words.hashes
            known = frequent.value.holds(h)
            fit = {}
            for size in (2, 3, 4):
                n = max(0, len(h) - size + 1)
                fit[size] = words.runs(size) & np.logical_and.reduce([known[k : k + n] for k in range(size)])
            if two is None and three is None and asked is None:
                emitted = {2: fit[2]}
            else:
                pairs, triples = among(two, h, 2, fit[2]), among(three, h, 3, fit[3])
                emitted = {3: fit[3] & (_both_sides(pairs, len(fit[3])) | among(asked, h, 3, fit[3])), 4: fit[4] & _both_sides(triples, len(fit[4]))}
            for size, where in emitted.items():
                at = np.flatnonzero(where)
                if len(at):
                    yield _counted(h, at, size)

    schema = ", ".join(f"{w} bigint" for w in W) + ", n bigint"
    return texts.mapInArrow(run, schema).groupBy(*W).agg(F.sum("n").alias("n")).filter(F.col("n") >= how.least)


def exact_score(a: str, total: str, scale: int) -> Column:
    """``floor(scale * a / total)`` in decimals, which hold products beyond 64 bits."""
    return F.expr(f"CAST({scale} * CAST({a} AS DECIMAL(20, 0)) div CAST({total} AS DECIMAL(21, 0)) AS BIGINT)")


def _weakest(cuts: list[tuple[str, str]], scale: int) -> Column:
    """The lowest score of all cuts with its parts; of ties the first cut."""
    each = [F.struct(exact_score("a", f"CAST({left} AS DECIMAL(20, 0)) + {right}", scale).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)]
    return F.array_min(F.array(*each))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def score_pairs(pairs: DataFrame, words: DataFrame, how: Collocations) -> DataFrame:
    """All pairs with ``f1`` and ``f2`` of their words, score and bound."""
    one, two = _renamed(words, w1="u", lang="lang", f1="n"), _renamed(words, w2="u", f2="n")
    out = pairs.select("w1", "w2", F.col("n").alias("a")).join(one, "w1").join(two, "w2").withColumn("cut", _weakest([("f1", "f2")], how.scale))
    return out.withColumn("bound", exact_score("a", "f1 + a", how.scale))


def score_triples(runs: DataFrame, pairs: DataFrame, how: Collocations) -> DataFrame:
    """Runs of three with the counts of all their parts, score and bound."""
    head = _renamed(pairs, w1="w1", w2="w2", lang="lang", f1="f1", f12="a")
    tail = _renamed(pairs, w2="w1", w3="w2", f23="a", f3="f2")
    out = runs.filter("w3 IS NOT NULL AND w4 IS NULL").select("w1", "w2", "w3", F.col("n").alias("a")).distinct()
    out = out.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).withColumn("cut", _weakest([("f1", "f23"), ("f12", "f3")], how.scale))
    return out.withColumn("bound", exact_score("a", "f1 + a", how.scale))


def score_fours(runs: DataFrame, triples: DataFrame, how: Collocations) -> DataFrame:
    """Runs of four whose first three words are known as a run; without a score where the last three are not."""
    head = _renamed(triples, w1="w1", w2="w2", w3="w3", lang="lang", f1="f1", f12="f12", f123="a")
    tail = _renamed(triples, w2="w1", w3="w2", w4="w3", f234="a", f34="f23", f4="f3")
    out = runs.filter("w4 IS NOT NULL").select(*W, F.col("n").alias("a")).distinct()
    out = out.join(head, W[:3]).join(tail, W[1:], "left").withColumn("bound", exact_score("a", "f1 + a", how.scale))
    return out.withColumn("cut", F.when(F.col("f234").isNotNull(), _weakest([("f1", "f234"), ("f12", "f34"), ("f123", "f4")], how.scale)))


def _longest_inside(longer: DataFrame, size: int) -> DataFrame:
    """For every run of ``size`` words at the begin or the end of a longer one, the most frequent of these."""
    low, high = [longer.select(*[F.col(W[k + shift]).alias(W[k]) for k in range(size)], F.col("a").alias("longer")) for shift in (0, 1)]
    return low.unionByName(high).groupBy(*W[:size]).agg(F.max("longer").alias("longer"))


def _nodes(scored: DataFrame, longer: DataFrame | None, grown: DataFrame | None, size: int, how: Collocations) -> DataFrame:
    """Phrases in one form: which are in the frontier still, and which are dropped (as far as is known)."""
    out = scored
    if longer is not None:
        out = out.join(_longest_inside(longer, size), W[:size], "left")
    dropped = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * how.inside_percent if longer is not None else F.lit(False)
    if size == 4:
        out = out.withColumn("grown", F.lit(True))
    elif grown is None:
        out = out.withColumn("grown", F.lit(False))
    else:
        out = out.join(grown.select(*W[:size], F.lit(True).alias("grown")), W[:size], "left")
    words = [F.col(w) if k < size else F.lit(None).cast("bigint").alias(w) for k, w in enumerate(W)]
    return out.select("lang", *words, F.lit(size).alias("size"), "a", "bound", "cut.score", "cut.l", "cut.r", F.coalesce("grown", F.lit(False)).alias("grown"), F.coalesce(dropped, F.lit(False)).alias("dropped"))


def _nth_score(df: DataFrame, n: int, name: str) -> DataFrame:
    """``(lang, name)``: the score of each language's ``n``-th best row, 0 where there are fewer. Rows are counted by score first (at most ``scale / 2 + 1`` of them)."""
    counts = df.groupBy("lang", "score").count()
    before = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return counts.withColumn("seen", before).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("seen") >= n, F.col("score"))), F.lit(0)).alias(name))


def _reaching(df: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """Rows whose bound reaches their language's limit (none: 0)."""
    return df.join(F.broadcast(limits), "lang", "left").filter(F.col("bound") >= F.coalesce(name, F.lit(0)))


def grow(texts: DataFrame, words: DataFrame, how: Collocations) -> DataFrame:
    """The phrases that stay and reach their language's ``top``-th score, ties included. ``words`` are the frequent ones."""
    spark = texts.sparkSession

    def shared(df: DataFrame, name: str) -> Broadcast:
        return spark.sparkContext.broadcast(how.bit_map(df, name))

    def prefixes(df: DataFrame, size: int, shift: int = 0) -> Broadcast | None:
        some = df.select(gram_hash(W[shift : shift + size]).alias("h")).distinct()
        return None if some.isEmpty() else shared(some, "h")

    frequent = shared(words, "u")
    pairs = _stored(score_pairs(_stored(count_runs(texts, how, frequent), "pairs"), words, how), "scored-pairs")
    runs = grown = limits = None
    look = 2 * how.top
    while True:
        if runs is None:
            nodes = _nodes(pairs, None, None, 2, how)
        else:
            triples = _stored(score_triples(runs, pairs, how), "scored-triples")
            fours = _stored(score_fours(runs, triples, how), "scored-fours")
            four_counts = runs.filter("w4 IS NOT NULL").select(*W, F.col("n").alias("a"))
            nodes = _nodes(pairs, runs.filter("w4 IS NULL").select(*W, F.col("n").alias("a")), grown.filter("w3 IS NULL"), 2, how)
            nodes = nodes.unionByName(_nodes(triples, four_counts, grown.filter("w3 IS NOT NULL"), 3, how)).unionByName(_nodes(fours, None, None, 4, how))
            nodes = _reaching(nodes, limits, "limit").drop("limit")
        nodes = _stored(nodes, "nodes")
        limits = _stored(_nth_score(nodes.filter("grown AND NOT dropped AND score IS NOT NULL"), how.top, "limit"), "limits")
        open_nodes = _reaching(nodes.filter("NOT grown OR score IS NULL"), limits, "limit")
        far = _nth_score(nodes.filter("NOT dropped AND score IS NOT NULL"), look, "far")
        best = open_nodes.groupBy("lang").agg(F.max("bound").alias("best"))
        turn = far.join(best, "lang", "right").select("lang", F.least(F.coalesce("far", F.lit(0)), "best").alias("turn"))
        now = _stored(_reaching(open_nodes.drop("limit"), turn, "turn"), "turn")
        if now.isEmpty():
            return nodes.filter("NOT dropped AND score IS NOT NULL").join(F.broadcast(limits), "lang").filter("score >= limit").drop("limit")
        extended = now.filter("NOT grown").select(*W[:3])
        found = count_runs(
            texts, how, frequent,
            prefixes(extended.filter("w3 IS NULL"), 2), prefixes(extended.filter("w3 IS NOT NULL"), 3), prefixes(now.filter("size = 4"), 3, 1),
        )
        found = _stored(found, "runs")
        runs = found if runs is None else _stored(runs.unionByName(found).distinct(), "runs")
        grown = extended if grown is None else grown.unionByName(extended)
        look *= how.widen


def mine_phrases(df: DataFrame, how: Collocations = Collocations(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``rank`` from 1, ``phrase`` (joined by spaces), ``a``, ``l``, ``r``, ``n`` (all words of the language) and ``score``."""
    texts = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = count_words(texts, how).filter((F.col("n") >= how.least) | F.col("word").isNull())
    counts = _stored(counts, "words")
    words = counts.filter("word IS NOT NULL")
    if not words.groupBy("u").count().filter("count > 1").isEmpty():
        raise RuntimeError("two frequent words have the same hash: take another seed")
    found = grow(texts, words, how)
    for w in W:
        found = found.join(words.select(F.col("u").alias(w), F.col("word").alias(f"{w}_word")), w, "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *[f"{w}_word" for w in W]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.top)
    totals = counts.filter("word IS NULL").select("lang", "n")
    return found.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
