"""Groups of spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered from rare to frequent over all words. Its prefix is the three rarest (and every further place of the third one's
bigram); its pivots are two disjoint places of the prefix whose bigrams are rarest together, chosen by dynamic programming from left to right. One
edit touches at most one of two disjoint bigrams, so of two near words the one whose prefix ends earlier in the order has a pivot that the other
holds in its prefix. The edit then lies to the right of that bigram, and all up to its end is equal in both words, or to
the left, and all from its begin is. These position limits are the key: a pivot with all that lies on one side of it meets prefix bigrams
with the same, in words as long or one longer or shorter. What meets is compared.

Steps: count words (one scan, equal words become one in every task before the shuffle), count bigrams (the alphabet bounds them:
``ALPHABET`` squared, which is all that tasks are sent), join pivots with prefixes, take each word's most frequent near word as its form
if that is ``ratio`` times as frequent, and follow forms to their root by doubling the steps (a chain multiplies its counts by ``ratio``, so it is short).

Defined cases: a missing text has no words; a missing key counts as the empty text where words are dropped by key; rows that repeat count again; ties of form go to the
smallest word in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.llm.text import LOWER, gathered, text_bytes
from umbral.session import scratch_path

#: Letters of words: a to z, and U+00C0 to U+00FF, which are two bytes with this first one.
ALPHABET, _LEAD = 26 + 64, 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Spelling:
    """Words of at least ``least_size`` letters and ``least_count`` occurrences; a form is at least ``ratio`` times as frequent.

    ``drop`` (none if 0) takes one letter out of the runs whose CRC-32 together with their document's key it divides.
    """

    least_size: int = 6
    least_count: int = 5
    ratio: int = 5
    drop: int = 0

    def __post_init__(self):
        if self.least_size < 4 or self.ratio < 2 or self.least_count < 1:
            raise ValueError("words need at least 4 letters (three bigrams) and one occurrence, and forms must be more frequent")


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte alone, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def crc32_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]``, going on from the CRC-32 of what comes before it."""
    out = ~state.astype(np.uint32)
    left, at = np.arange(len(start)), start.copy()
    while len(left):
        old = out[left]
        out[left] = _CRC[(old ^ data[at]) & 0xFF] ^ (old >> 8)
        at += 1
        more = at < end[left]
        left, at = left[more], at[more]
    return ~out


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A to Z lowered, begin and end of each maximal run of letters, and the first run of each text (one more entry at the end)."""
    data, edges = text_bytes(texts)
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    cuts = np.zeros(len(data) + 1, bool)
    cuts[edges] = True
    before, after = np.r_[False, inside[:-1]][: len(data)], np.r_[inside[1:], False][: len(data)]
    start = np.flatnonzero(inside & (~before | cuts[:-1]))
    return LOWER[data], start, np.flatnonzero(inside & (~after | cuts[1:])) + 1, np.searchsorted(start, edges)


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    edges = np.r_[0, np.cumsum(size)]
    source = np.arange(edges[-1]) + np.repeat(start - edges[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[source])])


def batch_words(keys: list, texts: pa.Array, how: Spelling) -> pa.Array:
    """The words of a batch, repeats included, that are long enough."""
    data, start, end, first = letter_runs(texts)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    size = points[end] - points[start]
    long = np.flatnonzero(size >= how.least_size)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))[long]
    start, end, size = start[long], end[long], size[long]
    if not how.drop:
        return _spans(data, start, end)
    seeds = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
    crc = crc32_on(seeds[owner], data, start, end)
    dropped = crc % how.drop == 0
    changed = []
    for k in np.flatnonzero(dropped & (size > how.least_size)).tolist():
        run, at = data[start[k] : end[k]].tobytes().decode(), int(crc[k]) % int(size[k])
        changed.append((run[:at] + run[at + 1 :]).encode())
    return pa.concat_arrays([_spans(data, start[~dropped], end[~dropped]), pa.array(changed, pa.large_binary())])


def count_words(df: DataFrame, how: Spelling, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of all words with at least ``least_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            found = pc.value_counts(batch_words(batch.column(0).to_pylist(), batch.column(1), how))
            if len(found):
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.large_string()).cast(pa.string()), found.field(1)], names=["word", "n"])

    seen = df.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, "word string, n bigint")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= how.least_count)


def gram_order(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Place in the order from rare to frequent, and frequency, of each bigram; both by the code points of its letters."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2))))
    found = words.select(gram.alias("gram")).groupBy("gram").count().orderBy("count", "gram").toArrow()
    order, counts = np.full((256, 256), -1, np.int32), np.zeros((256, 256), np.int64)
    if found.num_rows > ALPHABET**2:
        raise ValueError("words hold other letters than their alphabet has")
    for place, (gram, n) in enumerate(zip(found["gram"].to_pylist(), found["count"].to_pylist(), strict=True)):
        order[ord(gram[0]), ord(gram[1])], counts[ord(gram[0]), ord(gram[1])] = place, n
    return order, counts


def pivotal(ranks: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length: the rank at which the prefix ends, which places belong to it, and the two pivots.

    Going from left to right, the best pair that ends at a place is that place and the cheapest one at least two places before it.
    """
    last = np.partition(ranks, 2, axis=1)[:, 2]
    prefix = ranks <= last[:, None]
    far = np.iinfo(np.int64).max // 4
    cost = np.where(prefix, cost, far)
    n, places = cost.shape
    rows = np.arange(n)
    single, pair = np.zeros(n, np.int64), np.full(n, 2 * far)
    pivots = np.zeros((n, 2), np.int64)
    for k in range(2, places):
        better = cost[rows, k - 2] < cost[rows, single]
        single[better] = k - 2
        total = cost[rows, single] + cost[:, k]
        better = total < pair
        pair[better], pivots[better] = total[better], np.stack([single, np.full(n, k)], 1)[better]
    return last, prefix, pivots


def with_grams(words: DataFrame) -> DataFrame:
    """``(word, n, size, last, places, pivots)``: where the prefix lies in the order and in the word, and its pivots."""
    order, counts = gram_order(words)
    shared = words.sparkSession.sparkContext.broadcast((order, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, counts = shared.value
        for batch in batches:
            spelled = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            sizes = np.array([len(w) for w in spelled])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                letters = np.frombuffer(b"".join(spelled[k] for k in at), np.uint8).reshape(len(at), size)
                a, b = letters[:, :-1], letters[:, 1:]
                last, prefix, pivots = pivotal(order[a, b], counts[a, b])
                places = pa.ListArray.from_arrays(np.r_[0, np.cumsum(prefix.sum(1))].astype(np.int32), np.nonzero(prefix)[1].astype(np.int32))
                both = pa.ListArray.from_arrays(np.arange(0, 2 * len(at) + 1, 2, dtype=np.int32), pivots.ravel().astype(np.int32))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(at), size, np.int32)), pa.array(last), places, both],
                    names=["word", "n", "size", "last", "places", "pivots"],
                )

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, size int, last int, places array<int>, pivots array<int>")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def near_words(words: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)`` for every two words of ``(word, n)`` that differ by one inserted, deleted or replaced code point, once each."""
    grams = with_grams(words)

    def sides(place):
        """The bigram with all before it, and with all behind it."""
        return F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), place + 2)), F.concat(F.lit(">"), F.substring("word", place + 1, F.col("size"))))

    held = grams.select("word", "n", "size", "last", F.explode("places").alias("place"))
    held = held.select(F.explode(sides(F.col("place"))).alias("key"), F.col("size"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"))
    asked = grams.select("word", "n", "size", "last", F.explode("pivots").alias("place"))
    asked = asked.select("word", "n", "last", "size", F.explode(sides(F.col("place"))).alias("key"))
    asked = asked.select("key", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"))
    met = asked.join(held, ["key", "size"]).filter("a != b AND last_a <= last_b").filter(F.levenshtein("a", "b", 1) == 1)
    swapped = F.col("a") > F.col("b")
    one, other = F.struct("a", "n_a"), F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"))
    met = met.select(F.when(swapped, other).otherwise(one).alias("x"), F.when(swapped, one).otherwise(other).alias("y"))
    return met.select(F.col("x.a").alias("a"), F.col("x.n_a").alias("n_a"), F.col("y.a").alias("b"), F.col("y.n_a").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word that has a form: the last form on its way, by doubling the steps."""
    now = _stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = _stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if new.filter("moved").isEmpty():
            return now
        now = new.select("word", "root")


def spelling_groups(df: DataFrame, how: Spelling = Spelling(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``n``, ``n_near``, its ``form`` with ``form_n`` (null if none) and the ``root`` of its group."""
    words = _stored(count_words(df, how, key, text), "words")
    near = _stored(near_words(words), "near-words")
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    both = both.unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    frequent = -F.col("best.n") >= F.col("n") * how.ratio
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n"),
    )
    found = _stored(found, "forms")
    root = roots(found.filter("form is not null"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
