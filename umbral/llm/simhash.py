"""SimHash near copies by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits agree in ``blocks - radius`` of ``blocks`` equal parts,
so every such choice of parts is a key and only fingerprints with a common key are compared. A key's
fingerprints lie as vertical bit planes, 64 of them to a machine word. Comparing one fingerprint with a word
adds the differing bits of plane after plane into carry-save counters, all 64 distances at once;
words in which every distance is above the radius are left early.

Keys that more than ``bucket`` different fingerprints share are not compared: their fingerprints each give out
all values one bit away (and themselves), and two of them that share such a value differ in at most 2 bits, so groups
cannot exceed 65. This is exact as well, for a radius up to 2.

Exact copies share a fingerprint and are one point from the start, so links are among different fingerprints only; each
bucket gives the edges of a spanning forest, not its pairs. Components come from alternating large and small stars over tables
in the shared folder.

Defined cases: a text without words has fingerprint zero and links like any other; a missing text is empty; keys may repeat or be
missing: every input row gives one row, and a component without any key has none; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.llm.text import SPACED, U64, Tokens, joined_words, slices, tokens
from umbral.session import drop_path, scratch_path

BITS = 64


@dataclass(frozen=True)
class Near:
    """``shingle`` words per feature, ``radius`` differing bits at most."""

    shingle: int = 3
    seed: int = 42
    radius: int = 2
    blocks: int = 4
    bucket: int = 1024

    def __post_init__(self):
        if not 0 <= self.radius <= 2 or self.blocks <= self.radius or BITS % self.blocks:
            raise ValueError("radius must be 0, 1 or 2 and below blocks, which must divide 64")


def _fingerprints(t: Tokens, how: Near) -> np.ndarray:
    joined, begin, end = joined_words(t)
    raw = joined.tobytes()
    counts = t.counts()
    grams = np.where(counts > 0, np.maximum(1, counts - how.shingle + 1), 0)
    edges = np.r_[0, np.cumsum(grams)]
    first = np.arange(edges[-1]) - np.repeat(edges[:-1], grams) + np.repeat(t.first[:-1], grams)
    last = np.minimum(first + how.shingle, np.repeat(t.first[1:], grams)) - 1
    digest, seed = xxhash.xxh64_intdigest, how.seed
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)), U64, len(first))
    out = np.zeros(t.texts, U64)
    some = np.flatnonzero(grams)
    for b in range(BITS):
        ones = np.r_[0, np.cumsum((hashes >> U64(b)) & U64(1), dtype=np.int64)]
        out[some] |= (2 * (ones[edges[some + 1]] - ones[edges[some]]) > grams[some]).astype(U64) << U64(b)
    return out


def fingerprint(text: Column | str, how: Near = Near()) -> Column:
    """The 64-bit fingerprint of each text, as a signed number."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        parts = [_fingerprints(tokens(texts[a:b], SPACED, lower=True), how) for a, b in slices(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return run.asNondeterministic()(text)


def bucket_keys(value: Column, how: Near) -> Column:
    """An array of ``(table, key)``: the value's bits at every choice of parts that must agree."""
    width = BITS // how.blocks
    keys = []
    for table, parts in enumerate(combinations(range(how.blocks), how.blocks - how.radius)):
        mask = sum(((1 << width) - 1) << (width * p) for p in parts)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(table).alias("table"), value.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose carry-save count is above the radius."""
    above, same = over.copy(), ~np.zeros_like(over)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            above |= same & counters[k]
            same &= ~counters[k]
    return above


def close_pairs(values: np.ndarray, edges: np.ndarray, radius: int, planes_per_look: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values of one bucket that differ in at most ``radius`` bits; bucket b is ``edges[b]:edges[b + 1]``.

    Lanes of a word are 64 neighbours of one bucket. The unit of work is one value against one word.
    """
    size = np.diff(edges)
    words = -(-size // 64)
    base = np.r_[0, np.cumsum(words)]
    place = np.arange(len(values)) - np.repeat(edges[:-1], size)
    word = np.repeat(base[:-1], size) + place // 64
    lane = (place % 64).astype(U64)
    starts = np.flatnonzero(np.r_[True, np.diff(word) > 0])
    planes = np.empty((BITS, base[-1]), U64)
    for b in range(BITS):
        planes[b] = np.bitwise_or.reduceat(((values >> U64(b)) & U64(1)) << lane, starts)
    valid = np.bitwise_or.reduceat(U64(1) << lane, starts)

    # Value i meets its own word (later lanes only) and every later word of its bucket.
    ahead = np.repeat(base[1:], size) - word
    query = np.repeat(np.arange(len(values)), ahead)
    target = np.arange(len(query)) - np.repeat(np.cumsum(ahead) - ahead, ahead) + word[query]
    live = valid[target]
    own = target == word[query]
    live[own] &= ~U64(0) << lane[query[own]] << U64(1)
    some = live != 0
    query, target, live = query[some], target[some], live[some]

    counters = [np.zeros(len(query), U64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(query), U64)
    bits = values[query]
    for b in range(BITS):
        carry = planes[b][target] ^ (U64(0) - ((bits >> U64(b)) & U64(1)))
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if b % planes_per_look == planes_per_look - 1:
            live &= ~_exceeds(counters, over, radius)
            some = live != 0
            if not some.all():
                query, target, live, over, bits = query[some], target[some], live[some], over[some], bits[some]
                counters = [c[some] for c in counters]
            if not len(query):
                break
    left, right = [], []
    first_of_word = starts[target] if len(target) else target
    for k in range(64):
        hit = np.flatnonzero((live >> U64(k)) & U64(1))
        left.append(query[hit])
        right.append(first_of_word[hit] + k)
    return np.concatenate(left), np.concatenate(right)


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position each of ``n`` positions is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(values: np.ndarray, edges: np.ndarray, how: Near) -> tuple[np.ndarray, np.ndarray]:
    left, right = close_pairs(values, edges, how.radius)
    label = spanning(len(values), left, right)
    joined = np.flatnonzero(label != np.arange(len(values)))
    return values[joined], values[label[joined]]


def _bucket_links(members: DataFrame, how: Near) -> DataFrame:
    """Links inside buckets of at most ``bucket`` values; rows of a bucket arrive one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table, key, value):
            edges = np.r_[0, np.flatnonzero((np.diff(key) != 0) | (np.diff(table) != 0)) + 1, len(key)]
            a, b = _forest(value.view(U64), edges, how)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            table, key, _ = held
            changes = np.flatnonzero((np.diff(key) != 0) | (np.diff(table) != 0))
            if len(changes):
                whole = changes[-1] + 1
                yield links(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    rows = members.select("table", "key", "value")
    return rows.repartition("table", "key").sortWithinPartitions("table", "key", "value").mapInArrow(run, "a bigint, b bigint")


def _flip_links(values: DataFrame, radius: int) -> DataFrame:
    """Links of values at most two bits apart, through the values one bit away from both; up to one bit, values that are one bit away themselves."""
    near = F.concat(F.array("value"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k))))
    spread = values.select("value", F.explode(near).alias("between"))
    if radius < 2:
        other = values.select(F.col("value").alias("between"))
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        return spread.join(other, "between").filter("value > between").select(F.col("value").alias("a"), F.col("between").alias("b")).filter(apart)
    heads = spread.groupBy("between").agg(F.min("value").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return spread.join(heads, "between").filter("value != head").select(F.col("value").alias("a"), F.col("head").alias("b")).distinct()


def links(values: DataFrame, how: Near) -> DataFrame:
    """Edges ``(a, b)`` among distinct ``value``s whose components are those of all links within the radius."""
    spark = values.sparkSession
    keyed = values.select(F.explode(bucket_keys(F.col("value"), how)).alias("k"), "value").select("k.*", "value")
    shared = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    path = scratch_path(spark, "buckets")
    keyed.join(shared, ["table", "key"]).write.parquet(path)
    members = spark.read.parquet(path)
    small = _bucket_links(members.filter(F.col("n") <= how.bucket), how)
    large = _flip_links(members.filter(F.col("n") > how.bucket).select("value").distinct(), how.radius)
    return small.unionByName(large)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link; the root is the least node of its component.

    Alternates large-star and small-star steps until the edges are stars. A step is one aggregate
    with map-side combine and one join that is split where a node has very many links.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, tuple, str]:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        df = spark.read.parquet(path)
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, tuple(row), path

    def ordered(df: DataFrame) -> DataFrame:
        return df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large_star(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        return ordered(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))

    def small_star(df: DataFrame) -> DataFrame:
        least = df.groupBy("a").agg(F.min("b").alias("least"))
        pulled = df.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return ordered(pulled.unionByName(least.select("a", F.col("least").alias("b"))))

    now, mark, path = stored(ordered(edges))
    while mark[0]:
        new, new_mark, new_path = stored(small_star(large_star(now)))
        if new_mark == mark:
            drop_path(spark, new_path)
            break
        drop_path(spark, path)
        now, mark, path = new, new_mark, new_path
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", how: Near = Near()) -> DataFrame:
    """One row per row of ``df``: key, ``fingerprint`` and ``component_id``, the least key its fingerprint reaches."""
    spark = df.sparkSession
    path = scratch_path(spark, "fingerprints")
    df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).select(
        "__key", fingerprint(F.col("__text"), how).alias("value")
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    path = scratch_path(spark, "distinct")
    rows.groupBy("value").agg(F.min("__key").alias("least")).write.parquet(path)
    distinct = spark.read.parquet(path)
    roots = components(links(distinct.select("value"), how)).withColumnRenamed("node", "value")
    linked = distinct.join(roots, "value")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    path = scratch_path(spark, "classes")
    classes = linked.select("value", "root").join(least, "root").select("value", "component")
    distinct.join(classes, "value", "left").select("value", F.coalesce("component", "least").alias("component")).write.parquet(path)
    classes = spark.read.parquet(path)
    return rows.join(classes, "value").select(
        F.col("__key").alias(key),
        F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", how: Near = Near()) -> DataFrame:
    """Rows of ``df`` whose key is the least of its group of near copies; all columns stay.

    Of rows that repeat a key all stay or go, and rows without a key stay.
    """
    found = near_copies(df, key, text, how)
    gone = found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct()
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")
