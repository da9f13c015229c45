"""Benchmark decontamination as a prefix-filtered set join over word windows.

A benchmark item is a set of windows (``window`` words in a row, the whole item if it is
shorter), a window a set of shingles (``shingle`` words in a row). A document holds a window only if it
holds all its shingles, so for containment 1 the necessary prefix of a window is a single
shingle, and the best one is the rarest. In steps:

1. count the benchmark's shingles in all documents (one scan; only counts are shuffled),
2. drop windows with a shingle that occurs nowhere, order each other window's shingles by
   rarity and keep the first with its place in the window,
3. find these prefix shingles in the documents (second scan), with the words around them,
4. join on the shingle, test that the window lies inside the document (positional and length bound),
   compare its words with the item's, and merge the hits of each document.

Scans test shingles against a bit map that is built from the benchmark in at most
``most_bits`` bits; what it lets through by chance is removed by the join, which compares words. So the
benchmark may have any size, and nothing but the bit map is broadcast.

Defined cases: a missing text has no words, cannot be hit and is not an item; items without an id count
as hits but not as items; items that share an id are one item; every input row gives one row, repeated ones too; empty tables give
no rows or no hits. Columns besides key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from umbral.llm.text import ALPHANUMERIC, U64, Tokens, rolling, slices, tokens, with_row_ids, within_texts
from umbral.session import scratch_path


@dataclass(frozen=True)
class Containment:
    window: int = 10
    shingle: int = 5
    bits_per_shingle: int = 256
    most_bits: int = 1 << 27

    def shingle_of(self, words: int) -> int:
        return min(self.shingle, words)


def shingle_hashes(t: Tokens, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words inside a text, as signed numbers."""
    at = np.flatnonzero(within_texts(t, size))
    return at, rolling(hashes, size)[at].view(np.int64)


class BitMap:
    """Two bits per hash in a fixed number of bits: never misses a member."""

    def __init__(self, log_bits: int, words: np.ndarray):
        self.log_bits, self.words = log_bits, words

    @staticmethod
    def slots(hashes, log_bits: int):
        """Spark's columns for the two bits of a hash."""
        mask = F.lit((1 << log_bits) - 1).cast("bigint")
        return [hashes.bitwiseAND(mask), F.shiftrightunsigned(hashes, 64 - log_bits).bitwiseAND(mask)]

    @classmethod
    def of(cls, df: DataFrame, name: str, how: Containment) -> BitMap:
        """Bit map of a hash column; what reaches the driver is at most ``most_bits`` bits, with an index per 64."""
        n = max(1, df.count())
        log_bits = int(np.clip(int(n * how.bits_per_shingle - 1).bit_length(), 16, how.most_bits.bit_length() - 1))
        slot = df.select(F.explode(F.array(*cls.slots(F.col(name), log_bits))).alias("slot"))
        word = slot.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
        )
        words = np.zeros(1 << (log_bits - 6), np.int64)
        found = word.toArrow().to_pandas()
        words[found["at"].to_numpy()] = found["bits"].to_numpy(np.int64)
        return cls(log_bits, words.view(U64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(U64)
        out = np.ones(len(h), bool)
        for slot in (h & U64((1 << self.log_bits) - 1), h >> U64(64 - self.log_bits)):
            out &= (self.words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
        return out


def _words(t: Tokens, low: int, high: int) -> str:
    return b" ".join([t.data[s:e].tobytes() for s, e in zip(t.start[low:high], t.end[low:high], strict=True)]).decode("utf-8", "replace")


def benchmark_windows(benchmark: DataFrame, item: str, text: str, how: Containment) -> DataFrame:
    """Distinct ``(words, size, shingles, item ids)`` of all items; a window that items share is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(low, high - low) for batch in batches for low, high in slices(batch.column(1))):
            t = tokens(batch.column(1), ALPHANUMERIC, lower=True)
            hashes, ids = t.hashes(), batch.column(0).to_pylist()
            rows = []
            for d in range(t.texts):
                low, high = t.first[d], t.first[d + 1]
                size = min(how.window, high - low)
                if size == 0:
                    continue
                step = how.shingle_of(size)
                grams = rolling(hashes[low:high], step).view(np.int64)
                for k in range(high - low - size + 1):
                    rows.append((ids[d], _words(t, low + k, low + k + size), int(size), grams[k : k + size - step + 1].tolist()))
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int32()), pa.array(d, pa.list_(pa.int64()))],
                    names=["item", "words", "size", "shingles"],
                )

    source = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string"))
    found = source.mapInArrow(run, "item string, words string, size int, shingles array<bigint>")
    return found.distinct()


def shingle_counts(docs: DataFrame, text: str, sizes: list[int], members: BitMap) -> DataFrame:
    """``(shingle, seen)`` over all documents, for shingles that pass the bit map."""
    shared = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (batch.column(0)[low:high] for batch in batches for low, high in slices(batch.column(0))):
            t = tokens(texts, ALPHANUMERIC, lower=True)
            hashes = t.hashes()
            for size in sizes:
                _, grams = shingle_hashes(t, hashes, size)
                found, n = np.unique(grams[shared.value.holds(grams)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["shingle", "n"])

    seen = docs.select(F.col(text).cast("string")).mapInArrow(run, "shingle bigint, n bigint")
    return seen.groupBy("shingle").agg(F.sum("n").alias("seen"))


def candidates(docs: DataFrame, key: str, text: str, sizes: list[int], members: BitMap, how: Containment) -> DataFrame:
    """One row per document: its word count and the prefix shingles found in it, with the words a window around each may take."""
    shared = docs.sparkSession.sparkContext.broadcast(members)
    found_type = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("around", pa.string())]))
    schema = StructType(
        StructType.fromDDL("row bigint, n_words bigint, found array<struct<shingle: bigint, at: int, low: int, around: string>>").fields
    )
    schema = StructType([StructField("key", docs.schema[key].dataType), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in (batch.slice(low, high - low) for batch in batches for low, high in slices(batch.column(1))):
            t = tokens(batch.column(1), ALPHANUMERIC, lower=True)
            hashes, counts, found = t.hashes(), t.counts(), [[] for _ in range(t.texts)]
            for size in sizes:
                at, grams = shingle_hashes(t, hashes, size)
                hit = shared.value.holds(grams)
                at, grams = at[hit], grams[hit]
                for i, h, d in zip(at.tolist(), grams.tolist(), (np.searchsorted(t.first, at, side="right") - 1).tolist(), strict=True):
                    low, high = max(t.first[d], i - how.window + size), min(t.first[d + 1], i + how.window)
                    if size < how.shingle:
                        low, high = i, i + size
                    found[d].append({"shingle": h, "at": i - int(t.first[d]), "low": int(low - t.first[d]), "around": _words(t, low, high)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + t.texts)), pa.array(counts), pa.array(found, found_type)],
                names=["key", "row", "n_words", "found"],
            )
            row += t.texts

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    how: Containment = Containment(),
) -> DataFrame:
    """One row per document: words, words hit by a benchmark window, and the items whose windows occur."""
    spark = docs.sparkSession
    # Benchmark windows, counts and candidates are read more than once: tables in the shared folder.
    path = scratch_path(spark, "windows")
    benchmark_windows(benchmark, item, item_text, how).write.parquet(path)
    items = spark.read.parquet(path)
    windows = items.select("words", "size", "shingles").distinct()
    steps = sorted({how.shingle_of(r[0]) for r in windows.select("size").distinct().collect()})

    grams = windows.select(F.explode("shingles").alias("shingle")).distinct()
    counts = shingle_counts(docs, text, steps, BitMap.of(grams, "shingle", how))
    counted = windows.select("words", "size", F.posexplode("shingles").alias("place", "shingle")).join(counts, "shingle", "left")
    rarest = counted.groupBy("words", "size").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "place", "shingle")).alias("first")
    )
    path = scratch_path(spark, "prefixes")
    rarest.filter("first.seen > 0").select("words", "size", "first.shingle", "first.place").write.parquet(path)
    prefixes = spark.read.parquet(path)

    path = scratch_path(spark, "candidates")
    members = BitMap.of(prefixes.select("shingle").distinct(), "shingle", how)
    candidates(docs, key, text, steps, members, how).write.parquet(path)
    rows = spark.read.parquet(path)

    found = rows.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    start = F.col("at") - F.col("place")
    words = F.array_join(F.slice(F.split("around", " ", -1), start - F.col("low") + 1, F.col("size")), " ")
    bounds = (start >= F.col("low")) & (start + F.col("size") <= F.col("n_words"))
    hits = (
        found.join(prefixes, "shingle")
        .filter(bounds)
        .filter(words == F.col("words"))
        .select("row", start.alias("start"), (start + F.col("size")).alias("stop"), "words")
    )
    path = scratch_path(spark, "hits")
    hits.write.parquet(path)
    hits = spark.read.parquet(path)

    order = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("stop").over(order), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), done))
    n_hit = hits.select("row", "start", "stop").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    by_item = hits.select("row", "words").distinct().join(items.select("words", "item"), "words").groupBy("row").agg(F.collect_set("item").alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return (
        rows.select("row", "key", "n_words")
        .join(n_hit, "row", "left")
        .join(by_item, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.size(ids).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def without_rows(rows: DataFrame, ids: list[str], gone: DataFrame) -> DataFrame:
    """``rows`` but those numbered in ``gone``. Only rows that a bit map of ``gone`` lets through are shuffled."""
    spark = rows.sparkSession
    members = spark.sparkContext.broadcast(BitMap.of(gone.select(F.xxhash64("row").alias("h")), "h", Containment(bits_per_shingle=32)))

    @F.arrow_udf("boolean")
    def perhaps(h: pa.Array) -> pa.Array:
        return pa.array(members.value.holds(h.to_numpy()))

    number = F.struct(*ids)
    stay = rows.filter(~perhaps(F.xxhash64(number)))
    tested = rows.filter(perhaps(F.xxhash64(number))).withColumn(f"{ids[-1]}_struct", number)
    tested = tested.join(gone.withColumnRenamed("row", f"{ids[-1]}_struct"), f"{ids[-1]}_struct", "left_anti").drop(f"{ids[-1]}_struct")
    return stay.unionByName(tested)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, how: Containment = Containment()) -> DataFrame:
    """Rows of ``docs`` whose own text is not contaminated; all columns stay, whatever their names. Rows are told apart by their number, keys may repeat or be missing."""
    rows, ids = with_row_ids(docs)
    texts = rows.select(F.struct(*ids).alias("row"), F.col("text"))
    path = scratch_path(docs.sparkSession, "gone")
    decontaminate(texts, benchmark, key="row", how=how).filter("contaminated").select("row").write.parquet(path)
    return without_rows(rows, ids, docs.sparkSession.read.parquet(path)).select(*[F.col(f"`{c}`") for c in docs.columns])
