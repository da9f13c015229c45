"""One document of every group of near copies: SimHash links and exact set similarity of word shingles.

Two texts are near copies if their fingerprints differ in at most ``near.radius`` bits, or if the Jaccard similarity of their sets
of ``shingle`` words in a row is at least ``alike`` percent; groups are the components of these links. The second kind is an exact
set-similarity join. A text's shingles are ordered from rare to frequent. Of two sets that are alike, ``m <= n`` shingles large, the first common shingle is
among the first ``n - ceil(alike * n / 100) + 1`` of the larger one and among the first ``m - ceil(2 * alike * m / (100 + alike)) + 1`` of the
smaller one, which is about half as many. So only these few shingles of a set wait for larger sets (as heads), and texts from one template that are less alike
than that never meet. In steps:

1. number every row by its place in its file and choose one row of each set; later scans skip all other rows by a bit map,
2. count shingles in ``slots`` counters (these only order them, so collisions cost time and no links),
3. find the prefix shingles that two sets share, one of them as a head; keep the sets that have one,
4. compare every set with one head of each of its buckets, then with eight times as many heads a round, until no bucket with heads left holds sets of two
   groups; buckets of up to ``small_bucket`` sets are compared at once. A bucket whose sets are all of one group is done, so a large group of copies costs few
   comparisons for each of its sets.

Length and place of the shared shingle bound the overlap, and so does a parity sketch of each set: a bit says whether an odd number of its shingles have that
slot, so two sets differ in at least as many shingles as their sketches in bits. What is left is compared on the whole sets, and only the sets it needs are
shuffled. Shingles are known by 64-bit hashes; a text
of fewer words is one shingle.

Defined cases: a missing text is empty; texts without words are near copies of one another (their fingerprint is zero); rows without a key come last in their group, ties of the key
go to the first row; repeated rows are one group; an empty table gives no rows; all columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.llm.decontaminate import BitMap, Containment, without_rows
from umbral.llm.simhash import Near, components, fingerprint, links
from umbral.llm.text import SPACED, U64, Tokens, mix, rolling, slices, tokens, with_row_ids
from umbral.session import drop_path, scratch_path


@dataclass(frozen=True)
class Alike:
    """``alike`` percent of all shingles of two texts are in both."""

    shingle: int = 5
    alike: int = 80
    slots: int = 1 << 20
    sketch_bits: int = 512
    small_bucket: int = 16
    near: Near = Near()

    def prefix(self, n):
        """How many of ``n`` shingles, from the rarest, may hold the first that is shared with an alike smaller set."""
        return n - -(-self.alike * n // 100) + 1

    def head_prefix(self, n):
        """The same for an alike set that is not smaller."""
        return n - -(-2 * self.alike * n // (100 + self.alike)) + 1


def shingle_sets(t: Tokens, how: Alike) -> list[np.ndarray]:
    """The distinct shingles of each text in order of their hashes."""
    hashes, edges = t.hashes(), t.first.tolist()
    return [np.unique(rolling(hashes[a:b], min(how.shingle, b - a))) if b > a else hashes[:0] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _set_number(grams: np.ndarray) -> int | None:
    """The same for equal sets; none for the empty one."""
    return int(mix(np.array([mix(grams).sum(dtype=U64) + U64(len(grams))]))[0].view(np.int64)) if len(grams) else None


def parity_sketch(grams: np.ndarray, bits: int) -> np.ndarray:
    """Which slots an odd number of the shingles have, 64 slots to a number."""
    odd = np.bincount((grams >> U64(32)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], how: Alike, chosen: Broadcast) -> Iterator[list[np.ndarray]]:
    """Shingle sets of the texts (second column) whose row (first column) is chosen."""
    for batch in batches:
        texts = batch.column(1).filter(pa.array(chosen.value.holds(batch.column(0).to_numpy())))
        for low, high in slices(texts):
            yield shingle_sets(tokens(texts[low:high], SPACED, lower=True), how)


def set_number(text: Column | str, how: Alike) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        parts = [shingle_sets(tokens(texts[a:b], SPACED, lower=True), how) for a, b in slices(texts)]
        return pa.array([_set_number(g) for part in parts for g in part], pa.int64())

    return run.asNondeterministic()(text)


def slot_counts(texts: DataFrame, how: Alike, chosen: Broadcast) -> np.ndarray:
    """How many texts have a shingle of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.slots, np.int64)
        for sets in _sets(batches, how, chosen):
            if sets:
                total += np.bincount((np.concatenate(sets) % U64(how.slots)).astype(np.int64), minlength=how.slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])

    found = texts.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(how.slots, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _prefix(grams: np.ndarray, counts: np.ndarray, how: Alike) -> np.ndarray:
    """The rarest shingles of a set, as many as its prefix has."""
    seen = counts[(grams % U64(how.slots)).astype(np.int64)]
    return grams[np.lexsort((grams, seen))[: how.prefix(len(grams))]].view(np.int64)


class _Tables:
    """Tables of one run in the shared folder, which go when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.last = spark, [], {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def replaced(self, df: DataFrame, name: str) -> DataFrame:
        """The same in place of the table of this name of the round before, which nothing reads any more."""
        new = self.stored(df, name)
        if name in self.last:
            drop_path(self.spark, self.last[name])
            self.paths.remove(self.last[name])
        self.last[name] = self.paths[-1]
        return new

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths, self.last = [], {}


def candidate_sets(texts: DataFrame, how: Alike, chosen: Broadcast, tables: _Tables) -> DataFrame:
    """``(set, n, shingles, prefix, places, sketch)`` of every chosen set that shares a prefix shingle with another set (and of few more)."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(slot_counts(texts, how, chosen))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets(batches, how, chosen):
            own = [(_set_number(g), _prefix(g, shared.value, how), how.head_prefix(len(g))) for g in sets if len(g)]
            if own:
                size = np.array([len(p) for _, p, _ in own])
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                head = place < np.repeat(np.array([h for _, _, h in own]), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p for _, p, _ in own])), pa.array(np.repeat(np.array([s for s, _, _ in own]), size)), pa.array(head)],
                    names=["shingle", "set", "head"],
                )

    each = texts.mapInArrow(prefixes, "shingle bigint, set bigint, head boolean").groupBy("shingle")
    each = each.agg(F.min("set").alias("low"), F.max("set").alias("high"), F.max("head").alias("head"))
    found = tables.stored(each.filter("low < high AND head").select("shingle"), "shared-shingles")
    members = spark.sparkContext.broadcast(BitMap.of(found, "shingle", Containment()))

    def with_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets(batches, how, chosen):
            rows = []
            for g in sets:
                prefix = _prefix(g, shared.value, how) if len(g) else g.view(np.int64)
                places = np.flatnonzero(members.value.holds(prefix))
                if len(places):
                    rows.append((_set_number(g), len(g), g.view(np.int64), prefix[places], places.astype(np.int32), parity_sketch(g, how.sketch_bits)))
            if rows:
                long, whole = pa.list_(pa.int64()), pa.list_(pa.int32())
                kinds = {"set": pa.int64(), "n": pa.int32(), "shingles": long, "prefix": long, "places": whole, "sketch": long}
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    kind = "set bigint, n int, shingles array<bigint>, prefix array<bigint>, places array<int>, sketch array<bigint>"
    return tables.stored(texts.mapInArrow(with_hits, kind), "candidate-sets")


def alike_pairs(pairs: DataFrame, sets: DataFrame, how: Alike, tables: _Tables) -> DataFrame:
    """The ``(a, b)`` whose whole sets are alike."""
    x, y = (sets.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    close = apart * (100 + how.alike) <= (F.col("n_a") + F.col("n_b")) * (100 - how.alike)
    left = tables.replaced(pairs.join(x, "a").join(y, "b").filter(close).select("a", "b"), "close-pairs")
    if left.isEmpty():
        return left
    asked = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    members = sets.sparkSession.sparkContext.broadcast(BitMap.of(asked, "set", Containment(bits_per_shingle=64)))

    @F.arrow_udf("boolean")
    def needed(number: pa.Array) -> pa.Array:
        return pa.array(members.value.holds(number.to_numpy()))

    whole = sets.filter(needed(F.col("set")))
    x, y = (whole.select(F.col("set").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return left.join(x, "a").join(y, "b").filter(both * 100 >= (F.size("x") + F.size("y") - both) * how.alike).select("a", "b")


def alike_groups(sets: DataFrame, group: DataFrame, how: Alike, tables: _Tables) -> DataFrame:
    """``(node, root)`` over groups: which of the groups that ``group`` gives every ``set`` are one by their shingles."""
    live = sets.select("set", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p"))
    head_prefix = F.col("n") - F.ceil(F.lit(2 * how.alike) * F.col("n") / F.lit(100 + how.alike)) + 1
    live = live.select(F.col("p.prefix").alias("shingle"), "set", "n", F.col("p.places").alias("place"), (F.col("p.places") < head_prefix).alias("head"))
    group = tables.stored(group.join(sets.select("set").distinct(), "set", "left_semi").select("set", F.col("group").alias("first")), "candidate-groups")
    roots = tested = found = None
    heads = 1
    while True:
        now = group if roots is None else group.join(roots, group["first"] == roots["node"], "left")
        now = now.select("set", F.col("first") if roots is None else F.coalesce("root", "first").alias("first")).withColumnRenamed("first", "group")
        here = tables.replaced(live.join(now, "set"), "placed-members")
        mixed = here.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("head").alias("head"), F.count(F.lit(1)).alias("size"))
        here = tables.replaced(here.join(mixed.filter("low < high AND head").select("shingle", "size"), "shingle"), "members")
        if here.isEmpty():
            break
        slots = F.when(F.col("size") <= how.small_bucket, F.greatest(F.lit(heads), F.lit(how.small_bucket**2))).otherwise(F.lit(heads))
        slot = F.pmod(F.xxhash64("set", F.lit(heads)), slots)
        first = here.filter("head").groupBy("shingle", slot.alias("slot")).agg(F.min(F.struct("n", "set", "group", "place")).alias("chosen")).select("shingle", "chosen")
        first = tables.replaced(first, "heads")
        n, m = F.col("n"), F.col("chosen.n")
        rest = F.least(n - F.col("place"), m - F.col("chosen.place"))
        near = (F.col("group") != F.col("chosen.group")) & (n >= m) & (m * 100 >= n * how.alike) & (rest * (100 + how.alike) >= (n + m) * how.alike)
        pairs = here.join(first, "shingle").filter(near).select(F.least("set", "chosen.set").alias("a"), F.greatest("set", "chosen.set").alias("b")).distinct()
        pairs = tables.stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        named = [group.select(F.col("set").alias(c), F.col("first").alias(f"group_{c}")) for c in "ab"]
        new = alike_pairs(pairs, sets, how, tables).join(named[0], "a").join(named[1], "b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
        new = tables.stored(new.distinct(), "alike")
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            roots = tables.replaced(components(found), "roots")
        done = first.select("shingle", F.col("chosen.set").alias("set"), F.lit(True).alias("done"))
        live = here.join(done, ["shingle", "set"], "left").select("shingle", "set", "n", "place", (F.col("head") & F.col("done").isNull()).alias("head"))
        heads *= 8
    return roots if roots is not None else group.limit(0).select(F.col("first").alias("node"), F.col("first").alias("root"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", how: Alike = Alike()) -> DataFrame:
    """One row of every group of near copies: the least key, then the first row; rows without a key come last. All columns stay.

    Rows are told apart by their number, so repeated and missing keys neither keep a copy nor drop another text.
    """
    spark = df.sparkSession
    tables = _Tables(spark)
    rows, ids = with_row_ids(df)
    number = F.struct(*ids)
    texts = rows.select(number.alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    prints = tables.stored(texts.select("row", "key", fingerprint(F.col("text"), how.near).alias("value"), set_number(F.col("text"), how).alias("set")), "prints")
    values = tables.stored(prints.select("value").distinct(), "distinct")
    of_set = prints.filter("set is not null").groupBy("set").agg(F.min("value").alias("least"), F.min(F.xxhash64("row")).alias("chosen"))
    of_set = tables.stored(of_set, "sets")
    equal = prints.select("set", "value").distinct().join(of_set, "set").filter("value != least").select(F.col("value").alias("a"), F.col("least").alias("b"))
    roots = components(links(values, how.near).unionByName(equal))
    near = tables.stored(values.join(roots.withColumnRenamed("node", "value"), "value", "left").select("value", F.coalesce("root", "value").alias("group")), "near")
    group = of_set.join(near, of_set["least"] == near["value"]).select("set", "group")
    chosen = spark.sparkContext.broadcast(BitMap.of(of_set, "chosen", Containment(bits_per_shingle=32)))
    merged = alike_groups(candidate_sets(texts.select(F.xxhash64("row"), "text"), how, chosen, tables), group, how, tables)
    final = near.join(merged, near["group"] == merged["node"], "left").select("value", F.coalesce("root", "group").alias("group"))
    placed = tables.stored(prints.join(final, "value").select("row", "key", "group"), "placed")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first"))
    kept_for_result = scratch_path(spark, "gone")
    placed.join(first.select(F.col("first.row").alias("row")), "row", "left_anti").select("row").write.parquet(kept_for_result)
    gone = spark.read.parquet(kept_for_result)
    tables.drop()
    return without_rows(rows, ids, gone).select(*[F.col(f"`{c}`") for c in df.columns])
