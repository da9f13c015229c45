"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

A text's tokens are runs of letters and digits and runs of other signs. Tokens and neighbouring pairs fall into
``buckets`` by hash. The raw model counts the buckets of all texts, the target model those of labelled good texts; a bucket's
log ratio, averaged over the features of a text and carried to ``evidence`` features, is the text's log weight.
Adding Gumbel noise (a function of the key) and taking the ``k`` largest draws ``k`` texts without
replacement in proportion to their weights.

How many to keep follows from the labels: weights are cut where labelled good and bad texts part best (losing good ones counts ``loss`` times), and ``k`` is the number of texts
above. Every count covers all texts; the target model and the cut use a bounded number of labelled rows
(``labelled_per_class``, by key hash). The k-th largest value is found by counting digits of the values, one digit a pass, so nothing is sorted.

Defined cases: a text without tokens has log weight 0 before noise; texts without a key share one noise; rows whose values tie with the last one kept
are all kept; without labelled rows of both classes everything is kept; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.llm.text import ALPHANUMERIC, SPACED, U64, byte_class, mix, rolling, slices, span_hashes, sums, tokens, within_texts
from umbral.session import scratch_path

SIGNS = SPACED & ~ALPHANUMERIC & ~byte_class(lambda b: b >= 128)
_FLOOR = 4


@dataclass(frozen=True)
class Importance:
    buckets: int = 1 << 14
    smoothing: float = 0.5
    evidence: float = 100.0
    labelled_per_class: int = 10_000
    loss: float = 5.0
    seed: int = 7


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token and pair of neighbours, text after text, and where each text begins."""
    words, signs = tokens(texts, ALPHANUMERIC, lower=False), tokens(texts, SIGNS, lower=False)
    start, end = np.r_[words.start, signs.start], np.r_[words.end, signs.end]
    order = np.argsort(start, kind="stable")
    first = words.first + signs.first
    words.start, words.end, words.first = start[order], end[order], first
    hashes = mix(span_hashes(words.data, words.start, words.end))
    pair = within_texts(words, 2)
    pairs = np.where(pair, rolling(hashes, 2), U64(0))
    # A text's features are its tokens with each pair next to its first token; the last token has none.
    both = np.empty((len(hashes), 2), np.int64)
    both[:, 0] = (hashes % U64(buckets)).astype(np.int64)
    both[:, 1] = -1
    both[: len(pairs), 1] = np.where(pair, (pairs % U64(buckets)).astype(np.int64), -1)
    kept = both.ravel() >= 0
    return both.ravel()[kept], np.r_[0, np.cumsum(kept)][2 * first]


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts over all rows of a one-column table; every task sends one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for low, high in slices(batch.column(0)):
                total += np.bincount(features(batch.column(0)[low:high], buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(buckets)
    out[found["at"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out


def log_weight(text: Column | str, ratio: np.ndarray, how: Importance, spark) -> Column:
    """Log weight of each text under the two models."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for low, high in slices(texts):
            found, edges = features(texts[low:high], how.buckets)
            size = np.diff(edges)
            # Short texts are drawn towards 0 by a few features that say nothing.
            parts.append(how.evidence * sums(shared.value[found], edges) / (size + _FLOOR))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run.asNondeterministic()(text)


def _sample(labels: DataFrame, key: str, label: str, how: Importance) -> DataFrame:
    counts = {r[0]: r[1] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit("importance")), F.lit(1_000_000)) / 1_000_000
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col(label) == k, min(1.0, how.labelled_per_class / n)).otherwise(share)
    return labels.filter(place < share).groupBy(F.col(key).alias("__labelled")).agg(F.min(label).cast("int").alias("__label"))


def _cut(weights: np.ndarray, good: np.ndarray, loss: float) -> float:
    """The weight that parts good from bad best, a share of the good lost counting ``loss`` times a share of the bad kept."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.r_[0, np.cumsum(g)] / max(1, g.sum())
    caught = np.r_[0, np.cumsum(~g)] / max(1, (~g).sum())
    best = int(np.argmax(caught - loss * lost))
    if best == 0:
        return float("-inf")
    # The first good text above is at index ``best``: half way between it and the last text below.
    return float((w[best - 1] + w[best]) / 2) if best < len(w) else float("inf")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise, a function of the key."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def value_step(value: Column) -> Column:
    """Numbers in [-2^20, 2^20) as whole steps of 2^-31, which order as they do."""
    return F.floor((value + float(1 << 20)) * float(1 << 31)).cast("bigint")


def kth_largest(df: DataFrame, value: str, k: int) -> int | None:
    """Step of the k-th largest number of a column, without sorting: its bits, at most 12 at a time, by counting."""
    if k <= 0:
        return None
    rows, known, left = df.select(value_step(F.col(value)).alias("step")), 0, k
    for shift in (40, 28, 16, 4, 0):
        digit = F.shiftright(F.col("step"), shift)
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(digit).count().collect()), reverse=True)
        for at, n in counts:
            if left <= n:
                known = at
                break
            left -= n
        else:
            return None
        rows = rows.filter(digit == known)
    return known


def _sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, how: Importance) -> DataFrame:
    """``docs`` with ``__weight``, ``__value`` and ``__kept``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    sample = F.broadcast(_sample(labels, key, label, how))
    labelled = texts.join(sample, F.col("__key") == F.col("__labelled"))
    raw = bucket_counts(texts.select("__text"), how.buckets)
    target = bucket_counts(labelled.filter("__label = 1").select("__text"), how.buckets)
    ratio = np.log((target + how.smoothing) / (target.sum() + how.smoothing * how.buckets))
    ratio -= np.log((raw + how.smoothing) / (raw.sum() + how.smoothing * how.buckets))

    weighed = docs.withColumn("__weight", log_weight(F.col(text).cast("string"), ratio, how, spark))
    valued = weighed.withColumn("__value", F.col("__weight") + gumbel(F.col(key), how.seed))
    path = scratch_path(spark, "weights")
    valued.select(F.col(key).alias("__key"), "__weight", "__value").write.parquet(path)
    stored = spark.read.parquet(path)
    seen = stored.join(sample, F.col("__key") == F.col("__labelled")).select("__weight", "__label").toArrow().to_pandas()
    good = seen["__label"].to_numpy() == 1
    least = None
    if good.any() and not good.all():
        cut = _cut(seen["__weight"].to_numpy(), good, how.loss)
        least = kth_largest(stored, "__value", stored.filter(F.col("__weight") >= cut).count())
    return valued.withColumn("__kept", F.lit(True) if least is None else value_step(F.col("__value")) >= least)


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", how: Importance = Importance()
) -> DataFrame:
    """``docs`` with ``log_weight``, ``sample_value`` (weight and noise) and ``kept``; columns of those names are replaced."""
    found = _sampled(docs, labels, key, text, label, how)
    names = {"log_weight": "__weight", "sample_value": "__value", "kept": "__kept"}
    return found.withColumns({n: F.col(c) for n, c in names.items()}).drop(*names.values())


def keep_sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", how: Importance = Importance()) -> DataFrame:
    """Rows of the sample; the columns of ``docs`` are unchanged."""
    return _sampled(docs, labels, key, text, "quality", how).filter("__kept").select(*docs.columns)
